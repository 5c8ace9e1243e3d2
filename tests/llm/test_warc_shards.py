"""Shards of the archive writer over ids that are far apart."""

import pytest

from riskweave.llm import warc


@pytest.mark.parametrize("far", [[2**60], [-(2**63), 2**63 - 1]])
def test_stray_ids_do_not_put_all_pages_into_one_shard(spark, far):
    rows = [(k, "u", "h") for k in [*range(3000), *far]] + [(None, "u", "h")]
    dealt, shards = warc._dealt(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), 500)
    counts = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    assert set(counts) <= set(range(shards)) and sum(counts.values()) == len(rows) and max(counts.values()) <= 700
    ends = dealt.where("page_id IS NOT NULL").groupBy("shard").agg({"page_id": "min"}).orderBy("shard").collect()
    assert [r[1] for r in ends] == sorted(r[1] for r in ends)


def test_pages_with_ids_at_both_ends_are_written_and_read(spark, tmp_path):
    rows = [(-(2**63), "http://a/", "x"), (2**63 - 1, "http://b/", "x"), (0, "http://c/", "y"), (None, "http://d/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.op8_warc(spark, str(tmp_path)).collect()}
    assert got == {-(2**63): ("revisit", 2**63 - 1), 2**63 - 1: ("response", None), 0: ("response", None), None: ("response", None)}
