"""Quality rules: scores and verdicts against a plain count, and the pipeline's stage."""

from __future__ import annotations

import math
import random
import re
import struct
from collections import Counter

import xxhash

from riskweave.llm import quality_rules


def plain_hash(value, seed=42):
    data = value.encode() if isinstance(value, str) else struct.pack("<Q", value)
    return xxhash.xxh64_intdigest(data, seed)


def grams(text, buckets):
    hashes = [plain_hash(w) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
    both = hashes + [plain_hash(y, plain_hash(x)) for x, y in zip(hashes, hashes[1:])]
    return [(h - (1 << 64) if h >> 63 else h) % buckets for h in both]


def plain_scores(rows, trusted, buckets):
    raw, target = Counter(), Counter()
    for doc, text in rows:
        raw.update(grams(text, buckets))
        target.update(grams(text, buckets) if doc in trusted else [])
    share = target.total() / raw.total()
    prior = quality_rules.PRIOR + quality_rules.PRIOR_SHARE * target.total() / buckets
    ratio = {g: math.log((target[g] + prior) / (n * share + prior)) for g, n in raw.items()}
    return [sum(ratio[g] for g in own) / max(len(own), 1) for _, text in rows for own in [grams(text, buckets)]]


def corpus(rng):
    of = lambda words, n: " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(n))
    good, junk = "the of and to in is was for".split(), "buy now click free the of win".split()
    return [(k, of(good if k % 3 else junk, rng.randrange(30, 200))) for k in range(120)] + [(200, None), (201, ""), (None, of(good, 90)), (5, of(good, 90))]


def test_scores_and_verdicts_equal_a_plain_count(frame, spark):
    rows = corpus(random.Random(1))
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 120, 2)] + [(None, 1), (4, 1)], "doc_id long, quality int")
    trusted = {k for k in range(0, 120, 2) if k % 3}
    out = quality_rules.quality_rules(frame(rows), labels).collect()
    got = Counter((r.doc_id, round(r.quality_score, 6), r.kept) for r in out)
    scores = plain_scores(rows, trusted, quality_rules.BUCKETS)
    base = {(r.doc_id, round(r.quality_score, 6)): r.base_failed for r in out}
    want = Counter((doc, round(s, 6), not base[doc, round(s, 6)] and s >= quality_rules.MIN_SCORE) for (doc, _), s in zip(rows, scores))
    assert got == want and {k for _, _, k in got} == {True, False}
    assert any(not r.kept and not r.base_failed for r in out)


def test_stage_keeps_columns_of_clashing_names(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(60))
    schema = "doc_id long, text string, _q_t string, _q_row string, kept string, n_words string"
    docs = spark.createDataFrame([(1, text, "a", "b", "c", "d"), (1, text, "a", "b", "c", "d"), (None, text, "a", "b", "c", "d"), (2, None, "a", "b", "c", "d"), (3, "short", "a", "b", "c", "d")], schema)
    spark.createDataFrame([(9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = quality_rules.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter([(1, text, "a", "b", "c", "d")] * 2 + [(None, text, "a", "b", "c", "d")])
    assert quality_rules.stage(spark, docs.limit(0), str(tmp_path)).count() == 0
