"""Token shards: the order against a plain rebuild, repeated runs in one folder, empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from riskweave.llm import token_shards, tokens
from riskweave.llm.common import scratch

SIZES = dict(stride=16, shard_rows=10)


def texts(rng, first, n):
    rows = [(first + k, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(60)))) for k in range(n)]
    return rows + [(None, "no id"), (first, "another text of that id"), (first, None), (first, ""), *rows[:2], (first + n, "long " * 2000)]


def write(docs, folder, **more):
    table = token_shards.token_table(docs, scratch(docs.sparkSession, "tokens"), 16, tokens.default_path())
    return token_shards.write_shards(table, folder, **SIZES, **more)


def read(manifest, folder):
    return sorted(tuple(r) for r in token_shards.read_shards(manifest, folder, 16, 10).select("place", "doc_id", "piece", "n_tokens", "ids_crc32").collect())


def plain(rows, key):
    """The same sequences in the same places, without Spark."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.blake2b((r[1] or "").encode(), digest_size=16).digest()))
    cut = [(doc, k // 16, ids[k : k + 16]) for doc, text in order for ids in [tokens.encode(text, tokens.default_path())] for k in range(0, len(ids), 16)]
    places = token_shards.permuted(np.arange(len(cut)), len(cut), key)
    return sorted((int(p), doc, piece, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for p, (doc, piece, ids) in zip(places, cut))


def test_order_equals_a_plain_rebuild_however_the_input_is_cut(frame, spark):
    rows = texts(random.Random(1), 100, 30)
    for parts in (1, 5):
        folder = scratch(spark, "shards")
        assert read(write(frame(rows).repartition(parts), folder, key=7), folder) == plain(rows, 7)


def test_a_folder_with_shards_of_other_data_or_another_key_is_rewritten(frame, spark):
    folder, rng = scratch(spark, "shards"), random.Random(2)
    one, other = texts(rng, 100, 30), texts(rng, 500, 30)
    for rows, key in [(one, 1), (other, 1), (other, 2)]:
        assert read(write(frame(rows), folder, key=key), folder) == plain(rows, key)


def test_a_repeated_run_leaves_whole_shards_alone(frame, spark):
    import os

    folder, rows = scratch(spark, "shards"), texts(random.Random(3), 1, 30)
    write(frame(rows), folder)
    place = folder.removeprefix("file:")
    names = sorted(n for n in os.listdir(place) if n.endswith(".bin"))
    with open(f"{place}/{names[0]}", "r+b") as file:
        file.write(b"\0\0\0\0")
    times = {n: os.stat(f"{place}/{n}").st_mtime_ns for n in names}
    manifest = write(frame(rows).repartition(3), folder)
    assert read(manifest, folder) == plain(rows, token_shards.KEY)
    assert [n for n in names if os.stat(f"{place}/{n}").st_mtime_ns != times[n]] == names[:1]


def test_ids_are_dealt_to_shards_in_less_room_and_come_back():
    rng = random.Random(4)
    ids = [tokens.encode(" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(60))), tokens.default_path()).astype("<u2") for _ in range(500)]
    place = token_shards.permuted(np.arange(500), 500)
    rows = pa.table({"doc_id": pa.array([None, *range(499)], pa.int64()), "piece": pa.array([0] * 500, pa.int32()), "ids": [i.tobytes() for i in ids]})
    dealt = token_shards.packed(place, rows, 200).to_pylist()
    assert sum(len(r["block"]) for r in dealt) < 0.7 * (rows.column("ids").nbytes + 500 * 24)
    got = {}
    for r in dealt:
        places, index, flat = token_shards.unpacked(r["rows"], r["size"], r["block"])
        assert set(places // 200) == {r["shard"]}
        for p, one, own in zip(places, index, np.split(flat, np.cumsum(index["n"])[:-1])):
            got[int(p)] = (int(one["doc_id"]), own.tolist())
    assert got == {int(p): (k - 1 if k else token_shards.NO_ID, ids[k].tolist()) for k, p in enumerate(place)}


def test_an_empty_table_writes_no_shard(frame, spark):
    folder = scratch(spark, "shards")
    assert read(write(frame([(1, "x")]).limit(0), folder), folder) == []
