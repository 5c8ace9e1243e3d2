"""Benchmark decontamination with SimHash windows of the size of each benchmark item.

A document is contaminated if one of its windows, as long as an item, has a weighted
similarity of at least 0.8 with it. Words are runs of letters and digits in lower case;
five in a row make a shingle; a shingle's weight falls with the number of items that hold
it, and the similarity is the sum of the smaller weighted counts over that of the larger.

Windows are looked for only around words whose shingle occurs in an item: any other window
has similarity zero. Their fingerprints are slid over the text. A multi-index of four
16-bit blocks, each with the ball that the pigeonhole principle asks for, returns every
item within ``radius`` bits of a window; candidates are then compared exactly.

The item side is cut into groups of bounded size, each broadcast and held against all
documents, so the benchmark may grow. Weights count the holders of a shingle among all
items before groups are cut, so that no result depends on the grouping.

Null and empty texts, and items without a word, match nothing. A document or item of fewer
than five words is one shingle. Rows are judged one by one: repeated rows give repeated
results, repeated items too. Rows with null ids are judged. Texts of any length are read
whole. Of windows that are equally similar to an item the first counts. An empty benchmark
finds nothing. Other columns are carried along by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow, slices, table, written
from .words import NOT_ALNUM, find_words, majority_bits, shingle_hashes, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: Bits that the fingerprints of a window and an item may differ in; pairs at a similarity of 0.8 have about 10.
RADIUS = 18
#: Bounds of one broadcast group: its words, and its items, each of which takes about 60 kB of block tables.
GROUP_SHINGLES = 200_000
GROUP_ITEMS = 1_000
BLOCKS, BLOCK_BITS = 4, 16


class Items(NamedTuple):
    ids: list
    sizes: np.ndarray  # words of each item
    shingles: np.ndarray  # sorted distinct shingles of all items
    weights: np.ndarray  # their weights
    unknown: float  # the weight of a shingle that no item has
    sets: list  # (distinct shingles, counts) of each item
    fps: np.ndarray
    table: list  # per block: items by the values in the balls around their own


def _hashed(data: np.ndarray, offsets: np.ndarray, size: int):
    words = find_words(data, offsets, NOT_ALNUM)
    return words, *shingle_hashes(word_hashes(data, words), words.bounds, size)


def _balls(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values within ``radius`` bits of each 16-bit value, and whose they are."""
    masks = np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BLOCK_BITS), r)], np.uint16)
    near = (values[:, None] ^ masks[None, :]).ravel()
    owner = np.repeat(np.arange(len(values), dtype=np.int32), len(masks))
    order = np.argsort(near, kind="stable")
    return near[order], owner[order]


def prepare(rows: list[tuple], total: int, radius: int = RADIUS, size: int = WORDS) -> Items:
    """The index of a group of items (id, lower-cased text, shingles, how many of all ``total``
    items hold each of them)."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] or "" for r in rows], pa.string())], ["text"])
    sets, sizes, fps = [], [], []
    for _, data, offsets in slices([batch]):
        words, hashes, bounds = _hashed(data, offsets, size)
        fps.append(majority_bits(hashes, bounds))
        sizes.append(np.diff(words.bounds))
        sets += [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:])]
    shingles, at = np.unique(np.concatenate([np.array(r[2] or [], np.int64).view(np.uint64) for r in rows]), return_index=True)
    held = np.concatenate([np.array(r[3] or [], np.int64) for r in rows])[at]
    fps = np.concatenate(fps or [np.zeros(0, np.uint64)])
    blocks = [_balls(((fps >> np.uint64(BLOCK_BITS * k)) & np.uint64(0xFFFF)).astype(np.uint16), radius // BLOCKS) for k in range(BLOCKS)]
    return Items([r[0] for r in rows], np.concatenate(sizes or [np.zeros(0, np.int64)]), shingles, np.log1p(total / held), float(np.log1p(total)), sets, fps, blocks)


def _weighed(items: Items, hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(items.shingles, hashes), len(items.shingles) - 1)
    return np.where(items.shingles[at] == hashes, items.weights[at], items.unknown)


def similarity(items: Items, item: int, window: np.ndarray) -> float:
    own, own_counts = items.sets[item]
    other, counts = np.unique(window, return_counts=True)
    both = np.union1d(own, other)
    a, b = np.zeros(len(both)), np.zeros(len(both))
    a[np.searchsorted(both, own)] = own_counts
    b[np.searchsorted(both, other)] = counts
    w = _weighed(items, both)
    return float((w * np.minimum(a, b)).sum() / max((w * np.maximum(a, b)).sum(), 1e-12))


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def windows_of(hashes: np.ndarray, seeds: np.ndarray, items: Items, radius: int, least: float, size: int = WORDS) -> dict[int, tuple[int, int, float]]:
    """item: (first shingle, shingles, similarity) of the best window of one text."""
    best: dict[int, tuple[int, int, float]] = {}
    longest = int(items.sizes.max())
    # stretches of text around seeds; a window that holds a seed lies inside one
    cuts = np.flatnonzero(np.diff(seeds) > 2 * longest)
    for group in np.split(seeds, cuts + 1):
        low, high = max(0, int(group[0]) - longest), min(len(hashes), int(group[-1]) + longest)
        part = hashes[low:high]
        total = _bit_sums(part)
        for words in np.unique(items.sizes[items.sizes > 0]):
            n = min(max(int(words) - size + 1, 1), len(part))
            starts = np.arange(len(part) - n + 1)
            near = np.searchsorted(group - low, starts)
            starts = starts[(near < len(group)) & ((group - low)[np.minimum(near, len(group) - 1)] < starts + n)]
            if not len(starts):
                continue
            fps = np.packbits(2 * (total[starts + n] - total[starts]) > n, axis=1, bitorder="little").view("<u8").ravel()
            found = []
            for k, (values, owner) in enumerate(items.table):
                value = ((fps >> np.uint64(BLOCK_BITS * k)) & np.uint64(0xFFFF)).astype(np.uint16)
                a, b = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
                at = np.repeat(np.arange(len(starts)), b - a)
                of = owner[np.arange(len(at)) + np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a)]
                fits = items.sizes[of] == words
                found.append(at[fits] * len(items.ids) + of[fits])
            pairs = np.unique(np.concatenate(found))
            at, of = pairs // len(items.ids), pairs % len(items.ids)
            close = np.bitwise_count(fps[at] ^ items.fps[of]) <= radius
            for x, item in zip(starts[at[close]].tolist(), of[close].tolist()):
                value = similarity(items, item, part[x : x + n])
                if value >= least and value > best.get(item, (0, 0, 0.0))[2]:
                    best[item] = (low + x, n, value)
    return best


def _matches(batch, data, offsets, items: Items, radius: int, least: float):
    """(row, item, first word, shingles, similarity) of a slice's contaminated texts."""
    words, hashes, bounds = _hashed(data, offsets, WORDS)
    if not len(hashes) or not len(items.shingles):
        return
    low = np.zeros(1 << 16, bool)
    low[(items.shingles & np.uint64(0xFFFF)).astype(np.int64)] = True
    seeds = np.flatnonzero(low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.shingles, hashes[seeds]), len(items.shingles) - 1)
    seeds = seeds[items.shingles[at] == hashes[seeds]]
    of = np.searchsorted(bounds, seeds, "right") - 1
    for row in np.unique(of):
        own = slice(bounds[row], bounds[row + 1])
        for item, (first, n, value) in sorted(windows_of(hashes[own], seeds[of == row] - bounds[row], items, radius, least).items()):
            yield int(row), item, first, n, value


def with_holders(items: DataFrame, size: int = WORDS) -> DataFrame:
    """``items`` (item_id, text) with their distinct ``shingles`` and, for each, ``held``: how many
    items hold it. Counted once for each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            _, hashes, bounds = _hashed(data, offsets, size)
            for k in range(batch.num_rows):
                own = np.unique(hashes[bounds[k] : bounds[k + 1]]).view(np.int64)
                for low in range(0, len(own), 10_000):
                    part = pa.array(own[low : low + 10_000])
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(np.full(len(part), k))) for c in ("name", "copies")], part], ["name", "copies", "shingle"])

    named = items.withColumn("name", F.sha2("text", 256))
    texts = named.groupBy("name").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    shingles = written(map_arrow(texts.select("name", "copies", "text"), run, "name string, copies long, shingle long"), "item-shingles")
    held = shingles.join(shingles.groupBy("shingle").agg(F.sum("copies").alias("held")), "shingle")
    of = held.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("shingle", "held"))).alias("of"))
    return named.join(of, "name", "left").select("item_id", "text", F.col("of.shingle").alias("shingles"), F.col("of.held").alias("held"))


def item_groups(benchmark: DataFrame, most: int = GROUP_SHINGLES, most_items: int = GROUP_ITEMS) -> Iterator[Items]:
    """Indexed items, fetched in order of id, in groups of a bounded size."""
    lowered = benchmark.select("item_id", F.lower("text").alias("text")).where("text IS NOT NULL")
    items = written(with_holders(lowered), "items")
    total = items.count()
    rows, held = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        rows.append(tuple(row))
        held += row.text.count(" ") + 1
        if held >= most or len(rows) >= most_items:
            yield prepare(rows, total)
            rows, held = [], 0
    if rows:
        yield prepare(rows, total)


def matches(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY, **group) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): for each document and item its best window."""
    out = None
    lowered = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text"))
    schema = "doc_id long, item_id long, first_word long, similarity double"
    for items in item_groups(benchmark, **group):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch, data, offsets in slices(batches):
                found = list(_matches(batch, data, offsets, items, radius, least))
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.float64())], ["doc_id", "item_id", "first_word", "similarity"])

        part = map_arrow(lowered, run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    for items in item_groups(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        own = docs.schema.fields

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=[f.name for f in own]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in slices(batches, "_d_text"):
                keep = np.ones(batch.num_rows, bool)
                for found in _matches(batch, data, offsets, shared.value, radius, least):
                    keep[found[0]] = False
                yield batch.select(names).filter(pa.array(keep))

        docs = map_arrow(docs.withColumn("_d_text", F.lower("text")), run, T.StructType(own))
    return docs


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
