"""SimHash fingerprints of word shingles and near-duplicate groups.

``fingerprint_groups`` links fingerprints at three or fewer differing bits, all of them,
by multi-index hashing: a fingerprint has two segments of 32 bits, and two fingerprints
that differ in three bits at most differ in one bit at most of one segment. So each looks
up, for both segments, its value and the values one bit away, and compares the whole
fingerprint with what it finds. Large families of copies are joined first through shared
points one bit away, without pairing their members, and lookups then leave out pairs
whose members are already known to hang together.

``near_duplicates`` finds documents whose sets of five-word shingles have a Jaccard
similarity of at least 0.8, for the pipeline. Fingerprints of the sets that the multi-index
search finds near each other are compared first, then each text with the nearest of the
texts that stand for its rarest shingles, then the texts of small buckets of each of them; these
join large families without pairing them. Last, prefixes of ordered shingles give every similar
pair that is still apart.

Null texts count as empty. Texts without a word have fingerprint zero and are linked like
any other by ``fingerprint_groups``; by ``near_duplicates`` all of them are copies of one
another. Repeated rows are repeated in the result, but for the pipeline. Rows with a null id
take part, but never name a group unless all of its ids are null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import map_arrow, scratch, slices, table, written
from .components import connected_components
from .words import LOWER, find_words, majority_bits, shingle_hashes, word_hashes

RADIUS = 3
SEED = 42


def _joined_words(data: np.ndarray, words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each, and their places."""
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    of = np.arange(int(lengths.sum())) + np.repeat(words.starts - (np.cumsum(lengths) - lengths), lengths)
    out[inside] = LOWER[data[of]]
    return out.tobytes(), starts, ends


def _exact_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles' UTF-8 bytes, words joined by one space, and their bounds."""
    words = find_words(data, offsets)
    joined, starts, ends = _joined_words(data, words)
    counts = np.diff(words.bounds)
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(at[-1]) + np.repeat(words.bounds[:-1] - at[:-1], n)
    last = np.minimum(first + size, np.repeat(words.bounds[1:], n)) - 1
    digests = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[first].tolist(), ends[last].tolist())]
    return np.array(digests, np.uint64), at


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): a bit of fp is 1 if set in over half the hashes of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            fp = majority_bits(*_exact_hashes(data, offsets, size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _flipped(value: str, bits: int) -> Column:
    """The values one bit away from a long column."""
    return F.expr(f"transform(sequence(0, {bits - 1}), k -> {value} ^ shiftleft(1L, k))")


def _ball_links(points: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most two bits apart: such two share a
    point that each has within one bit. A point has at most 65 fingerprints around it."""
    around = points.select("fp", F.explode(F.concat(F.array("fp"), _flipped("fp", 64))).alias("point"))
    groups = around.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
    return groups.select(F.expr("fps[0]").alias("a"), F.explode(F.expr("slice(fps, 2, size(fps))")).alias("b")).distinct()


def _segment_pairs(grouped: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b, of_a, of_b) of fingerprints of different groups at most ``radius`` bits apart.

    Of two values one bit apart just one has the bit unset, so only unset bits are
    flipped in a lookup; equal values are compared in one direction.
    """
    halves = grouped.select("fp", "component", F.posexplode(F.array(F.expr("shiftrightunsigned(fp, 32)"), F.expr("fp & 4294967295L"))).alias("segment", "value"))
    ups = F.expr("transform(filter(sequence(0, 31), k -> value & shiftleft(1L, k) = 0), k -> value | shiftleft(1L, k))")
    probes = halves.select(F.col("fp").alias("a"), F.col("component").alias("of_a"), "segment", F.posexplode(F.concat(F.array("value"), ups)).alias("step", "value"))
    stored = halves.select(F.col("fp").alias("b"), F.col("component").alias("of_b"), "segment", "value")
    return probes.join(stored, ["segment", "value"]).where(
        (F.col("of_a") != F.col("of_b")) & ((F.col("step") > 0) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))


def _segment_links(grouped: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the groups of such fingerprints."""
    return _segment_pairs(grouped, radius).select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()


def fingerprint_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for each fingerprint in ``prints`` (doc_id, fp): the smallest doc_id
    that links of at most ``radius`` (two or three) differing bits reach."""
    if radius not in (2, 3):
        raise ValueError("the segments are laid out for a radius of 2 or 3")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    first = connected_components(_ball_links(points))
    grouped = written(points.join(first, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "grouped")
    second = connected_components(_segment_links(grouped, radius))
    grouped = grouped.join(second.select("node", F.col("component").alias("whole")), F.col("component") == F.col("node"), "left")
    grouped = written(grouped.select("fp", "least", F.coalesce("whole", "component").alias("component")), "grouped")
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return written(grouped.join(ids, "component").select("fp", "component_id"), "groups")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    groups = fingerprint_groups(prints)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by similarity, for the pipeline -------------------------------------

WORDS = 5
SIMILARITY = 0.8
#: The bitmap of ids in pairs has two to this power of bits, 8 MB.
FILTER_BITS = 26
#: A text and the text that stands for a shingle are compared if their fingerprints differ in so many bits
#: at most; pairs farther apart are left to the search by prefixes.
FAR_BITS = 24
#: Rounds of comparing texts with those that stand for their shingles.
ROUNDS = 3
#: In the round before the search of all pairs, so many texts or fewer share a bucket of a shingle, on average.
MET = 64
#: Shingles counted as common at most; they come last in the order of the second search.
COMMON = 1 << 16
#: One text in so many is counted for them.
COUNTED = 16


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    words = find_words(data, offsets)
    return shingle_hashes(word_hashes(data, words), words.bounds, size)


def text_key() -> Column:
    """Equal for equal texts; zero for all texts without a word."""
    return F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("text")).otherwise(F.lit(0))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, copy, row): ``row`` is equal for equal ids and texts."""
    own = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("copy"))
    return own.withColumn("row", F.xxhash64("copy", F.coalesce("doc_id", F.lit(0))))


def common_shingles(docs: DataFrame, size: int = WORDS, at_most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts hold, and their counts in a part of the texts.

    They only set the order in which ``sketches`` looks at shingles: any order gives the same
    result, this one keeps shingles of large families out of the lookups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            hashes, bounds = _shingles(data, offsets, size)
            sets = [np.unique(hashes[bounds[k] : bounds[k + 1]]) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    part = docs.where(f"pmod(xxhash64(text), {COUNTED}) = 0").select("text")
    counts = written(map_arrow(part, run, "shingle long").groupBy("shingle").count().where("count > 1"), "counts")
    levels = counts.groupBy(F.expr("least(count, 10000)").alias("level")).count().orderBy(F.desc("level")).collect()
    least, total = 10_001, 0
    for level, n in levels:
        total += n
        if total > at_most:
            break
        least = level
    found = counts.where(F.col("count") >= least).orderBy("shingle").toPandas()
    shingles = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["count"].to_numpy(np.int64)[order]


def _length(n, share: float):
    """How many of n ordered shingles a set can be looked up by, if it shares this share of them."""
    return n - np.ceil(share * n - 1e-9).astype(np.int64) + 1


def _parity(hashes: np.ndarray) -> bytes:
    """For each of two to four times as many places as there are hashes: whether an odd number falls there."""
    places = 1 << max(6, int(2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes are in just one of two sets, at least: places whose parities differ hold one.
    The longer parity is folded to the places of the shorter."""
    while len(x) != len(y):
        longer = x if len(x) > len(y) else y
        half = len(longer) // 2
        folded = longer[:half] ^ longer[half:]
        x, y = (folded, y) if longer is x else (x, folded)
    return int(np.bitwise_count(x ^ y).sum())


def sketches(rows: DataFrame, size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(copy, row, fp, n, prefix, parity) of every one of the ``keyed`` rows: ``n`` distinct shingles
    with a fingerprint and a parity; ``prefix`` has the rarest, of which two similar texts have one in common."""
    common, counts = common_shingles(rows, size)

    def rarest(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        held = np.zeros(len(s), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            held = np.where(common[at] == s, counts[at], 0)
        return s[np.argsort(held, kind="stable")[: _length(np.int64(len(s)), similarity)]]  # s is sorted: ties by hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            hashes, bounds = _shingles(data, offsets, size)
            sets = [np.unique(hashes[bounds[k] : bounds[k + 1]]) for k in range(batch.num_rows)]
            fp = majority_bits(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))  # of the sets, as the similarity is
            yield pa.RecordBatch.from_arrays([
                batch.column("copy"), batch.column("row"), pa.array(fp.view(np.int64)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([rarest(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([_parity(s) for s in sets], pa.binary()),
            ], ["copy", "row", "fp", "n", "prefix", "parity"])

    return map_arrow(rows.select("copy", "row", "text"), run, "copy long, row long, fp long, n long, prefix array<long>, parity binary")


def same_point_pairs(alone: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that connect equal fingerprints and those at most two bits apart."""
    points = alone.groupBy("fp").agg(F.min("copy").alias("first"))
    equal = alone.join(points, "fp").where("copy <> first").select(F.col("first").alias("a"), F.col("copy").alias("b"))
    links = _ball_links(points.select("fp"))
    return equal.union(links.join(points.toDF("a", "of_a"), "a").join(points.toDF("b", "of_b"), "b").select("of_a", "of_b"))


def segment_pairs(alone: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of different groups, one for each fingerprint, at most three bits apart."""
    points = alone.select("copy", "fp").join(named, "copy").groupBy("fp").agg(F.min(F.struct("copy", "group")).alias("first"))
    points = written(points.select("fp", F.col("first.copy").alias("copy"), F.col("first.group").alias("component")), "points")
    near = _segment_pairs(points.select("fp", "component"), RADIUS).select("a", "b").distinct()
    of = points.select("fp", "copy")
    return near.join(of.toDF("a", "of_a"), "a").join(of.toDF("b", "of_b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))


def lookups(alone: DataFrame) -> DataFrame:
    """(key, copy, fp, n, pos) for each shingle of a prefix that at least two texts have there."""
    every = alone.select("copy", "fp", "n", F.posexplode("prefix").alias("pos", "key"))
    shared = written(every.groupBy("key").count().where("count > 1").select("key"), "shared-shingles")
    return perhaps_in(every, shared, "key").join(shared, "key").select("key", "copy", "fp", "n", "pos")


def _apart(held: DataFrame, named: DataFrame) -> DataFrame:
    """The lookups with their groups and ``texts``, how many hold the shingle, but for shingles that
    texts of one group alone hold."""
    grouped = written(held.join(named, "copy"), "grouped-lookups")
    spread = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("texts")).where("low <> high")
    return grouped.join(spread.select("key", "texts"), "key")


def hub_pairs(held: DataFrame, named: DataFrame, similarity: float, turn: int) -> DataFrame:
    """A pair (a, b) at most for each text: of the texts that stand for its shingles, the one with the
    nearest fingerprint among those of other groups. So a family costs as many pairs as it has texts."""
    held = written(_apart(held, named), "apart")
    order = F.xxhash64("copy", F.lit(turn))
    hubs = held.groupBy("key").agg(F.min(F.struct(order.alias("order"), "copy", "fp", "n", "group")).alias("hub"))
    far = "cast(bit_count(fp ^ hub.fp) AS int)"
    met = held.join(hubs, "key").where(f"group <> hub.group AND {far} <= {FAR_BITS} AND least(n, hub.n) >= {similarity!r}D * greatest(n, hub.n) - 1e-9D")
    best = met.groupBy("copy").agg(F.min(F.struct(F.expr(far).alias("far"), F.col("hub.copy").alias("hub"))).alias("best"))
    return best.select(F.col("best.hub").alias("a"), F.col("copy").alias("b"))


def prefix_pairs(held: DataFrame, named: DataFrame, similarity: float, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of texts from different groups that may be similar, and all that are.

    In any one order of shingles, two sets at the similarity have a shingle in common among the
    first of each: of the longer set's as many as ``prefix`` has, of the shorter set's about half
    as many. Their lengths and the places of the first common shingle bound what they share.
    Shingles that only texts of one group hold are left out before texts are paired, so a
    family that earlier searches have joined is not paired out.

    With ``most``, the texts of a shingle are dealt into buckets of at most so many, on average, and
    paired in their bucket only: pairs grow with the lookups, not with the square of a family. Each
    shingle deals them anew, so a family of similar texts hangs together after it.
    """
    both = similarity / (1 + similarity)
    held = written(_apart(held, named), "apart")
    on = ["key"]
    if most is not None:
        held = held.withColumn("bucket", F.expr(f"pmod(xxhash64(copy, key), shiftleft(1L, cast(ceil(log2(greatest(1D, texts / {most}))) AS int)))"))
        on = ["key", "bucket"]
    x = held.select(*on, *[F.col(c).alias(f"{c}_x") for c in ("copy", "group", "n", "pos")])
    y = held.where(f"pos <= n - ceil({2 * both!r}D * n - 1e-9D)").select(*on, *[F.col(c).alias(f"{c}_y") for c in ("copy", "group", "n", "pos")])
    near = F.expr(f"""group_x <> group_y AND (n_y < n_x OR n_y = n_x AND copy_y < copy_x) AND n_y >= {similarity!r}D * n_x - 1e-9D
        AND 1 + least(n_x - pos_x - 1, n_y - pos_y - 1) >= {both!r}D * (n_x + n_y) - 1e-9D""")
    return x.join(y, on).where(near).select(F.col("copy_x").alias("a"), F.col("copy_y").alias("b")).distinct()


def close_pairs(pairs: DataFrame, alone: DataFrame, similarity: float) -> DataFrame:
    """The pairs but for those whose lengths or parities rule the similarity out. Every similar pair stays."""
    of = alone.select("copy", "n", "parity")
    both = pairs.join(of.toDF("a", "n_a", "of_a"), "a").join(of.toDF("b", "n_b", "of_b"), "b")
    both = both.where(f"least(n_a, n_b) >= {similarity!r}D * greatest(n_a, n_b) - 1e-9D")
    most = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            apart = [_least_apart(*(np.frombuffer(v.as_buffer(), np.uint8) for v in xy)) for xy in zip(batch.column("of_a"), batch.column("of_b"))]
            keep = np.array(apart, np.int64) <= most * total + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def perhaps_in(rows: DataFrame, ids: DataFrame, column: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """The ``rows`` whose ``column`` is in ``ids``, and few others: those that share a bit with one
    in a bitmap of fixed size. It keeps wide rows out of a shuffle; an exact join follows."""
    place = f"pmod(xxhash64({column}), {1 << bits}L) + 1"
    marks = ids.select(F.expr(place).alias("_s_place")).groupBy(F.expr("bitmap_bucket_number(_s_place)").alias("_s_bucket"))
    marks = marks.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_s_place))").alias("_s_marks"))
    placed = rows.withColumn("_s_place", F.expr(place)).withColumn("_s_bucket", F.expr("bitmap_bucket_number(_s_place)"))
    at = "bitmap_bit_position(_s_place)"
    of = f"cast(conv(hex(substring(_s_marks, cast({at} div 8 AS int) + 1, 1)), 16, 10) AS int)"
    marked = placed.join(F.broadcast(marks), "_s_bucket").where(f"shiftright({of}, cast({at} % 8 AS int)) % 2 = 1")
    return marked.select(*[F.col(f"`{c}`") for c in rows.columns])


def shingle_sets(pairs: DataFrame, alone: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(copy, shingles) of the texts in ``pairs``: sorted distinct 32-bit hashes as bytes, made from one
    of the ``keyed`` rows with the text. No text is moved and no other text's set is made or kept."""
    wanted = pairs.select(F.col("a").alias("copy")).union(pairs.select("b")).distinct()
    wanted = written(wanted.join(alone.select("copy", "row"), "copy"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            hashes, bounds = _shingles(data, offsets, size)
            sets = [np.unique((hashes[bounds[k] : bounds[k + 1]] >> np.uint64(32)).astype("<u4")).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("copy"), batch.column("row"), pa.array(sets, pa.binary())], ["copy", "row", "shingles"])

    found = map_arrow(perhaps_in(rows, wanted, "row").select("copy", "row", "text"), run, "copy long, row long, shingles binary")
    return found.join(wanted, ["copy", "row"]).select("copy", "shingles").dropDuplicates(["copy"])


def similar_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity."""
    both = pairs.select("a", "b").join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def near_groups(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy, group) for every distinct (doc_id, copy) in ``docs``, a written table. The
    search is among distinct texts, named by ``copy``; ids may be null and need not be unique."""
    rows = keyed(docs)
    alone = written(sketches(rows, size, similarity).dropDuplicates(["copy"]), "sketches")
    named = alone.select("copy", F.col("copy").alias("group"))

    def joined(pairs: DataFrame) -> DataFrame:
        close = written(close_pairs(pairs, alone, similarity), "close-pairs")
        if close.isEmpty():
            return named
        sets = written(shingle_sets(close, alone, rows, size), "sets")
        links = similar_links(close, sets, similarity).join(named.toDF("a", "of_a"), "a").join(named.toDF("b", "of_b"), "b")
        return written(_merged(named, connected_components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))), "named")

    named = joined(same_point_pairs(alone))
    named = joined(segment_pairs(alone, named))
    held = written(lookups(alone), "lookups")
    for turn in range(ROUNDS):
        named = joined(hub_pairs(held, named, similarity, turn))
    named = joined(prefix_pairs(held, named, similarity, MET))
    named = joined(prefix_pairs(held, named, similarity))
    return written(rows.select("doc_id", "copy").distinct().join(named, "copy"), "grouped")


def near_duplicates(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, copy, component_id) for every distinct (doc_id, copy) in ``docs``: component_id
    is the smallest id of the group, null if all are null."""
    rows = near_groups(docs, size, similarity)
    return rows.join(rows.groupBy("group").agg(F.min("doc_id").alias("component_id")), "group").select("doc_id", "copy", "component_id")


def _merged(named: DataFrame, components: DataFrame) -> DataFrame:
    """(copy, group) with the groups that ``components`` (node, component) joins under one name."""
    joined = named.join(components, F.col("group") == F.col("node"), "left")
    return joined.select("copy", F.coalesce("component", "group").alias("group"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: one with the smallest id, with a null id only if the group
    has no other; of that id's texts in the group and of repeated rows also one."""
    own = docs.columns
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "copy"))
    stays = near_groups(docs).groupBy("group").agg(first.alias("first")).select(*[F.col(f"first.{c}").alias(f"_n_{c}") for c in ("none", "id", "copy")])
    rows = docs.withColumn("_n_copy", text_key()).withColumn("_n_none", F.col("doc_id").isNull()).withColumn("_n_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    kept = rows.join(stays, ["_n_none", "_n_id", "_n_copy"]).dropDuplicates(["_n_none", "_n_id", "_n_copy"])
    return kept.select(*[F.col(f"`{c}`") for c in own])
