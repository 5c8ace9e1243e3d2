"""Alignment of two tokenizers: which ids of one stand where which ids of the other stand.

Both vocabularies cut the same bytes. Where a token of A and one of B end at the same byte,
a group ends, and the two tokens that end it are a link. A group of one token on either side
has equal bytes on both, and A's vocabulary tells beforehand which id of B that is: such
groups are counted in one vector over A's vocabulary, of fixed length. Only links of other
groups (and of ids that share their bytes with a second id) are counted as pairs and
shuffled. The corpus-wide counts come back to the documents the same way: vectors over the
vocabularies and the ``HEAVY`` most frequent pairs are broadcast, all other pairs, none of
which is frequent, are joined.

A text that is null or empty, or whose tokens' bytes are not a space and the text (as where
a vocabulary normalises), has no tokens. A very long text is cut at single spaces between
word characters, where both tokenizers always cut; without such a space it stays whole. A
repeated row counts each time and is repeated in the result; rows with a null id take part;
of pairs with equally high counts all are best. An empty table gives no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, sums, table, written
from .tokens import default_path, encoding

#: Characters after which a long text is cut, and of one pass over many texts.
PART, CHUNK = 1 << 18, 1 << 19
#: Frequent pairs that are broadcast: 16 bytes each. No other pair is in more than one of so many links.
HEAVY = 1 << 16
#: Pairs that a task counts before it writes the counts down.
PENDING = 1 << 20
_CUT = re.compile(r"(?<=\w) (?=\w)")


class Vocabularies(NamedTuple):
    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_lengths: np.ndarray
    b_lengths: np.ndarray
    same: np.ndarray  # id of A to the id of B with the same bytes, or -1
    marked: tuple[np.ndarray, np.ndarray, np.ndarray]  # ids as text with a comma, bar and semicolon after them


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Both tokenizers and their tables; loaded once a worker."""
    import sentencepiece

    a = encoding(a_path)
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_bytes = [a.decode_single_token_bytes(i) for i in range(a.n_vocab)]
    b_bytes, of_bytes = [], {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        if not (b.is_control(i) or b.is_unknown(i)) and (b_bytes[i] not in of_bytes or b.is_byte(of_bytes[b_bytes[i]])):
            of_bytes[b_bytes[i]] = i
    numbers = [str(i) for i in range(max(len(a_bytes), len(b_bytes)))]
    return Vocabularies(a, b, a_bytes, b_bytes, np.array([len(x) for x in a_bytes]), np.array([len(x) for x in b_bytes]),
                        np.array([of_bytes.get(x, -1) for x in a_bytes]), tuple(np.array([n + mark for n in numbers], object) for mark in ",|;"))


def _parts(text: str, size: int) -> Iterator[str]:
    """The text, cut at spaces that are left out: each part of a cut text goes on after a space."""
    low = 0
    while len(text) - low > size:
        cut = _CUT.search(text, low + size - 1)
        if not cut:
            break
        yield text[low : cut.start()]
        low = cut.end()
    yield text[low:]


class _Tokens(NamedTuple):
    """Tokens of many parts of texts; ``last_a`` and ``last_b`` are the places of the tokens that end groups."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray  # part k has tokens a_at[k] to a_at[k + 1]
    b_at: np.ndarray
    sound: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    groups_at: np.ndarray


def _tokens(parts: list[str], v: Vocabularies) -> _Tokens:
    spaced = [" " + p for p in parts]
    a = [v.a.encode_ordinary(p) for p in spaced]
    b = v.b.encode(parts, num_threads=1)
    want = [p.encode() for p in spaced]
    sound = np.array([b"".join([v.a_bytes[i] for i in x]) == w and b"".join([v.b_bytes[i] for i in y]) == w for x, y, w in zip(a, b, want)], bool)
    a, b = ([x if s else [] for x, s in zip(side, sound)] for side in (a, b))
    a_at, b_at = (np.cumsum([0, *map(len, side)]) for side in (a, b))
    a, b = (np.fromiter((i for x in side for i in x), np.int64, int(at[-1])) for side, at in ((a, a_at), (b, b_at)))
    # sound parts have equal bytes on both sides, so running sums of lengths are places in all of them
    a_ends, b_ends = np.cumsum(v.a_lengths[a]), np.cumsum(v.b_lengths[b])
    _, last_a, last_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    return _Tokens(a, b, a_at, b_at, sound, last_a, last_b, np.searchsorted(last_a, a_at))


def _sizes(last: np.ndarray) -> np.ndarray:
    return np.diff(last, prepend=-1)


def _written_out(t: _Tokens, v: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    """Ids as text in the order of their groups, A's before B's, each with the mark after it; and where parts begin."""
    comma, bar, semicolon = v.marked
    out = np.empty(len(t.a) + len(t.b), object)
    for ids, last, other, mark, own_first in ((t.a, t.last_a, t.last_b, bar, True), (t.b, t.last_b, t.last_a, semicolon, False)):
        group = np.repeat(np.arange(len(last)), _sizes(last))
        # before a token stand all earlier tokens of its side, and the other side's groups up to its own
        behind = np.concatenate([[0], other + 1])[group if own_first else group + 1]
        text = comma[ids]
        text[last] = mark[ids[last]]
        out[np.arange(len(ids)) + behind] = text
    return out, t.a_at + t.b_at


class _Document:
    """What is known of a text, part after part."""

    def __init__(self, keep_groups: bool):
        self.sound, self.n_a, self.n_b, self.n_groups = True, 0, 0, 0
        self.digest, self.plain, self.pairs, self.groups = hashlib.sha256(), [], [], [] if keep_groups else None

    def add(self, t: _Tokens, k: int, text: list[str], regular: np.ndarray, codes: np.ndarray) -> None:
        self.sound &= bool(t.sound[k])
        low, high = t.groups_at[k], t.groups_at[k + 1]
        if self.n_groups and text:
            self.digest.update(b";")
        self.digest.update("".join(text)[:-1].encode())
        self.n_a, self.n_b, self.n_groups = self.n_a + int(t.a_at[k + 1] - t.a_at[k]), self.n_b + int(t.b_at[k + 1] - t.b_at[k]), self.n_groups + int(high - low)
        own = regular[low:high]
        self.plain.append(t.a[t.last_a[low:high]][own])
        self.pairs.append(codes[low:high][~own])
        if self.groups is not None:
            self.groups.append((t.a[t.a_at[k] : t.a_at[k + 1]], t.b[t.b_at[k] : t.b_at[k + 1]], _sizes(t.last_a)[low:high], _sizes(t.last_b)[low:high]))


def _counted(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return np.unique(joined, return_counts=True)


class Alignment(NamedTuple):
    documents: DataFrame  # row, doc_id, n_a, n_b, n_groups, groups_sha256, n_best, count_sum (and groups)
    pairs: DataFrame  # a, b, count: every pair of ids that is linked


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, ids array<long>, times array<long>, pairs array<long>, pair_times array<long>"
_GROUPS = "groups array<struct<a: array<int>, b: array<int>>>"


def _aligned(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool, part: int, chunk: int) -> DataFrame:
    """A row for each document with its counted links; and rows without ``row`` that hold a task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = vocabularies(a_path, b_path)
        totals = np.zeros(len(v.a_bytes), np.int64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        held, row = 0, TaskContext.get().partitionId() << 40

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in pending]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([n for _, n in pending])).astype(np.int64)

        def finished(rows: list) -> pa.RecordBatch:
            nonlocal row, held
            out = {name: [] for name in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "ids", "times", "pairs", "pair_times")}
            groups = []
            for doc_id, d in rows:
                if not d.sound:
                    d = _Document(keep_groups)
                ids, times = _counted(d.plain)
                pairs, pair_times = _counted(d.pairs)
                totals[ids] += times
                if len(pairs):
                    pending.append((pairs, pair_times))
                    held += len(pairs)
                digest = d.digest.hexdigest() if d.n_groups else ""
                for name, value in zip(out, (row, doc_id, d.n_a, d.n_b, d.n_groups, digest, ids, times, pairs, pair_times)):
                    out[name].append(value)
                row += 1
                if keep_groups:
                    own = []
                    for a, b, a_sizes, b_sizes in d.groups:
                        own += [{"a": x.tolist(), "b": y.tolist()} for x, y in zip(np.split(a, np.cumsum(a_sizes))[:-1], np.split(b, np.cumsum(b_sizes))[:-1])]
                    groups.append(own)
            return batch_of(out, groups)

        def batch_of(out: dict, groups: list) -> pa.RecordBatch:
            lists, n = pa.list_(pa.int64()), len(out["row"])
            columns = [pa.array(out.get(c, [None] * n), pa.string() if c == "groups_sha256" else lists if c in ("ids", "times", "pairs", "pair_times") else pa.int64()) for c in
                       ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "ids", "times", "pairs", "pair_times")]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "ids", "times", "pairs", "pair_times"]
            if keep_groups:
                both = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                columns.append(pa.array(groups or [None] * n, both))
                names.append("groups")
            return pa.RecordBatch.from_arrays(columns, names)

        def counts(codes: np.ndarray, times: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            return batch_of({"row": [None], "ids": [ids], "times": [totals[ids]], "pairs": [codes], "pair_times": [times]}, [])

        def process(queue: list, open_docs: dict) -> list:
            """Adds the parts in ``queue`` (document number, part, last) to their documents; the documents that are whole."""
            t = _tokens([p for _, p, _ in queue], v)
            ends_a, ends_b = t.a[t.last_a], t.b[t.last_b]
            single = (_sizes(t.last_a) == 1) & (_sizes(t.last_b) == 1)
            regular = single & (v.same[ends_a] == ends_b)
            codes = (ends_a << 32) | ends_b
            text, at = _written_out(t, v)
            whole = []
            for k, (number, _, last) in enumerate(queue):
                doc_id, d = open_docs[number]
                d.add(t, k, text[at[k] : at[k + 1]].tolist(), regular, codes)
                if last:
                    whole.append(open_docs.pop(number))
            return whole

        for batch in batches:
            queue, open_docs, size = [], {}, 0
            for number, (doc_id, value) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                open_docs[number] = (doc_id, _Document(keep_groups))
                text = value.as_py()
                held_back = None
                for piece in _parts(text, part) if text else [None]:
                    if held_back is not None:
                        queue.append((number, held_back, False))
                        size += len(held_back)
                        if size >= chunk:
                            yield finished(process(queue, open_docs))
                            queue, size = [], 0
                    held_back = piece
                if text:
                    queue.append((number, held_back, True))
                    size += len(held_back)
                else:
                    yield finished([open_docs.pop(number)])
                if size >= chunk:
                    yield finished(process(queue, open_docs))
                    queue, size = [], 0
                if held >= PENDING:
                    pending[:] = [merged()]
                    held = len(pending[0][0])
                    if held >= PENDING // 2:
                        yield counts(*pending[0], np.zeros(0, np.int64))
                        pending, held = [], 0
            if queue:
                yield finished(process(queue, open_docs))
        if row & ((1 << 40) - 1):
            codes, times = merged() if pending else (np.zeros(0, np.int64),) * 2
            yield counts(codes, times, np.flatnonzero(totals))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, f"{_ROW}, {_GROUPS}" if keep_groups else _ROW)


def _resolved(rows: DataFrame, plain: np.ndarray, same: np.ndarray, best: np.ndarray, codes: np.ndarray, times: np.ndarray, pass_on: list[str]) -> DataFrame:
    """n_best and count_sum over the links whose counts are at hand; the other pairs as ``rest`` and ``rest_times``.

    ``plain`` and ``best`` are vectors over the vocabularies, ``codes`` the sorted frequent pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = {c: batch.column(c).flatten().to_numpy() for c in ("ids", "times", "pairs", "pair_times")}
            at, pairs_at = (np.concatenate([[0], np.cumsum(batch.column(c).value_lengths().to_numpy())]) for c in ("ids", "pairs"))
            count = plain[flat["ids"]]
            n_best = sums(flat["times"] * (count == best[same[flat["ids"]]]), at)
            count_sum = sums(flat["times"] * count, at)
            found = np.zeros(len(flat["pairs"]), bool)
            if len(codes):
                place = np.minimum(np.searchsorted(codes, flat["pairs"]), len(codes) - 1)
                found = codes[place] == flat["pairs"]
                count = np.where(found, times[place], 0)
                n_best += sums(flat["pair_times"] * (found & (count == best[flat["pairs"] & 0xFFFFFFFF])), pairs_at)
                count_sum += sums(flat["pair_times"] * count, pairs_at)
            left = np.concatenate([[0], np.cumsum(sums((~found).astype(np.int64), pairs_at))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(left, pa.array(flat[c][~found])) for c in ("pairs", "pair_times")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in pass_on], pa.array(n_best), pa.array(count_sum), *rest], [*pass_on, "n_best", "count_sum", "rest", "rest_times"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in pass_on)
    return map_arrow(rows.select(*pass_on, "ids", "times", "pairs", "pair_times"), run, f"{schema}, n_best long, count_sum long, rest array<long>, rest_times array<long>")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False, heavy: int = HEAVY, part: int = PART, chunk: int = CHUNK) -> Alignment:
    """Alignment of the texts in ``docs`` (doc_id, text); with ``keep_groups`` also every group's ids of A and B."""
    a_path, b_path = a_path or default_path(), b_path or default_path("piece_bpe_32k.model")
    all_rows = written(_aligned(docs, a_path, b_path, keep_groups, part, chunk), "aligned")
    counts, rows = all_rows.where("row IS NULL"), all_rows.where("row IS NOT NULL")
    v = vocabularies(a_path, b_path)
    plain, best = np.zeros(len(v.a_bytes), np.int64), np.zeros(len(v.b_bytes), np.int64)
    singles = counts.select(F.explode(F.arrays_zip("ids", "times")).alias("s")).groupBy("s.ids").agg(F.sum("s.times").alias("count"))
    for i, n in singles.collect():  # at most A's vocabulary
        plain[i], best[v.same[i]] = n, max(n, best[v.same[i]])
    pairs = counts.select(F.explode(F.arrays_zip("pairs", "pair_times")).alias("s")).groupBy(F.col("s.pairs").alias("code")).agg(F.sum("s.pair_times").alias("count"))
    pairs = written(pairs, "pair-counts")
    for i, n in pairs.groupBy(F.expr("code & 4294967295L").alias("b")).agg(F.max("count")).collect():  # at most B's vocabulary
        best[i] = max(n, best[i])
    frequent = pairs.orderBy(F.desc("count"), "code").limit(heavy).toPandas().sort_values("code")
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"] + ["groups"] * keep_groups
    known = written(_resolved(rows, plain, v.same, best, frequent["code"].to_numpy(np.int64), frequent["count"].to_numpy(np.int64), own), "known")
    # what is left are pairs that none of the frequent ones is: each in few documents
    rest = known.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("s")).select("row", F.col("s.rest").alias("code"), F.col("s.rest_times").alias("times"))
    tops = docs.sparkSession.createDataFrame([(int(i), int(n)) for i, n in enumerate(best) if n], "b long, best long")
    counted = rest.join(pairs, "code").join(F.broadcast(tops), F.expr("code & 4294967295L") == F.col("b"))
    counted = counted.groupBy("row").agg(F.sum(F.expr("IF(count = best, times, 0L)")).alias("more_best"), F.sum(F.expr("times * count")).alias("more_sum"))
    documents = known.drop("rest", "rest_times").join(counted, "row", "left").select(
        *own, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
    regular = docs.sparkSession.createDataFrame([(int(i), int(v.same[i]), int(plain[i])) for i in np.flatnonzero(plain)], "a long, b long, count long")
    return Alignment(documents, pairs.select(F.expr("shiftright(code, 32)").alias("a"), F.expr("code & 4294967295L").alias("b"), "count").union(regular))


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents")).documents
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
