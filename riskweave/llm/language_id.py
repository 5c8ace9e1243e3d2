"""Language identification with n-gram filters whose slots hold a bitmask of languages.

Every language has a Bloom filter of the byte n-grams typical for it; the filters are
bit-sliced, so one slot holds the bits of up to 64 languages and a lookup returns all
languages that contain an n-gram at once. A text's n-grams are counted per language and
corrected for the share of n-grams that a filter returns falsely; the language with the
highest corrected count wins.

Null texts and texts without a letter are ``und`` with score 0. A tie goes to the language
first in alphabetical order. Rows are judged one by one: repeated rows get equal results.
Without a single training text every text is ``und``. Other columns are carried along by
``identify``; its own are ``lang_pred`` and ``score``, which replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import doc_of, map_arrow, slices, table, written
from .words import NOT_ALNUM, mix

UNKNOWN = "und"
#: Training rows: at most so many documents, those with the smallest hashed ids.
TRAINING_DOCUMENTS = 20_000
NGRAM = 4
SLOT_BITS = 20
PROBES = 2
#: An n-gram is put into a language's filter if its rate there is at least this share of its highest rate.
TYPICAL = 0.34
MIN_COUNT = 5
MIN_SCORE = 0.30


class Filters(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # uint64 masks
    false_rate: np.ndarray  # per language


_DIGITS = np.isin(np.arange(256), np.arange(48, 58))


def gram_keys(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased bytes and their texts. All that is not a letter counts as
    one blank; n-grams of two blanks in a row, or over the end of a text, are left out."""
    gap = (NOT_ALNUM | _DIGITS)[data]
    clean = np.where(gap, np.uint8(32), data)
    m = len(clean) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(m, np.uint64)
    for k in range(n):
        key |= clean[k : k + m].astype(np.uint64) << np.uint64(8 * k)
    twice = np.zeros(m, bool)
    for k in range(n - 1):
        twice |= gap[k : k + m] & gap[k + 1 : k + 1 + m]
    lasts = offsets[1:]
    for k in range(1, n):  # windows that begin in one text and end in the next
        at = lasts - k
        twice[at[(at >= 0) & (at < m)]] = True
    at = np.flatnonzero(~twice)
    return mix(key[at]), doc_of(at, offsets)


def _probes(keys: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    return [(keys >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1) for k in range(probes)]


def train(docs: DataFrame, most: int = TRAINING_DOCUMENTS, ngram: int = NGRAM, bits: int = SLOT_BITS, probes: int = PROBES) -> Filters:
    """Filters from rows with ``text`` and ``lang``; n-gram counts are summed by Spark."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.lower("text").alias("text"))
    rows = rows.join(F.broadcast(rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            keys, doc = gram_keys(data, offsets, ngram)
            langs, code = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            found = pd.DataFrame({"k": keys.view(np.int64), "c": code[doc]}).groupby(["c", "k"]).size()
            out = found.index.get_level_values(0), found.index.get_level_values(1)
            yield pa.RecordBatch.from_arrays([pa.array(langs[out[0]], pa.string()), pa.array(out[1].to_numpy(np.int64)), pa.array(found.to_numpy(np.int64))], ["lang", "key", "n"])

    counts = map_arrow(rows, count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if len(languages) > 64:
        raise ValueError("a slot holds the bits of at most 64 languages")
    slots, kept, seen = np.zeros(1 << bits, np.uint64), np.zeros(len(languages)), np.zeros(len(languages))
    if languages:
        rate = F.col("n") / F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])[F.col("lang")]
        top = counts.where(F.col("n") >= MIN_COUNT).withColumn("rate", rate)
        best = top.groupBy("key").agg(F.max("rate").alias("best"))
        typical = top.join(best, "key").where(F.col("rate") >= TYPICAL * F.col("best")).select("lang", "key")
        number = {x: np.uint64(k) for k, x in enumerate(languages)}
        # what arrives is bounded by the training rows; each partition's keys are set and dropped
        for part in typical.toArrow().to_batches():
            codes = np.array([number[x] for x in part.column("lang").to_pylist()], np.uint64)
            keys = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in _probes(keys, bits, probes):
                np.bitwise_or.at(slots, at.astype(np.int64), np.uint64(1) << codes)
    set_share = np.array([np.mean((slots >> np.uint64(k)) & np.uint64(1)) for k in range(len(languages))])
    return Filters(languages, slots, set_share**probes)


def identify(docs: DataFrame, filters: Filters, ngram: int = NGRAM, bits: int = SLOT_BITS, probes: int = PROBES) -> DataFrame:
    """All rows with ``lang_pred`` and ``score``, the winner's share of the corrected counts."""
    inner = docs.drop("lang_pred", "score").withColumns({
        "_l_text": F.lower(F.coalesce("text", F.lit(""))),
        "_l_letter": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)),
    })
    own = [f for f in inner.schema.fields if not f.name.startswith("_l_")]
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 bytes a slot

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, slots, false_rate = shared.value
        names = np.array([*languages, UNKNOWN], object)
        for batch, data, offsets in slices(batches, "_l_text"):
            keys, doc = gram_keys(data, offsets, ngram)
            masks = np.full(len(keys), ~np.uint64(0))
            for at in _probes(keys, bits, probes):
                masks &= slots[at.astype(np.int64)]
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            n = np.diff(bounds)
            hits = np.zeros((batch.num_rows, len(languages)))
            for k in range(len(languages)):
                ones = np.concatenate([[0], np.cumsum((masks >> np.uint64(k)) & np.uint64(1), dtype=np.int64)])
                hits[:, k] = ones[bounds[1:]] - ones[bounds[:-1]]
            real = np.maximum(hits - n[:, None] * false_rate, 0) / np.maximum(1 - false_rate, 1e-9)
            letter = batch.column("_l_letter").to_numpy(zero_copy_only=False).astype(bool)
            if languages:
                total = real.sum(1)
                best = real.argmax(1)
                share = np.where(total > 0, real.max(1) / np.maximum(total, 1e-9), 1 / len(languages))
            else:
                best, share = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            best, share = np.where(letter, best, -1), np.where(letter, share, 0.0)
            columns = [batch.column(f.name) for f in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(share, pa.float64())], [*[f.name for f in own], "lang_pred", "score"])

    return map_arrow(inner, score, T.StructType([*own, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def trained(spark, sf_dir: str) -> Filters:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return train(docs.where(~held_out()))


def stage(spark, docs: DataFrame, sf_dir: str, min_score: float = MIN_SCORE) -> DataFrame:
    """Drops texts of no known language: ``und``, or a best share below ``min_score``."""
    # every column under a name that can't clash; the text goes to the workers once beside its lowered form
    own = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"_own_{k}") for k, c in enumerate(own)])
    kept = identify(inner, trained(spark, sf_dir)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[F.col("text" if c == "text" else f"_own_{k}").alias(c) for k, c in enumerate(own)])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = identify(docs, trained(spark, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
