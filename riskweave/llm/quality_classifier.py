"""Quality classifier: logistic regression on hashed word n-grams, fitted with FTRL-proximal.

Features of a text are its words, pairs of neighbouring words, and the shapes of both
(which kinds of characters a word has), hashed into ``2 ** bits`` weights, each with value
1 / sqrt(number of features). A score is a sparse dot product through the logistic
function.

Null and empty texts have only the bias feature and get a score like any other. Rows are
scored one by one, so repeated rows get equal scores. With no labelled row all scores are
0.5. Contradicting labels of one document all count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import map_arrow, ship, slices, table, written
from .words import SPACE, find_words, mix, word_hashes

BITS = 18
#: The fit takes at most so many labelled rows, those with the smallest hashed ids.
TRAINING_ROWS = 16_000
SHARDS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0002, 0.0002

_KIND = np.zeros(256, np.uint64)  # bit of each kind of character
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _b >= 128 else 2 if _c.islower() else 4 if _c.isupper() else 8 if _c.isdigit() else 16 if _c in ".,;:?'\"()-" else 32 if _c == "!" else 64


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weight positions of all features and their bounds by text. Position 0 is the bias."""
    words = find_words(data, offsets, SPACE)
    hashes = word_hashes(data, words)
    n = len(hashes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
    if n:
        edges = np.stack([words.starts, words.ends], 1).ravel()
        kinds = np.bitwise_or.reduceat(np.append(_KIND[data], np.uint64(0)), edges)[::2]
    else:
        kinds = hashes
    shape = mix(kinds + np.uint64(1 << 32))
    joined = text[1:] == text[:-1]
    again = np.uint64(977)  # a pair of equal words is one feature, whichever word it is
    pair = np.where(hashes[1:] == hashes[:-1], again, hashes[:-1] * np.uint64(3) + hashes[1:])
    parts = [hashes, shape, mix(pair[joined]), mix(shape[:-1] * np.uint64(5) + shape[1:])[joined]]
    docs = [text, text, text[1:][joined], text[1:][joined]]
    place = np.concatenate([np.zeros(len(offsets) - 1, np.int64), *[(p % np.uint64((1 << bits) - 1) + np.uint64(1)).astype(np.int64) for p in parts]])
    of = np.concatenate([np.arange(len(offsets) - 1), *docs])
    order = np.argsort(of, kind="stable")
    return place[order], np.searchsorted(of[order], np.arange(len(offsets)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Per-coordinate FTRL-proximal over (positions, values, label); returns the weights."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    rng = np.random.default_rng(seed)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, value, label = examples[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(1 << bits))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, shards: int = SHARDS, bits: int = BITS) -> np.ndarray:
    """Weights averaged over ``shards`` fits, each on its own share of the labelled rows.

    ``labels`` has doc_id and quality. The rows are bounded by ``most`` before the join,
    so each shard's task is bounded too.
    """
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    marked = marked.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    ship(docs.sparkSession)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "quality"])
        examples = []
        batch = pa.RecordBatch.from_arrays([pa.array(part.text.fillna(""), pa.string()), pa.array(part.quality)], ["text", "quality"])
        for rows_of, data, offsets in slices([batch]):
            place, bounds = features(data, offsets, bits)
            for k, label in enumerate(rows_of.column("quality").to_pylist()):
                at, count = np.unique(place[bounds[k] : bounds[k + 1]], return_counts=True)
                examples.append((at, count / np.sqrt(max(1, count.sum())), int(label > 0)))
        w = ftrl(examples, bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at], "n": len(examples)})

    fitted = written(rows.groupBy("shard").applyInPandas(fit, "at long, w double, n long"), "classifier-shards")
    total = fitted.groupBy("at").agg(F.sum("w").alias("w")).toArrow()  # at most 2 ** bits rows
    weights = np.zeros(1 << bits)
    used = fitted.agg(F.max("n")).head()[0]
    if used:
        held = fitted.select("at").where("at = 0").count() or shards  # every shard has a bias
        weights[total.column("at").to_numpy()] = total.column("w").to_numpy() / held
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``score``, which replaces a column so named."""
    inner = docs.drop("score")
    own = [f for f in inner.schema.fields if f.name != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 4 bytes a weight

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch, data, offsets in slices(batches):
            place, bounds = features(data, offsets, bits)
            total = np.concatenate([[0.0], np.cumsum(w[place])])
            dot = (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(np.diff(bounds))
            value = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in own], pa.array(value)], [*[f.name for f in own], "score"])

    return map_arrow(inner, scored, T.StructType([*own, T.StructField("score", T.DoubleType())]))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, weights)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
