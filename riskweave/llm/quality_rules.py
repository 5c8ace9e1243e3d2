"""Quality rules: counted facts of each text and a hashed n-gram likelihood ratio.

Only DataFrame functions run here. The ratio compares two multinomials over hashed word
unigrams and bigrams: one of trusted target documents, one of the whole raw corpus. A
document's score is the mean log ratio over its n-grams; it is kept if its counted facts
pass and its score reaches ``min_score``.

Null and empty texts have no words: all counts are zero and the base rules fail. Texts of
any length are counted whole. A row is judged by itself, so repeated rows get equal
verdicts; rows with a null id are judged too, but are never part of the target. Trusted ids
of equal hash are taken in order of id. With no target document every score is zero; an
empty table gives an empty result. Other columns are carried along; inner columns start
with ``_q_``, and columns of the documents with such names come out of the stage unharmed.
Repeated windows are told by hashes of at least 40 bits: two different windows of a text
that share one would count as repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .common import table

BUCKETS = 10_000
#: At most so many trusted documents make the target, those with the smallest hashed ids.
TARGET_DOCUMENTS = 20_000
#: Added to observed and expected counts of a bucket: a constant against chance in small corpora,
#: and a share of the target's mean count of a bucket, so that scores settle as a corpus grows.
PRIOR = 30.0
PRIOR_SHARE = 0.1
MIN_SCORE = -0.04
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_WORD = r"'[^\\x20\\x09-\\x0D]'"
#: The text with every white-space character of the word pattern as a space.
_SPACED = r"replace(replace(replace(replace(replace(_q_t, '\n', ' '), '\t', ' '), '\r', ' '), '\u000B', ' '), '\u000C', ' ')"


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``_q_t``, the text without null, ``_q_w``, its words, ``_q_h``, their hashes,
    ``_q_d``, hashes of word pairs, and ``_q_b``, the bits that a position takes.

    ``inline`` of one row computes the arrays once; a projection could be merged into
    each of its many uses.
    """
    docs = docs.withColumn("_q_t", F.coalesce("text", F.lit("")))
    docs = docs.select("*", F.inline(F.expr(f"array(named_struct('_q_w', array_remove(split({_SPACED}, ' '), '')))")))
    docs = docs.select("*", F.inline(F.expr("array(named_struct('_q_h', transform(_q_w, x -> xxhash64(x)), '_q_b', length(bin(size(_q_w)))))")))
    pairs = "slice(zip_with(_q_h, slice(_q_h, 2, size(_q_h)), (x, y) -> xxhash64(x, y)), 1, greatest(size(_q_h) - 1, 0))"
    return docs.select("*", F.inline(F.expr(f"array(named_struct('_q_d', {pairs}))")))


def with_facts(docs: DataFrame) -> DataFrame:
    """Adds the five counted facts. Needs the columns of ``with_words``.

    Repeated windows are found by sorting (hash, position) packed into one number: the
    position takes as many low bits as the text needs, the hash keeps the rest (at
    least 40 bits for texts below 16 million words).
    """
    lines = f"filter(split(_q_t, '\\n'), x -> x RLIKE {_WORD})"
    windows = "slice(zip_with(_q_d, slice(_q_h, 3, size(_q_h)), (x, y) -> xxhash64(x, y)), 1, greatest(size(_q_h) - 2, 0))"
    packed = f"transform({windows}, (x, i) -> shiftleft(x, _q_b) | cast(i AS bigint))"
    docs = docs.select("*", F.inline(F.expr(f"""array(named_struct(
        '_q_l', {lines},
        '_q_s', sort_array({packed})))""")))
    same = "coalesce(shiftrightunsigned(x, _q_b) = shiftrightunsigned(get(_q_s, i {}), _q_b), false)"
    twice = f"""CASE WHEN size(filter(_q_s, (x, i) -> {same.format('+ 1')})) = 0 THEN cast(array() AS array<bigint>)
        ELSE filter(_q_s, (x, i) -> {same.format('+ 1')} OR {same.format('- 1')}) END"""
    docs = docs.select("*", F.inline(F.expr(f"array(named_struct('_q_p', sort_array(transform({twice}, x -> x & (shiftleft(1L, _q_b) - 1)))))")))
    covered = "transform(_q_p, (x, i) -> least(3L, coalesce(get(_q_p, i + 1), x + 3) - x))"
    return docs.withColumns({
        "n_words": F.size("_q_w").cast("long"),
        "word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_q_t", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"),
        "n_repeat_words": F.expr(f"aggregate({covered}, 0L, (a, x) -> a + x)"),
    }).drop("_q_l", "_q_s", "_q_p")


def trusted_ids(labels: DataFrame, most: int = TARGET_DOCUMENTS) -> DataFrame:
    """Ids labelled as of good quality: all, or the ``most`` with the smallest hashes."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_q_id")).distinct()
    return good.orderBy(F.xxhash64("_q_id"), "_q_id").limit(most)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target count / count expected from the raw share) of each bucket, both with
    ``PRIOR`` and ``PRIOR_SHARE`` of the mean added, so that a bucket seen rarely says little.

    All documents are counted; what reaches the driver is one row per bucket.
    ``trusted`` is bounded by ``trusted_ids`` and therefore broadcast.
    """
    marked = with_words(docs.select("doc_id", "text")).join(F.broadcast(trusted), F.col("doc_id") == F.col("_q_id"), "left")
    grams = marked.select(F.col("_q_id").isNotNull().cast("long").alias("t"), F.explode(F.concat("_q_h", "_q_d")).alias("x"))
    grams = grams.select("t", F.pmod("x", F.lit(buckets)).alias("g"))
    counts = {r.g: (r.raw, r.target) for r in grams.groupBy("g").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()}
    raw, target = sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values())
    if not target:
        return [0.0] * buckets
    prior = PRIOR + PRIOR_SHARE * target / buckets
    ratio = {g: math.log((t + prior) / (r * target / raw + prior)) for g, (r, t) in counts.items()}
    return [ratio.get(g, 0.0) for g in range(buckets)]


def judged(docs: DataFrame, ratios: list[float], min_score: float = MIN_SCORE, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Adds the facts, ``quality_score``, ``base_failed`` and ``kept`` to every row."""
    table_of = f"cast(split('{','.join(f'{x:.9g}' for x in ratios)}', ',') AS array<double>)"
    docs = with_facts(with_words(docs))
    total = F.expr(f"aggregate(concat(_q_h, _q_d), 0D, (a, x) -> a + get({table_of}, cast(pmod(x, {len(ratios)}) AS int)))")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return docs.withColumns({
        "quality_score": total / F.greatest(F.size("_q_h") + F.size("_q_d"), F.lit(1)),
        "base_failed": failed,
    }).withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= min_score)).drop("_q_t", "_q_w", "_q_h", "_q_b", "_q_d")


def quality_rules(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    return judged(docs, log_ratios(docs, trusted_ids(labels)), **limits)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns they came with."""
    own = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_q_row"), "doc_id", "text")
    kept = quality_rules(inner, table(spark, sf_dir, "labels")).where("kept")
    return kept.select("_q_row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *FACTS, "base_failed", "kept", "quality_score")
