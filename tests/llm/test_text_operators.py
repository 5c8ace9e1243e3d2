"""Quality rules, languages, quality scores, fingerprints: brute force and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskweave.llm import language_id, quality_classifier, quality_rules, simhash
from riskweave.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "b c d"), (5, "w\fx\x0by " * 3000), (6, "É ß 漢字 \n\n É ß 漢字")]


def facts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_facts_equal_brute_force(frame):
    rng = random.Random(1)
    rows = EDGES + [(100 + k, "".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "$", "\t"]) for _ in range(rng.randrange(200)))) for k in range(150)]
    docs = frame(rows)
    labels = docs.sparkSession.createDataFrame([(101, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs, labels)
    assert {"shard", "score"} <= set(out.columns)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = Counter((i, *f, f[0] < 50 or 100 * f[4] > 50 * f[0]) for i, t in rows for f in [facts(t)])
    assert got == want


def test_quality_rules_keep_target_like_texts_and_drop_others(frame):
    rng = random.Random(2)
    good = [(k, " ".join(rng.choice("the of and to in is was for".split()) + str(rng.randrange(9)) for _ in range(80))) for k in range(60)]
    junk = [(100 + k, " ".join(rng.choice("buy now $$$ click | free".split()) + str(rng.randrange(9)) for _ in range(80))) for k in range(60)]
    labels = frame(good).sparkSession.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.quality_rules(frame(good + junk), labels).where("kept").collect()}
    assert kept == {k for k, _ in good}


def test_empty_tables(frame, spark):
    none = frame([(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert language_id.identify(none, language_id.train(none.withColumn("lang", F.lit("en")))).count() == 0
    assert quality_classifier.score(none, quality_classifier.train(none, labels)).count() == 0
    assert simhash.fingerprint_groups(simhash.fingerprints(none)).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def test_languages(frame):
    rng = random.Random(3)
    vocabulary = {"en": "the house water thing wonder which".split(), "de": "das häuser wasser ding schön welche".split()}
    text = lambda lang: " ".join(rng.choice(vocabulary[lang]) for _ in range(30))
    schema = "doc_id long, text string, lang string"
    learned = frame([(k, text(x), x) for k, x in enumerate(["en", "de"] * 30)] + [(99, "only text", None), (98, None, "fr")], schema)
    filters = language_id.train(learned)
    assert filters.languages == ["de", "en"]
    asked = EDGES + [(200, text("en").upper()), (201, text("de")), (202, "123 456 !!")]
    got = Counter((r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in language_id.identify(frame(asked), filters).collect())
    for doc, lang in [(1, "und"), (2, "und"), (3, "und"), (200, "en"), (201, "de"), (202, "und")]:
        assert got[doc, lang, True] == 1
    assert sum(got.values()) == len(asked)


def test_classifier_learns_and_scores_every_row(frame, spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("clear plain good words" .split() if k % 3 else "spam!! $$$ |".split()) for _ in range(40))) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    weights = quality_classifier.train(frame(rows), labels)
    scores = [(r.doc_id, r.score) for r in quality_classifier.score(frame(rows + EDGES), weights).collect()]
    assert len(scores) == len(rows) + len(EDGES) and all(0 <= s <= 1 for _, s in scores)
    assert all((s >= 0.5) == (k % 3 > 0) for k, s in scores if k is not None and 200 <= k < 300)


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force(frame):
    got = Counter((r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(frame(EDGES)).collect())
    assert got == Counter((i, plain_fingerprint(t)) for i, t in EDGES)


def test_fingerprint_groups_find_every_link(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(60):  # families of chained and scattered neighbours
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            fps.append(at)
            for _ in range(rng.randrange(1, 5)):
                at ^= 1 << rng.randrange(64)
    prints = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in prints.join(simhash.fingerprint_groups(prints), "fp").collect()}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {k: find(k) for k in range(len(fps))}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.component for r in connected_components(edges).collect()} == {0, 100}


def test_near_duplicates_keep_one_of_a_group(frame):
    rng = random.Random(6)
    text = [f"word{rng.randrange(10**6)}" for _ in range(120)]
    edited = [*text[:60], "changed", *text[61:]]
    other = [f"other{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(1, " ".join(text)), (2, " ".join(edited)), (3, " ".join(text)), (3, " ".join(text)), (4, " ".join(other)), (5, None), (6, ""), (7, " ".join(text[:60] + other[60:]))]
    kept = simhash.stage(frame(rows).sparkSession, frame(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7]
    assert kept.columns == frame(rows).columns


def test_near_duplicates_equal_brute_force_in_families_around_the_threshold(frame):
    rng = random.Random(7)
    rows, word = [], lambda: f"w{rng.randrange(10**6)}"
    for _ in range(6):
        base = [word() for _ in range(200)]
        for _ in range(rng.choice([2, 15, 40])):
            text = list(base)
            for k in rng.sample(range(200), rng.randrange(1, 8)):
                text[k] = word()
            rows.append((len(rows), " ".join(text)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows)).collect()}
    assert [got[k] for k in range(len(rows))] == least


def test_near_duplicates_find_copies_with_a_repeated_passage(frame):
    rng = random.Random(8)
    rows, word = [], lambda: f"w{rng.randrange(10**6)}"
    for k in range(20):
        base, passage = [word() for _ in range(304)], [word() for _ in range(8)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + passage * 25))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows)).collect()}
    assert got == {k: k - k % 2 for k in range(40)}


def test_near_duplicates_keep_one_row_of_repeated_and_null_ids(frame):
    rng = random.Random(9)
    a, b, c, d, e = ([f"{x}{rng.randrange(10**6)}" for _ in range(120)] for x in "abcde")
    near = lambda words: " ".join([*words[:60], "changed", *words[61:]])
    a_, b_, c_, d_, e_ = map(" ".join, (a, b, c, d, e))
    rows = [(1, a_), (1, a_), (1, near(a)), (2, b_), (2, c_), (None, d_), (None, d_), (None, near(d)), (None, near(b)), (None, c_), (None, e_), (0, near(e))]
    kept = Counter((r.doc_id, r.text[0]) for r in simhash.stage(frame(rows).sparkSession, frame(rows), "").collect())
    assert kept == Counter([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (0, "e")])


def test_near_duplicates_without_a_common_lookup_key(frame):
    rng = random.Random(10)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    hashes, _ = simhash._shingles(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]), simhash.WORDS)
    edited = list(words)
    for k in np.argsort(hashes)[:16]:
        edited[k] = f"x{k}"
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame([(1, " ".join(words)), (2, " ".join(edited))])).collect()}
    assert got == {1: 1, 2: 1}


@pytest.mark.parametrize("searches", [("same_point_pairs", "segment_pairs", "hub_pairs"), ("same_point_pairs", "segment_pairs"), ("hub_pairs",)])
def test_near_duplicates_are_complete_without_the_first_searches(frame, monkeypatch, searches):
    for name in searches:
        monkeypatch.setattr(simhash, name, lambda rows, *_: rows.sparkSession.createDataFrame([], "a long, b long"))
    test_near_duplicates_equal_brute_force_in_families_around_the_threshold(frame)


def test_near_duplicates_do_not_pair_out_a_family_the_first_searches_left_apart(frame, monkeypatch):
    for name in ("same_point_pairs", "segment_pairs", "hub_pairs"):
        monkeypatch.setattr(simhash, name, lambda rows, *_: rows.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(simhash, "MET", 16, raising=False)
    seen, close_pairs = [], simhash.close_pairs
    monkeypatch.setattr(simhash, "close_pairs", lambda pairs, *a: seen.append(pairs.count()) or close_pairs(pairs, *a))
    rng, n = random.Random(12), 600
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(k, " ".join(f"x{k}" if at == k % 200 else w for at, w in enumerate(base))) for k in range(n)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows)).collect()}
    assert got == dict.fromkeys(range(n), 0)
    assert sum(seen) < n * (n - 1) / 4  # all pairs are twice as many


def test_parities_never_exceed_the_difference_of_sets():
    rng = np.random.default_rng(11)
    for n, m, shared in [(0, 0, 0), (0, 3, 0), (40, 30, 20), (500, 400, 400), (500, 130, 60), (5000, 4100, 4000)]:
        every = rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        x, y = every[:n], every[n - shared :]
        least = simhash._least_apart(*(np.frombuffer(simhash._parity(s), np.uint8) for s in (x, y)))
        assert (n + m - 2 * shared) % 2 == least % 2 and (n + m - 2 * shared) / 4 <= least <= n + m - 2 * shared


def test_language_stage_keeps_columns_of_clashing_names(spark, frame, tmp_path):
    rows = [(1, "plain words of a text", "en"), (2, None, None), (3, "plain words of a text", "en")]
    schema = "doc_id long, text string, lang string, score string, lang_pred string, row_of string"
    docs = spark.createDataFrame([(*r, "s", "p", "r") for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = language_id.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "plain words of a text", "en", "s", "p", "r"), (3, "plain words of a text", "en", "s", "p", "r")]
