"""Decontamination: all windows of all items by brute force, and groups of any size."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from riskweave.llm import decontamination


def shingles(words):
    return [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []


def plain_matches(rows, items):
    """(doc, item) where a window of the item's size has a weighted similarity of 0.8 or more."""
    cut = lambda text: re.findall(r"[^\W_]+", (text or "").lower())
    of = [(i, shingles(cut(t))) for i, t in items if t is not None]
    held = Counter(s for _, own in of for s in set(own))
    weight = lambda s: math.log1p(len(of) / held[s]) if s in held else math.log1p(len(of))
    found = Counter()
    for doc, text in rows:
        whole = shingles(cut(text))
        for item, own in of:
            if not own or not set(own) & set(whole):
                continue
            n, own, best = min(len(own), len(whole)), Counter(own), 0.0
            for k in range(len(whole) - n + 1):
                window = Counter(whole[k : k + n])
                both = own.keys() | window.keys()
                best = max(best, sum(weight(s) * min(own[s], window[s]) for s in both) / sum(weight(s) * max(own[s], window[s]) for s in both))
            if best >= 0.8:
                found[doc, item] += 1
    return found


def family(rng):
    """Items with one opening in common, documents that hold them with a few changed words."""
    word = lambda: f"w{rng.randrange(10**6)}"
    opening = [word() for _ in range(14)]
    items = [(k, " ".join(opening + [word() for _ in range(rng.choice([20, 46]))])) for k in range(40)] + [(40, "short item"), (41, None), (42, ""), (3, None)]
    rows = []
    for k in range(120):
        own = items[rng.randrange(40)][1].split()
        for at in rng.sample(range(len(own)), rng.choice([0, 1, 1, 2])):
            own[at] = "changed"
        rows.append((k, " ".join([word() for _ in range(rng.randrange(40))] + own + [word() for _ in range(rng.randrange(40))])))
    return rows + [(200, None), (200, ""), (201, rows[0][1]), (201, rows[0][1]), (202, "a short item here"), (203, "Short, ITEM!")], items


def test_matches_equal_brute_force_over_all_windows(frame, spark):
    rows, items = family(random.Random(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontamination.matches(frame(rows), benchmark).collect())
    want = plain_matches(rows, items)
    assert sum(want.values()) > 50 and got == want


def test_results_do_not_depend_on_the_size_of_groups(frame, spark):
    rows, items = family(random.Random(2))
    benchmark = spark.createDataFrame(items + items[:1], "item_id long, text string")
    found = [sorted(map(tuple, decontamination.matches(frame(rows[:40]), benchmark, most_items=n).collect())) for n in (1_000, 7)]
    assert found[0] and found[0] == found[1]
    shuffled = sorted(map(tuple, decontamination.matches(frame(rows[:40]), benchmark, most=200).collect()))
    assert shuffled == found[0]


def test_very_long_and_repeated_rows(frame, spark):
    rng = random.Random(3)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    long = "filler " * 400_000 + item
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, long), (1, long), (2, "filler " * 400_000)]
    assert Counter(r.doc_id for r in decontamination.matches(frame(rows), benchmark).collect()) == Counter({1: 2})
    assert [r.doc_id for r in decontamination.clean(frame(rows), benchmark).collect()] == [2]
