"""Packing, decontamination, archives, shards, page text: round trips and brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskweave.llm import decontamination, html_text, packing, sharding, token_shards, tokens, warc
from riskweave.llm.common import scratch, written

EDGES = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "no id"), (4, "long text " * 3000), (5, "<|endoftext|> É漢")]


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        open_bins = [(r, k) for k, r in enumerate(bins) if r >= x]
        if open_bins:
            bins[min(open_bins)[1]] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(80))]
        used = defaultdict(list)
        for length, _, n, first, each, offset in packing.plan(dict(Counter(lengths)), capacity):
            for k in range(n):
                used[first + k // each].append((offset + k % each * length, length))
        left = []
        for places in used.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end += n
            left.append(capacity - end)
        assert sorted(left) == plain_best_fit(lengths, capacity)


def test_packing_places_every_piece(frame):
    got = packing.pack(written(packing.pieces(frame(EDGES)), "pieces")).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in EDGES)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        assert sum(n for _, n in own) <= 1024 and [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
    assert packing.pack(written(packing.pieces(frame(EDGES).limit(0)), "pieces")).count() == 0


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    rng = random.Random(2)
    texts = [t or "" for _, t in EDGES] + ["".join(rng.choice("ab É'sll 12\n\t  !?漢") for _ in range(60)) for _ in range(300)] + ["tail   ", "  \n  x  "]
    for text in texts:
        assert tokens.encode(text, tokens.default_path()).tolist() == plain.encode(text, add_special_tokens=False).ids + [2]


def test_decontamination_finds_copies_with_small_edits(frame, spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [[word() for _ in range(rng.randrange(14, 60))] for _ in range(30)]
    filler = lambda: [word() for _ in range(100)]
    edited = [*items[7]]
    edited[0] = "changed"
    rows = [
        (1, " ".join(filler() + items[3] + filler())), (2, " ".join(filler()).upper()), (3, " ".join(items[5]).upper() + "!"),
        (4, " ".join(filler() + edited + filler())), (5, " ".join(filler() + items[9][:7] + filler())), (6, None), (7, ""), (None, " ".join(items[1])),
    ]
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontamination.matches(frame(rows), benchmark).collect()) == Counter([(1, 3), (3, 5), (4, 7), (None, 1)])
    kept = decontamination.clean(frame(rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7] and kept.columns == frame(rows).columns
    assert decontamination.matches(frame(rows), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [3, 18])
def test_block_balls_return_all_within_the_radius(radius):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 16, 20).astype(np.uint16)
    near, owner = decontamination._balls(values, radius // decontamination.BLOCKS)
    found = set(zip(near.tolist(), owner.tolist()))
    for x in rng.integers(0, 1 << 16, 200).astype(np.uint16):
        for k, v in enumerate(values):
            assert ((int(x), k) in found) == (int(x ^ v).bit_count() <= radius // decontamination.BLOCKS)


def test_archives_round_trip(spark):
    rows = [(1, "u", "<p>a</p>"), (2, "u v", "<p>a</p>"), (3, None, None), (4, "x", ""), (5, "y", "é" * 50_000), (5, "y", "é" * 50_000), (None, "z", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch(spark, "warc")
    manifest = warc.write_archives(pages, folder, roll_bytes=200, shard_rows=3)
    assert manifest.count() > 2
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(manifest, folder).collect())
    assert got == Counter([(1, "revisit", 2, 8), (2, "response", None, 8), (None, "revisit", 2, 8), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 100_000), (5, "revisit", 5, 100_000)])
    again = scratch(spark, "warc")
    key = lambda m: sorted((r.file, r.sha1) for r in m.collect())
    assert key(manifest) == key(warc.write_archives(pages.repartition(5), again, roll_bytes=200, shard_rows=3))
    empty = scratch(spark, "warc")
    assert warc.read_archives(warc.write_archives(pages.limit(0), empty), empty).count() == 0


def test_sharding_table_is_even_and_stable(frame):
    owner = sharding.fill(sharding.shard_names(16), 2039)
    counts = Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(sharding.shard_names(15), 2039)
    assert np.mean([a != b for a, b in zip(owner, fewer) if a != 15]) < 0.25
    out = sharding.place(frame(EDGES)).collect()
    assert len(out) == len(EDGES) and len({r.shard for r in out if r.doc_id == 3}) == 1


@pytest.mark.parametrize("total", [1, 2, 3, 1000, 4097])
def test_permutation_is_one_to_one(total):
    places = token_shards.permuted(np.arange(total), total)
    assert sorted(places.tolist()) == list(range(total))
    assert total < 1000 or (places != token_shards.permuted(np.arange(total), total, key=5)).mean() > 0.9


def test_token_shards_round_trip_and_resume(frame, spark):
    table = token_shards.token_table(frame(EDGES), scratch(spark, "tokens"), 16, tokens.default_path())
    folder = scratch(spark, "shards")
    manifest = token_shards.write_shards(table, folder, stride=16, shard_rows=10)
    read = lambda start=0: token_shards.read_shards(manifest, folder, 16, 10, start).collect()
    rows = read()
    assert sorted(r.place for r in rows) == list(range(len(rows)))
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(i for i, _ in EDGES)
    assert sum(r.n_tokens for r in rows) == sum(len(tokens.encode(t, tokens.default_path())) for _, t in EDGES)
    assert sorted(read(25)) == sorted(r for r in rows if r.place >= 25)


def test_page_text():
    page = """<html><body class="sidebar-left"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies for very many things
    here</div><article><h1>Title</h1><p><b>One &amp; two<br>three<p>Four</p><aside><p>Aside text that is long enough to look like text.</p></aside>
    <script>var t="</p>";</script><div class="ad">Buy</div></article><section id="comments"><article><p>A reader says a lot of things here.</p></article></section>
    <form><p>Sign up</p></form><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == "Title\nOne & two three\nFour"
    assert html_text.main_text("") == "" and html_text.main_text("<p") == ""
    plain = "<div><a href=a>Home</a> <a href=b>News</a></div><div><p>" + "word " * 40 + "</p><p>Short one.</p><p>" + "more " * 40 + "</p></div>"
    assert html_text.main_text(plain) == " ".join(["word"] * 40) + "\nShort one.\n" + " ".join(["more"] * 40)


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<article>x"), (2, "v", ""), (2, "v", "")], "page_id long, url string, html string")
    assert Counter(tuple(r) for r in html_text.extract(pages).collect()) == Counter([(1, None, "", 0), (None, "u", "x", 1), (2, "v", "", 0), (2, "v", "", 0)])
