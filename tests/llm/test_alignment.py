"""Alignment against a token-by-token version with the vocabularies' own libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskweave.llm import alignment


def plain_groups(text, a, b, byte_of):
    if not text:
        return []
    want = (" " + text).encode()
    x = a.encode(" " + text, add_special_tokens=False)
    x = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in x.ids]
    y = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in y]
    if b"".join(t for _, t in x) != want or b"".join(t for _, t in y) != want:
        return []
    ends = []
    for side in (x, y):
        at, own = 0, {}
        for k, (_, t) in enumerate(side):
            at += len(t)
            own[at] = k
        ends.append(own)
    groups, last = [], (0, 0)
    for end in sorted(ends[0].keys() & ends[1].keys()):
        now = ends[0][end] + 1, ends[1][end] + 1
        groups.append(([i for i, _ in x[last[0] : now[0]]], [i for i, _ in y[last[1] : now[1]]]))
        last = now
    return groups


def plain(texts):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the byte-level alphabet
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    all_groups = [plain_groups(t, a, b, byte_of) for t in texts]
    counts = Counter((x[-1], y[-1]) for g in all_groups for x, y in g)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    rows = []
    for g in all_groups:
        links = [(x[-1], y[-1]) for x, y in g]
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else ""
        rows.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), digest))
    return rows, counts, all_groups


def corpus():
    words = "the cat sat on a mat naïve Übergröße don't 12,345 <s> </s> <|endoftext|> <0x41> 東京 привет \t\n  é ﬁ  x ▁y 🙂 HTTPServer internationalization".split(" ")
    random.seed(3)
    texts = [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(120)]
    return [None, "", " ", "  two  spaces ", "a", "▁", "\x00\x01", *texts, texts[0], "the cat " * 400]


@pytest.mark.parametrize("options", [{}, {"heavy": 3, "part": 7, "chunk": 40}])
def test_rows_equal_a_plain_version(frame, options):
    texts = corpus()
    docs = frame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, row string, groups string").repartition(3)
    found = alignment.align(docs, keep_groups=True, **options)
    want, counts, groups = plain(texts)
    got = {r["doc_id"]: r for r in found.documents.collect()}
    assert len(got) == len(texts)
    for k, row in enumerate(want):
        assert tuple(got[k][c] for c in ("n_a", "n_b", "n_groups", "n_groups", "n_best", "count_sum", "groups_sha256")) == row, texts[k]
        assert [(g["a"], g["b"]) for g in got[k]["groups"]] == groups[k]
    assert {(r["a"], r["b"]): r["count"] for r in found.pairs.collect()} == dict(counts)


def test_ids_may_be_null_or_repeated(frame, tmp_path):
    frame([(None, "one two"), (None, None), (4, "one two"), (4, "three")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op13_alignment(frame([]).sparkSession, str(tmp_path)).collect()
    want, *_ = plain(["one two", None, "one two", "three"])
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *w) for i, w in zip([None, None, 4, 4], want)), key=str)


def test_empty_table(frame, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op13_alignment(frame([]).sparkSession, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_parts_of_a_long_text_lose_nothing():
    text = "ab cd  ef\ngh ij kl mn op" * 50
    for size in (1, 5, 100, 10_000):
        assert " ".join(alignment._parts(text, size)) == text
