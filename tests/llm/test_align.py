"""Alignment against a walk over both tokenizations, byte by byte."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from chronoform.llm import align

TEXTS = [
    "The quick brown fox, isn't it?", "Naïve café — “quotes” ½ 日本語 😀 text", "", None, "a", "  two  blanks", "tabs\tand\nlines\n\n", "<s> <|endoftext|> </s> <unk>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 200, "12345678901234567890",
    "The quick brown fox, isn't it?", "▁ odd", "ﬁ ligature and   blank", "word " * 500, " lead", "trail ", "\x00\x01 control", "日" * 300,
]


def walk(rows):
    """{row: (n_a, n_b, groups)} by the definition."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    table_a, table_b = align.byte_bpe_bytes(public_tokenizers.path("byte_bpe_50k.json")), align.piece_bytes(b)
    out = []
    for text in rows:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw = (" " + (text or "")).encode()
        if not text or b"".join(table_a[i] for i in ids_a) != raw or b"".join(table_b[i] for i in ids_b) != raw:
            out.append((0, 0, []))
            continue
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((table_a, ids_a), (table_b, ids_b))]
        cuts, groups = sorted(set(ends[0]) & set(ends[1])), []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(tuple([i for i, e in zip(ids, own, strict=True) if lo < e <= hi] for ids, own in zip((ids_a, ids_b), ends, strict=True)))
        out.append((len(ids_a), len(ids_b), groups))
    return out


def expected(rows):
    found = walk([t for _, t in rows])
    links = [Counter((x, y) for p, q in groups for x in p for y in q) for _, _, groups in found]
    docs = Counter(pair for own in links for pair in own)
    best: dict = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, _), (n_a, n_b, groups), own in zip(rows, found, links, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((i, n_a, n_b, len(groups), sum(own.values()), sum(n for p, n in own.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in own.items()), sha))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_alignment_is_that_of_a_walk(spark):
    """Null ids, ids beyond 2^53, repeated rows, texts that a side does not give back, columns of clashing names."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "some text"), (2**60 + 1, "more of it"), (0, TEXTS[0])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, a string, n_docs int").repartition(3)
    want = by_id(expected(rows))
    assert by_id([tuple(r) for r in align.alignment(df).collect()]) == want
    assert any(w[1] == 0 and t for w, (_, t) in zip(expected(rows), rows, strict=True))
    assert by_id([tuple(r) for r in align.alignment(df, max_broadcast_rows=0).collect()]) == want  # counts too many to broadcast


def test_large_groups_in_parts(monkeypatch):
    """A group of very many tokens on both sides is expanded some at a time."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 7, 200)
    group_a, group_b = np.sort(rng.integers(0, 3, 300)), np.sort(rng.integers(0, 3, 200))
    whole = align.linked_pairs(a, group_a, b, group_b, np.array([0, 0, 1]), 5, 7)
    monkeypatch.setattr(align, "PAIRS_AT_ONCE", 100)
    parts = align.linked_pairs(a, group_a, b, group_b, np.array([0, 0, 1]), 5, 7)
    want = Counter((int(g == 2), int(x), int(y)) for x, g in zip(a, group_a, strict=True) for y, h in zip(b, group_b, strict=True) if g == h)
    for found in (whole, parts):
        assert {(d, x, y): n for d, x, y, n in zip(*(c.tolist() for c in found), strict=True)} == want


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment(none).count() == 0
    assert [tuple(r)[1:] for r in align.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
