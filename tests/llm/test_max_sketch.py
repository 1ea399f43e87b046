"""Ranked search against brute force over all documents."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from chronoform.llm import max_sketch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """{item: [(score, id)]} by the formula, word for word."""
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, tf, _ in found for t in tf)
    of_item: dict = {}
    for i, t in items:
        of_item.setdefault(i, set()).update(terms(t))
    out = {}
    for item, query in of_item.items():
        scored = []
        for i, tf, n in found:
            m = 100 - 50 + 50 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in query if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out[item] = [(None if none else i, -s) for s, none, i in sorted(scored)[:k]]
    return {i: r for i, r in out.items() if r}


def ranked(found):
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: r.rank):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert len(out[r.item_id]) == r.rank
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)] + ["Über", "ÉTÉ", "日本"]
    docs = [(int(i) * 3, " ".join(rng.choice(words, int(n), p=None))) for i, n in enumerate(rng.integers(0, 60, 300))]
    docs += [(5000 + i, "w1 w2 copy copy") for i in range(200)]  # more copies than places
    docs += [(2**60 + 1, "w3 rare"), (2**60 + 3, "w3 rare"), (None, "rare rare"), (9001, None), (9002, " .,;"), (9003, "x" * 100_000), (5000, "w1 w2 copy copy")]
    items = [(int(i), " ".join(rng.choice(words, 12))) for i in range(20)] + [(100, "copy W1"), (101, "rare"), (102, None), (103, "unheard of"), (None, "w7 über"), (104, "w5"), (104, "w6 w5"), (100, "copy W1")]
    return docs, items


@pytest.mark.parametrize("width", [4, 64, 1024])
def test_rankings_are_those_of_all_documents(spark, corpus, width):
    """Whatever collides in the sketches; items in several blocks."""
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, term int").repartition(4)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    options = {} if width == 1024 else {"block_terms": 40, "block_items": 7}
    assert ranked(max_sketch.rank(d, b, k=50, width=width, **options)) == brute(docs, items, 50)


def test_bounds_let_most_documents_go(corpus):
    """A sketch never falls below the score, and only documents whose bound reaches what is kept are scored."""
    docs, items = corpus
    texts = [t or "" for _, t in docs]
    block = max_sketch.Queries([(i, t, 1 + len(t)) for i, text in items[:20] for t in sorted(set(terms(text)))], 64)
    impacts = max_sketch.Impacts(texts, block, len(texts), sum(len(terms(t)) for t in texts), 64, {})
    bounds = block.weights @ impacts.sketches.T
    for q, (own, weights) in enumerate(block.own):
        assert (bounds[q] >= impacts.exact[:, own] @ weights).all()


def test_no_documents_or_no_items(spark, corpus):
    docs, items = corpus
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert max_sketch.rank(d.where("false"), b).count() == 0
    assert max_sketch.rank(d, b.where("false")).count() == 0
    assert max_sketch.rank(d.where("doc_id = 9002"), b).columns == ["item_id", "rank", "doc_id", "score"]
