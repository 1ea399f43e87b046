from __future__ import annotations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from chronoform.llm import simhash
from chronoform.llm.graph import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "one", "one two three", "One two THREE four", "É é a b c d e f g", "a b c d " * 500, "x y z\x0bw v u"])
def test_fingerprints(text):
    assert simhash.fingerprint_of(text) == brute_fingerprint(text)


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            b ^= 1 << int(bit)
        rows, keys = simhash.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def components(ids, fps):
    label = {i: {i} for i in range(len(fps))}
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and label[i] is not label[j]:
                joined = label[i] | label[j]
                for k in joined:
                    label[k] = joined
    return [min(ids[k] for k in label[i]) for i in range(len(fps))]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_match_brute_force(spark, chunk):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for _ in range(200):
        x = fps[int(rng.integers(0, len(fps)))]
        for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(bit)
        fps.append(x)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), chunk)
    found = {r.id: r.component for r in connected_components(edges).collect()}
    want = components(signed, fps)
    assert [found.get(x, x) for x in signed] == want


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark wood " * 12
    rows = [(5, base), (3, base), (9, base + "extra"), (1, "something else entirely different from all of it"), (2, None), (4, ""), (7, " "), (3, base), (None, base), (11, "z " * 100_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    got = simhash.components(df).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, r.component_id) for r in got}
    assert {(5, 3), (3, 3), (None, 3), (2, 2), (4, 2), (7, 2), (1, 1), (11, 11)} <= found
    ids, fps = [i if i is not None else 10**9 for i, _ in rows], [brute_fingerprint(t) for _, t in rows]
    assert sorted((i if i != 10**9 else -1, c) for i, c in zip(ids, components(ids, fps), strict=True)) == sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got)
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == sorted([-1, 3, 3, 1, 2, 11] + ([9] if (9, 9) in found else []))
    assert simhash.components(df.where("false")).count() == 0


def test_rows_of_one_id_are_told_apart_by_text(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(80)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (None, b), (None, c), (None, c), (7, None), (7, ""), (9, None)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    shown = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert shown(simhash.keep_one(df)) == sorted([(1, a), (2, b), (2, b), (None, b), (None, c), (None, c), (7, None), (7, "")], key=str)
    got = shown(simhash.keep_one(df, repeats=False))
    assert [x for x in got if x[1]] == sorted([(1, a), (2, b), (None, c)], key=str) and [x[0] for x in got if not x[1]] == [7]
    assert shown(simhash.keep_one(df.repartition(3), repeats=False)) == got
    stage = corpus_pipeline.drop_near_duplicates(spark, df.selectExpr("doc_id", "text", "'en' as lang", "source", "1L as n_chars"), "")
    assert shown(stage) == got


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)] + [(500, 501), (501, 500)]])
def test_connected_components(spark, edges):
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            group = label.get(a, {a}) | label.get(b, {b})
            for k in group:
                label[k] = group
    assert found == {k: min(g) for k, g in label.items()}
