from __future__ import annotations

from collections import Counter

import pytest

from chronoform.llm import language

ENGLISH = ["the cat sat on the mat and the dog was there with them", "this is the house that they built on the hill"]
GERMAN = ["der hund und die katze sind nicht auf der strasse", "das ist ein haus und der mann ist nicht hier"]
SCHEMA = "doc_id long, text string, lang string"


def rows():
    return [(i, t, "en") for i, t in enumerate(ENGLISH * 5)] + [(100 + i, t, "de") for i, t in enumerate(GERMAN * 5)]


def brute(text: str, ranked: dict, size: int, n_max: int) -> str:
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for w in words:
        padded = f" {w} "
        for n in range(1, n_max + 1):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram.strip():
                    counts[gram] += 1
    return counts


def test_counts_match_brute_force():
    text = "Ab, ab! Ça va? 12 ab"
    got = language.grams(text, 3)
    decode = lambda c: "".join(chr(x) for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x)
    found = {decode(int(c)): int(n) for c, n in zip(*got, strict=True)}
    want = brute(text, {}, 0, 3)
    # words share the blank between them, which joins no n-gram across
    assert found == dict(want)


def ranked(counts, size):
    """Most frequent first, then by the n-gram as it is coded: its characters' code points, from the left, shorter ones as smaller numbers."""
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def brute_predict(text, profiles, size):
    """(language, score) by the definition: each n-gram of the text costs how far its rank is from that in the profile, or ``size`` if it is not there."""
    own = ranked(brute(text, {}, 0, 3), size)
    if not own:
        return "und", 0.0
    cost = {lang: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(cost), key=cost.get)
    return best, 1 - cost[best] / (size * len(own))


@pytest.mark.parametrize("size", [300, 25])
def test_predictions_match_brute_force_on_real_documents(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {}
    for r in rows:
        if r.lang and r.text:
            counts.setdefault(r.lang, Counter()).update(brute(r.text, {}, 0, 3))
    profiles = {lang: ranked(c, size) for lang, c in counts.items()}
    fitted = language.fit_profiles(docs, size=size)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, fitted).collect()}
    assert set(fitted.langs) == set(profiles)
    for r in rows[::2]:
        lang, score = brute_predict(r.text or "", profiles, size)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=1e-12)


def test_predicts_and_handles_odd_rows(spark):
    docs = spark.createDataFrame([*rows(), (200, None, None), (201, "", "en"), (202, "12 34 !!", "en"), (203, "the dog", None), (203, "the dog", None), (204, "und der mann ist nicht hier " * 20000, None)], SCHEMA)
    profiles = language.fit_profiles(docs)
    assert profiles.langs == ["de", "en"]
    found = {(r.doc_id, r.lang_pred): r.score for r in language.identify(docs, profiles).collect()}
    assert (200, "und") in found and (201, "und") in found and (202, "und") in found
    assert (203, "en") in found and (204, "de") in found
    assert all(0 <= s <= 1 for s in found.values()) and found[(200, "und")] == 0


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "x", 3.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    out = language.identify(docs, language.fit_profiles(docs))
    assert sorted(out.columns) == ["doc_id", "lang", "lang_pred", "score", "text"] and out.first().lang_pred == "en"
    empty = docs.where("false")
    assert language.identify(empty, language.fit_profiles(empty)).count() == 0
    assert language.identify(docs, language.fit_profiles(empty)).first().lang_pred == "und"


def test_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "aa bb", "b"), (2, "aa bb", "a")], SCHEMA)
    assert language.fit_profiles(docs).predict("aa bb")[0] == "a"
