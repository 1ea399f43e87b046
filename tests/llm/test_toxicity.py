from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoform.llm import toxicity
from chronoform.llm.common import crc_mod
from chronoform.llm.queries import QUERIES

GROUPS = {"en": (("women", "men"),)}


def labelled(n=400):
    rng = np.random.default_rng(3)
    words, rows = ["tree", "house", "river", "stone", "cloud", "bread", "light", "green"], []
    for i in range(n):
        toxic = i % 4 == 0
        # in these data half of the toxic texts can be told by the term alone
        text = [*rng.choice(words, 8), "women" if i % 8 == 0 else "scum" if toxic else "calm"]
        rows.append((i, f"The {' '.join(text)}.", int(toxic)))
    return rows


def fitted(spark, penalty):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), groups=GROUPS, swap_penalty=penalty, min_docs=1)


def test_swaps_change_scores_less_under_the_penalty(spark):
    free, held = fitted(spark, 0.0), fitted(spark, 50.0)
    gap = lambda s: abs(s.logit({"women"}) - s.logit({"men"}))
    assert gap(free) > 0.2 and gap(held) < 0.1 * gap(free)
    assert abs(held.score("The women of the river") - held.score("The men of the river")) < 0.05
    assert held.score("The scum tree") > 0.5 > held.score("The calm tree")


def test_odd_rows(spark):
    scorer = fitted(spark, 1.0)
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "scum " * 50_000, 9.0), (3, "scum", 9.0), (3, "scum", 9.0)], "doc_id long, text string, score double")
    got = {(r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, scorer).collect()}
    assert len({s for i, s in got if i in (1, 2)}) == 1 and len({s for i, s in got if i == 3}) == 1
    assert all(0 <= s <= 1 for _, s in got)
    assert toxicity.score(docs.where("false"), scorer).count() == 0


def test_without_labels_every_score_is_a_half(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).first().score == 0.5


def test_every_other_term_of_a_group_is_tried():
    instead = toxicity.others({"en": (("a1", "b1", "c1"), ("x1", "y1")), "de": (("a1", "d1"),)})
    assert instead["a1"] == ["b1", "c1", "d1"] and instead["x1"] == ["y1"]
    found = list(toxicity.swaps("Say a1 now. Nothing. The x1 and y1!", instead))
    assert [toxicity.features({"say", t, "now"}) for t in ("b1", "c1", "d1")] == [b for _, b in found[:3]] and len(found) == 5
    assert all(len(g) == len(set(g)) for of in toxicity.IDENTITY_TERMS.values() for g in of)


def log_loss_and_slopes(rows, labels, pairs, weights, bias, penalty, l1):
    """The loss of the docstring, term by term, over dense vectors."""
    logit = lambda x: bias + sum(weights.get(int(i), 0.0) for i in x)
    loss = sum(np.log1p(np.exp(-logit(x) if y else logit(x))) for x, y in zip(rows, labels, strict=True)) / len(rows)
    return loss + l1 * sum(map(abs, weights.values())) + penalty * sum((logit(a) - logit(b)) ** 2 for a, b in pairs) / max(1, len(pairs))


@pytest.mark.parametrize("penalty", [0.0, 5.0])
def test_no_other_weights_have_a_smaller_loss(penalty):
    """Brute force: the written loss at the fitted weights against that at many others near and far."""
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(12) < 0.4) + 100 for _ in range(150)]
    labels = np.array([float(101 in x and rng.random() < 0.8 or rng.random() < 0.1) for x in rows])
    pairs = [(np.array([101, 103]), np.array([102, 103])), (np.array([101]), np.array([104]))]
    fit = toxicity.train(rows, labels, pairs, penalty, 1e-3, 3000, 1)
    least = log_loss_and_slopes(rows, labels, pairs, fit.weights, fit.bias, penalty, 1e-3)
    for _ in range(300):
        step = rng.choice([1e-3, 1e-2, 0.1, 1.0])
        other = {i: fit.weights.get(i, 0.0) + step * rng.normal() * (rng.random() < 0.5) for i in range(100, 112)}
        assert log_loss_and_slopes(rows, labels, pairs, other, fit.bias + step * rng.normal() * (rng.random() < 0.5), penalty, 1e-3) >= least - 1e-9


def test_the_penalty_lowers_false_positives_of_the_query(spark, tmp_path):
    """Groups are named in most toxic texts to learn from, so naming one is taken for toxic; the query must not."""
    rng = np.random.default_rng(5)
    neutral = "tree house river stone cloud bread light green table paper music garden".split()
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 3 == 0
        term = rng.choice(["women", "muslims", "immigrants"]) if rng.random() < (0.7 if toxic else 0.04) else ""
        rude = rng.choice(["scum", "filth", "vermin"]) if toxic and rng.random() < 0.6 else ""
        rows.append((i, f"The {' '.join(rng.choice(neutral, 8))} {term} {rude}."))
        labels.append((i, int(toxic)))
    mentions = [(10_000 + k, f"The {' '.join(rng.choice(neutral, 8))} {t}.") for k, t in enumerate(["women", "men", "muslims", "christians", "immigrants", "locals"] * 20)]
    spark.createDataFrame(rows + mentions, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, marks = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    plain = toxicity.score(docs, toxicity.fit(docs, marks.where(crc_mod(F.col("doc_id"), 5) != 0), swap_penalty=0.0))
    before = plain.where("doc_id >= 10000 and score >= 0.5").count()
    got = QUERIES["op4_toxicity"](spark, str(tmp_path)).toPandas()
    after = int(got[got.doc_id >= 10_000].predicted.sum())
    rude = [i for i, t in rows if any(w in t for w in ("scum", "filth", "vermin"))]
    assert before >= 50 and after <= before // 10
    assert got[got.doc_id.isin(rude)].predicted.mean() > 0.9
