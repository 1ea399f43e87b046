"""A toxicity classifier whose score is held steady when identity terms are swapped (counterfactual logit pairing).

Logistic regression over the presence of words and word beginnings. For each labelled sentence with an identity term, a copy
with each other term of its group is made; the squared change of the logit between the two is added to the loss.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
PREFIX = 5
#: Terms that may stand for one another, by language and group; a parameter of the fit.
IDENTITY_TERMS = {
    "en": (
        ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("black", "white", "asian", "latino", "arab"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
        ("immigrants", "refugees", "foreigners", "locals"), ("disabled", "deaf", "blind"), ("old", "young", "elderly"),
    ),
    "de": (
        ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
        ("schwarze", "weiße", "asiaten", "araber"), ("schwule", "lesben", "bisexuelle"), ("einwanderer", "flüchtlinge", "ausländer", "einheimische"), ("behinderte", "gehörlose", "blinde"),
    ),
    "fr": (
        ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("noirs", "blancs", "asiatiques", "arabes"), ("homosexuels", "lesbiennes", "bisexuels"), ("immigrés", "réfugiés", "étrangers"), ("handicapés", "sourds", "aveugles"),
    ),
    "es": (
        ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("negros", "blancos", "asiáticos", "árabes"), ("homosexuales", "lesbianas", "bisexuales"), ("inmigrantes", "refugiados", "extranjeros"), ("discapacitados", "sordos", "ciegos"),
    ),
}


def others(groups: dict[str, tuple]) -> dict[str, list[str]]:
    """For each term the terms that may stand in its place: the others of its groups, in whatever language."""
    out: dict[str, list[str]] = {}
    for terms in (g for of_language in groups.values() for g in of_language):
        for t in terms:
            out[t] = list(dict.fromkeys([*out.get(t, []), *(x for x in terms if x != t)]))
    return out


def features(words: set[str]) -> set[int]:
    """32-bit hashes of the words and of the first letters of the longer ones."""
    return {zlib.crc32(w.encode("utf-8", "replace")) for w in words} | {zlib.crc32(b"^" + w[:PREFIX].encode("utf-8", "replace")) for w in words if len(w) > PREFIX}


def packed(found: set[int]) -> bytes:
    """Hashes as bytes, four each, in order."""
    return np.sort(np.fromiter(found, np.uint32, len(found))).tobytes()


def swaps(text: str, instead: dict[str, list[str]]) -> Iterator[tuple[set[int], set[int]]]:
    """For each identity term of each sentence and each term that may stand in its place, the sentence's features and those with the other term."""
    low = text.lower()
    if not any(t in low for t in instead):
        return
    for sentence in SENTENCE.split(low):
        words = set(WORD.findall(sentence))
        for term in sorted(w for w in words if w in instead):
            for other in instead[term]:
                yield features(words), features(words - {term} | {other})


class Scorer:
    """Weights by feature hash, and the score of a whole text."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def logit(self, words: set[str]) -> float:
        get = self.weights.get
        total = self.bias + sum(get(zlib.crc32(w.encode("utf-8", "replace")), 0.0) for w in words)
        return total + sum(get(zlib.crc32(b"^" + p.encode("utf-8", "replace")), 0.0) for p in {w[:PREFIX] for w in words if len(w) > PREFIX})

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(set(WORD.findall((text or "").lower()))), -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], swap_penalty: float, l1: float, rounds: int, min_docs: int, counts: np.ndarray | None = None) -> Scorer:
    """Weights that minimise mean log loss + l1 |w| + swap_penalty mean (change of logit by a swap)^2; counts: how often each pair occurs (once each if None).

    Accelerated proximal steps, each weight with its own step length (a diagonal bound of the curvature).
    """
    if not len(rows):
        return Scorer({}, 0.0)
    every, n_docs = np.unique(np.concatenate([*rows, np.empty(0, np.int64)]), return_counts=True)
    known = every[n_docs >= min_docs]
    n, m = len(rows), len(known)

    def sparse(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the known features."""
        flat, row = np.concatenate([*parts, np.empty(0, np.int64)]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.searchsorted(known, flat)
        on = at < m
        on[on] = known[at[on]] == flat[on]
        return row[on], at[on]

    row, col = sparse(rows)
    if pairs:
        (a, b), (c, d) = sparse([p for p, _ in pairs]), sparse([q for _, q in pairs])
        crow, ccol, sign = np.concatenate([a, c]), np.concatenate([b, d]), np.concatenate([np.ones(len(a)), -np.ones(len(c))])
    else:
        crow, ccol, sign = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    often = np.ones(len(pairs)) if counts is None else counts.astype(float)
    scale = swap_penalty / max(1.0, often.sum())
    width = np.bincount(row, minlength=n) + 1.0
    cwidth = np.bincount(crow, minlength=len(pairs))
    curve = 0.25 * np.bincount(col, width[row], m) / n + 2 * scale * np.bincount(ccol, (cwidth * often)[crow], m) + 1e-9
    curve0 = 0.25 * width.mean()
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    w, bias, v, vbias, t = np.zeros(m), np.log(share / (1 - share)), np.zeros(m), np.log(share / (1 - share)), 1.0
    for _ in range(rounds):
        z = np.bincount(row, v[col], n) + vbias
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        grad = np.bincount(col, r[row], m)
        if len(pairs):
            change = np.bincount(crow, sign * v[ccol], len(pairs))
            grad += 2 * scale * np.bincount(ccol, sign * (change * often)[crow], m)
        new = v - grad / curve
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0)
        new_bias = vbias - r.sum() / curve0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vbias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    on = np.flatnonzero(w)
    return Scorer(dict(zip(known[on].tolist(), w[on].tolist(), strict=True)), float(bias))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = 8000, groups: dict[str, tuple] = IDENTITY_TERMS, swap_penalty: float = 10.0, l1: float = 1e-4, rounds: int = 300, min_docs: int = 3, max_pairs: int = 50_000
) -> Scorer:
    """A scorer from about ``max_docs`` labelled whole texts, chosen by a hash of the id: the documented bound of the fit.

    Features are made by Spark; the driver gets their hashes, for ``max_docs`` documents, and of the swaps each distinct one once with its count: all of them, or
    the ``max_pairs`` of the least hash if there are more, some 400 bytes each. Rows without a label teach nothing; a null
    text is an empty one. No row: every score is 0.5. Where no labelled sentence has an identity term, there is nothing to swap and the loss is
    that of plain logistic regression.
    """
    labels = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"))
    n = labels.count()
    chosen = labels.where(F.xxhash64("id", F.lit("fit")) / F.lit(2.0**64) + 0.5 <= (max_docs / n if n else 1.0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select(F.col("id").cast("string").alias("id"), "text", "y")

    instead = others(groups)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"id": part.id, "y": part.y, "x": [packed(features(set(WORD.findall(t.lower())))) for t in part.text]})

    def swapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for t in part.text:
                found = [(packed(a), packed(b)) for a, b in swaps(t, instead)]
                if found:
                    yield pd.DataFrame(found, columns=["was", "now"])

    found = rows.mapInPandas(made, "id string, y double, x binary").toPandas().sort_values(["id", "y"], kind="stable")
    pairs = rows.select("text").mapInPandas(swapped, "was binary, now binary").groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))
    chosen_pairs = pairs.orderBy(F.xxhash64("was", "now"), "was", "now").limit(max_pairs).toPandas()
    array = lambda x: np.frombuffer(x, np.uint32).astype(np.int64)
    both = [(array(a), array(b)) for a, b in zip(chosen_pairs.was, chosen_pairs.now, strict=True)]
    return train([array(x) for x in found.x], found.y.to_numpy(float), both, swap_penalty, l1, rounds, min_docs, chosen_pairs.n.to_numpy(float))


def score(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text (0 to 1, higher: likelier toxic). Null and empty texts get the score of no words."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(out, scored(F.col(text)))
