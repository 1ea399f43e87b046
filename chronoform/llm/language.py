"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SHIFT = 21  # bits of a code point


class Letters:
    """Which code points are letters; filled once a Python worker."""

    known: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls.known is None:
            cls.known = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.known


def grams(text: str | None, n_max: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to n_max (3 at most) characters of the lower-cased words, as integers, and how often each occurs.

    Whatever is no letter separates words; a word carries one blank at either side, and a lone blank is no n-gram.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = Letters.table()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.concatenate([[32], np.where(letter, points, 32), [32]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    found = [points[points != 32]]
    if n_max >= 2:
        found.append(points[:-1] << SHIFT | points[1:])
    if n_max >= 3:
        three = found[1][:-1] << SHIFT | points[2:]
        found.append(three[points[1:-1] != 32])
    return np.unique(np.concatenate(found), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first; the smaller code first among equals."""
    if len(codes) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:k]


class Profiles:
    """Ranked n-grams of each language, and the out-of-place distance of a text to each."""

    def __init__(self, ranked: dict[str, list[int]], size: int, n_max: int):
        self.langs, self.size, self.n_max = sorted(ranked), size, n_max
        self.codes = np.unique(np.array([c for x in ranked.values() for c in x], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(ranked[lang], np.int64)), j] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first by name among equals) and how near it is: 1 at distance 0, 0 with no n-gram in common."""
        own = top(*grams(text, self.n_max), self.size)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        rank = self.rank[at]
        out = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        best = int(out.argmin())
        return self.langs[best], float(1 - out[best] / (self.size * len(own)))


def fit_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = 300, n_max: int = 3, docs_per_lang: int = 1000, id_col: str = "doc_id") -> Profiles:
    """Profiles from about ``docs_per_lang`` whole texts of each language, chosen by a hash of the id.

    The number of documents is the documented bound of the fit. Rows without a language or text teach nothing; no row: no
    language. Counts are summed by Spark; only ``size`` n-grams of each language reach the driver.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not rows:
        return Profiles({}, size, n_max)
    share = F.create_map(*[x for k, n in rows.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))])
    chosen = labelled.where((F.xxhash64(id_col, F.lit("fit")) / F.lit(2.0**64) + 0.5) <= share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found: dict[str, list] = {}
            for name, text in zip(rows.column(0), rows.column(1), strict=True):
                found.setdefault(name.as_py(), []).append(grams(text.as_py(), n_max))
            for name, both in found.items():
                codes, at = np.unique(np.concatenate([c for c, _ in both]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in both]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n)], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    ranked = {}
    for name in rows:
        ranked[name] = [r.gram for r in counts.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(size).collect()]
    counts.unpersist()
    return Profiles({k: v for k, v in ranked.items() if v}, size, n_max)


def predictor(profiles: Profiles) -> Callable[[Column], Column]:
    """A column function: struct<lang_pred, score> of a text."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang_pred", "score"])

    return predict.asNondeterministic()  # so that a filter on the prediction does not make it twice


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. Null text or text without a letter: ``und``, 0. Columns of these names are replaced.

    Rows stay where they are: no shuffle, one text in memory at a time besides the Arrow batch.
    """
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select("*", predictor(profiles)(F.col(text)).alias("__cf_lang")).select(*[F.col(f"`{c}`") for c in rest], "__cf_lang.lang_pred", "__cf_lang.score")


#: Nearness below which a text is in none of the learned languages. Alphabets that were not learned score 0, letter junk some 0.15;
#: on documents the least of any real text is 0.38, single words included.
LEAST_SCORE = 0.25


def recognised(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose text is in a learned language, with the columns that they came with; a null lang is filled with the prediction.

    Null texts, texts without a letter and texts farther from every profile than ``least`` go. Without any profile there is
    nothing to tell texts by: every text with a letter stays.
    """
    if not profiles.langs:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    named = docs.select("*", predictor(profiles)(F.col(text)).alias("__cf_lang")).where((F.col("__cf_lang.lang_pred") != "und") & (F.col("__cf_lang.score") >= least))
    return named.select(*[(F.coalesce(F.col(f"`{c}`"), "__cf_lang.lang_pred") if c == lang else F.col(f"`{c}`")).alias(c) for c in docs.columns])
