"""Ranked lexical search by hashed max-sketches.

A document's sketch has a place for each hash of a term and holds the greatest impact of the terms that hash there, so for any query the sum of weight times
place is at least its score. Many documents' sketches make a matrix, many queries' weights another, and their product bounds all scores at once. Exact scores
are taken in descending order of the bounds until the bound is below what is kept.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, cut

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPLIT = re.compile(TERM).findall
UPPER = {i: i + 32 for i in range(65, 91)}


def terms_of(text: Column) -> Column:
    """The terms of a text in order; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAKS), ""), F.array().cast("array<string>"))


def item_terms(items: DataFrame, item_col: str, text: str) -> DataFrame:
    """(item, query, term): each distinct term of each item once, ``query`` numbering the items."""
    terms = cut(items.select(F.col(item_col).alias("item"), F.explode(terms_of(F.col(text))).alias("term")).distinct())
    number = terms.select("item").distinct().withColumn("query", F.row_number().over(Window.orderBy("item")).cast("long"))  # a row an item
    return terms.alias("t").join(number.alias("n"), F.expr("t.item <=> n.item")).select("t.item", "query", "term")


def corpus_counts(docs: DataFrame, terms: DataFrame, text: str, max_broadcast_rows: int) -> tuple[int, int, DataFrame]:
    """(N, L, (term, df) of the given distinct terms), over all documents in one pass."""
    words = docs.select(terms_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    each = words.select(F.size("w").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("term"))  # "" stands for the document
    each = each.withColumn("n", F.when(F.col("term") == "", F.col("n")))
    wanted = cut(terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string")))
    found = cut(each.join(bounded(wanted, wanted.count(), max_broadcast_rows), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")))
    whole = found.where("term = ''").first()
    return (whole["df"], whole["total"], found.where("term <> ''").select("term", "df")) if whole else (0, 0, found.select("term", "df"))


def weighted(queries: DataFrame, n: int, counts: DataFrame) -> DataFrame:
    """queries with w, the weight of each term that a document holds."""
    w = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return queries.join(counts, "term").withColumn("w", w).where("w > 0").drop("df")


class Queries:
    """A block of queries as arrays: the weights of each by place of the sketch, and its terms' numbers and weights."""

    def __init__(self, rows: list[tuple[int, str, int]], width: int):
        self.names = sorted({q for q, _, _ in rows})
        number = {q: i for i, q in enumerate(self.names)}
        self.terms = {t: i for i, t in enumerate(sorted({t for _, t, _ in rows}))}
        self.weights = np.zeros((len(self.names), width))
        own: list[list[tuple[int, int]]] = [[] for _ in self.names]
        for q, t, w in rows:
            self.weights[number[q], xxhash.xxh64_intdigest(t, 0) % width] += w
            own[number[q]].append((self.terms[t], w))
        self.own = [(np.array([t for t, _ in x]), np.array([w for _, w in x], dtype=np.int64)) for x in own]


class Impacts:
    """Impacts of the terms of some documents: their sketches, and those of a block's terms exactly."""

    def __init__(self, texts: list[str], block: Queries, n_docs: int, n_terms: int, width: int, places: dict[str, int]):
        found = [SPLIT(t.lower() if t.isascii() else t.translate(UPPER)) for t in texts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        codes, names = pd.factorize(np.array(list(itertools.chain.from_iterable(found)), dtype=object))
        for t in names:
            if t not in places:
                places[t] = xxhash.xxh64_intdigest(t, 0) % width
        most = max(1, len(names))
        key, tf = np.unique(np.repeat(np.arange(len(found)), lengths) * most + codes, return_counts=True)
        doc, code = key // most, key % most
        m = 100 - 50 + 50 * lengths * n_docs // n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        self.sketches = np.zeros((len(found), width))
        np.maximum.at(self.sketches, (doc, np.fromiter((places[t] for t in names), np.int64, len(names))[code]), impact)
        number = np.fromiter((block.terms.get(t, -1) for t in names), np.int64, len(names))[code]
        own = number >= 0
        self.exact = np.zeros((len(found), len(block.terms)), np.int32)
        self.exact[doc[own], number[own]] = impact[own]


def groups_of(texts: list[str], most_docs: int, most_chars: int = 4 << 20) -> Iterator[slice]:
    """Slices of texts in order, each of so many documents and characters at most, or of one document."""
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and upto - at < most_docs and size + len(texts[upto]) <= most_chars:
            size += len(texts[upto])
            upto += 1
        yield slice(at, upto)
        at = upto


def best_of(rows: Iterator[pa.RecordBatch], block: Queries, n_docs: int, n_terms: int, k: int, width: int) -> Iterator[pa.RecordBatch]:
    """(query, doc_id, score): of each query the k best documents of a task, the smallest ids among equals."""
    places: dict[str, int] = {}
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in block.names]  # scores, ids, which ids are null
    least = np.ones(len(block.names), np.int64)
    for part in rows:
        ids, missing = part.column("id").fill_null(0).to_numpy(zero_copy_only=False), part.column("id").is_null().to_numpy(zero_copy_only=False)
        texts = part.column("text").to_pylist()
        for own in groups_of(texts, max(1, min(1024, (1 << 24) // len(block.terms)))):
            if len(places) > 1_000_000:
                places.clear()
            impacts = Impacts(texts[own], block, n_docs, n_terms, width, places)
            bounds = block.weights @ impacts.sketches.T  # whole numbers below 2 to the 53rd, so exact
            for q, (terms, weights) in enumerate(block.own):
                order = np.flatnonzero(bounds[q] >= least[q])
                order = order[np.argsort(-bounds[q][order], kind="stable")]
                for i in range(0, len(order), 64):  # exact scores, 64 at a time, while the bounds reach what is kept
                    near = order[i : i + 64]
                    near = near[bounds[q][near] >= least[q]]
                    if not len(near):
                        break
                    score = impacts.exact[near][:, terms] @ weights
                    near, score = near[score >= least[q]], score[score >= least[q]]
                    scores, names, nulls = (np.concatenate(x) for x in zip(kept[q], (score, ids[own][near], missing[own][near]), strict=True))
                    if len(scores) > k:
                        best = np.lexsort((names, nulls, -scores))[:k]
                        scores, names, nulls = scores[best], names[best], nulls[best]
                        least[q] = scores[-1]
                    kept[q] = (scores, names, nulls)
    for q, (scores, names, nulls) in zip(block.names, kept, strict=True):
        if len(scores):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q), pa.int64()), pa.array(names, pa.int64(), mask=nulls), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])


def rank(
    docs: DataFrame, items: DataFrame, k: int = 50, width: int = 1024, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    block_terms: int = 10_000, block_items: int = 1_000, max_broadcast_rows: int = 500_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of the highest scores above 0, equal scores by ascending doc_id, rows without an id last.

    Null, empty and wordless texts have no term: they match nothing and count for nothing. Each row of docs is a document, repeated ones too. Rows of
    one item_id are one item with the terms of all; a null item_id is an item. No documents or no items: no rows. Ids of documents are whole numbers of 64 bits.

    Documents are read twice, for the counts and for the ranking, and never shuffled; a task keeps k documents an item, however many copies there are.
    Items go to the tasks in blocks of ``block_items`` items and ``block_terms`` terms, or of a single item; each block is one pass. Sketches live as long as their batch.
    """
    queries = cut(item_terms(items, item_col, item_text))
    n, total, counts = corpus_counts(docs, queries.select("term").distinct(), text, max_broadcast_rows)
    weights = cut(weighted(queries, n, counts))
    running = Window.orderBy("query")
    sizes = weights.groupBy("query").agg(F.count(F.lit(1)).alias("n"))  # a row an item
    sizes = sizes.select("query", F.greatest(F.floor(F.sum("n").over(running) / block_terms), F.floor(F.row_number().over(running) / block_items)).alias("block"))
    placed = cut(weights.select("query", "term", "w").join(sizes, "query"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = docs.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    for (number,) in placed.select("block").distinct().orderBy("block").collect():
        block = Queries([tuple(r) for r in placed.where(F.col("block") == number).select("query", "term", "w").collect()], width)

        def search(parts: Iterator[pa.RecordBatch], block: Queries = block) -> Iterator[pa.RecordBatch]:
            return best_of(parts, block, n, total, k, width)

        found = found.unionByName(rows.mapInArrow(search, "query long, doc_id long, score long"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("query", "item").distinct(), "query").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
