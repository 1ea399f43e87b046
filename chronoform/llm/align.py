"""Alignment of two tokenizers' tokens over the bytes of the same texts, and how often their ids meet over a corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, hot_join, new_path
from .tokens import batches, byte_bpe, kept

#: Token pairs of groups that are expanded at a time.
PAIRS_AT_ONCE = 1 << 22


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_bpe_bytes(path: str) -> list[bytes]:
    tool, of = Tokenizer.from_file(path), byte_level()
    tokens = [tool.id_to_token(i) or "" for i in range(tool.get_vocab_size())]
    return [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    byte = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(m[1], 16)]) if (m := byte(p)) else p.replace("▁", " ").encode() for p in pieces]


def covering(ends_a: np.ndarray, sizes_a: np.ndarray, doc_a: np.ndarray, ends_b: np.ndarray, sizes_b: np.ndarray, doc_b: np.ndarray) -> pd.DataFrame:
    """(a, b): the places of all tokens of either side that overlap. Each token's start meets the other side's token that covers it, both ways; positions run on from document to document."""
    a = pd.DataFrame({"at": ends_a - sizes_a, "doc": doc_a, "a": np.arange(len(doc_a))})
    b = pd.DataFrame({"at": ends_b - sizes_b, "doc": doc_b, "b": np.arange(len(doc_b))})
    return pd.concat([pd.merge_asof(a, b, on="at", by="doc")[["a", "b"]], pd.merge_asof(b, a, on="at", by="doc")[["a", "b"]]])


def group_numbers(ends_a: np.ndarray, ends_b: np.ndarray, overlaps: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of either side, and how many there are: overlapping tokens that end alike end a group."""
    a, b = overlaps["a"].to_numpy(), overlaps["b"].to_numpy()
    both = ends_a[a] == ends_b[b]
    last_a, last_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    last_a[a[both]], last_b[b[both]] = True, True
    return np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b, int(last_a.sum())


def linked_pairs(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, doc_of_group: np.ndarray, most_a: int, most_b: int) -> tuple[np.ndarray, ...]:
    """(doc, a, b, n): how often each pair of ids is linked in each document, in order. Each A token meets the B tokens of its group, some at a time, and like pairs become one."""
    first, width = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, side="right")
    width -= first
    upto, at, keys, counts = np.cumsum(width), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    while at < len(ids_a):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        own = width[at:end]
        rows = np.repeat(np.arange(at, end), own)
        other = first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(own) - own, own)
        key, n = np.unique((doc_of_group[group_a[rows]] * most_a + ids_a[rows]) * most_b + ids_b[other], return_counts=True)
        if len(keys):
            key, place = np.unique(np.concatenate([keys, key]), return_inverse=True)
            n = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        keys, counts, at = key, n, end
    return keys // (most_a * most_b), keys // most_b % most_a, keys % most_b, counts


def groups_text(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, names: list[list[str]]) -> list[str]:
    """Each token as decimal with what parts it from the next, groups in order, A before B. names: of A and B ids, each followed by a comma, or by the mark of the side's last of a group."""
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    order = np.lexsort((np.concatenate([np.zeros(len(ids_a), np.int8), np.ones(len(ids_b), np.int8)]), np.concatenate([group_a, group_b])))
    at = np.concatenate([ids_a.astype(np.int64) * 2 + last_a, len(names[0]) + ids_b.astype(np.int64) * 2 + last_b])[order]
    every = names[0] + names[1]
    return list(map(every.__getitem__, at.tolist()))


FIELDS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<long>"


def sides(byte_bpe_path: str, piece_path: str) -> tuple:
    """Both tokenizers, the bytes of each side's ids, their lengths, and the ids as decimals with what may follow them."""
    model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    tables = byte_bpe_bytes(byte_bpe_path), piece_bytes(model)
    names = [[f"{i}{end}" for i in range(len(t)) for end in (",", mark)] for t, mark in zip(tables, "|;", strict=True)]
    return byte_bpe(byte_bpe_path, plain=True), model, tables, tuple(np.array([len(x) for x in t], np.int64) for t in tables), names


def aligned(docs: DataFrame, id_col: str, text: str, byte_bpe_path: str, piece_path: str) -> DataFrame:
    """A row a document: its counts, the hash of its groups and its distinct linked pairs of ids as arrays a, b, and n, how often."""

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, model, tables, lengths, names = kept(("align", byte_bpe_path, piece_path), lambda: sides(byte_bpe_path, piece_path))
        length_a, length_b = lengths
        for rows in parts:
            at = 0
            for texts in batches(rows.column("text"), 1 << 18):
                wanted = [" " + t for t in texts]
                ids_a, n_a = encode_a(wanted)
                found = model.encode(texts, num_threads=1)
                n_b = np.fromiter(map(len, found), np.int64, len(found))
                ids_b = np.fromiter((i for f in found for i in f), np.int64, int(n_b.sum()))
                sizes_a, sizes_b = length_a[ids_a], length_b[ids_b]
                # documents whose bytes are those of the text on both sides; an empty text has no tokens
                raw = [[b"".join(map(table.__getitem__, own.tolist())) for own in np.split(ids, np.cumsum(n)[:-1])] for table, ids, n in zip(tables, (ids_a, ids_b), (n_a, n_b), strict=True)]
                same = np.array([len(t) > 1 and t.encode() == x == y for t, x, y in zip(wanted, *raw, strict=True)], bool)
                keep_a, keep_b = np.repeat(same, n_a), np.repeat(same, n_b)
                ids_a, sizes_a, ids_b, sizes_b, n_a, n_b = ids_a[keep_a], sizes_a[keep_a], ids_b[keep_b], sizes_b[keep_b], n_a * same, n_b * same
                doc_a, doc_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
                ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
                group_a, group_b, n_groups = group_numbers(ends_a, ends_b, covering(ends_a, sizes_a, doc_a, ends_b, sizes_b, doc_b))
                doc_of_group = np.zeros(n_groups, np.int64)
                doc_of_group[group_a] = doc_a
                doc, *pairs = linked_pairs(ids_a.astype(np.int64), group_a, ids_b, group_b, doc_of_group, len(tables[0]), len(tables[1]))
                per_doc = np.bincount(doc_of_group, minlength=len(texts))
                links = np.zeros(len(texts), np.int64)
                np.add.at(links, doc, pairs[2])
                text_of = groups_text(ids_a, group_a, ids_b, group_b, names)
                upto = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
                digest = [hashlib.sha256("".join(text_of[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(upto, upto[1:], strict=False)]
                ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in zip(pairs, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
                columns = [rows.column("id").slice(at, len(texts)), n_a, n_b, per_doc, links, digest, *lists]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], schema=pa.schema(FIELDS))
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(align, SCHEMA)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): of how many documents hold each pair of ids linked, and whether no pair of its A id is held by more."""
    counts = found.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def alignment(docs: DataFrame, id_col: str = "doc_id", text: str = "text", byte_bpe_path: str | None = None, piece_path: str | None = None, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is byte_bpe_50k.json on a blank and the text, B piece_bpe_32k.model on the text, of public_tokenizers where no path is given. Tokens of both sides that end at
    one byte end a group; each A token of a group is linked to each B token of it. A pair's count is how many documents hold it linked; n_best counts the links
    whose count is the highest of their A id, count_sum sums the counts of the links. Null and empty texts, and texts that either side does not give back byte
    for byte, have no tokens: zeros and an empty hash. Repeated rows are documents each; ids are whole numbers of 64 bits or null.

    Texts are not shuffled: each is aligned where it is read, and what is written for the second reading are its distinct pairs. Counts are combined before
    their shuffle. They are broadcast if they are ``max_broadcast_rows`` rows (16 bytes each) or fewer, as the two vocabularies bound them to be in practice; beyond that the
    pairs that very many documents hold still are, and the others meet in a shuffle.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "aligned")
    default = public_tokenizers.path
    aligned(docs, id_col, text, byte_bpe_path or default("byte_bpe_50k.json"), piece_path or default("piece_bpe_32k.model")).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    found = spark.read.parquet(path)
    counts = cut(pair_counts(found))
    links = found.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", F.struct("p.a", "p.b").alias("pair"), F.col("p.n").alias("n"))
    lookup = counts.select(F.struct("a", "b").alias("pair"), "n_docs", "best")
    joined = links.join(F.broadcast(lookup), "pair") if counts.count() <= max_broadcast_rows else hot_join(links, lookup, "pair", "n_docs")
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
