"""Files of token ids, documents in ascending order of id, coded by :mod:`range_coder`.

A file is one row of a Parquet table, so Spark writes, retries and reads it on any store: a head, the documents' ids and lengths, then the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import bounded, cut
from .tokens import batches, byte_bpe, kept

MAGIC = b"CFTOKEN1"
HEAD, HEAD_BYTES = "<8sQQQI", 36  # magic, documents, ids, bytes of the document list, its crc32


def packed(doc_ids: np.ndarray, missing: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file."""
    docs = zstandard.compress(np.diff(doc_ids, prepend=np.int64(0)).astype("<i8").tobytes() + np.packbits(missing).tobytes() + sizes.astype("<i8").tobytes(), 3)
    blocks = range_coder.encode([ids[i : i + range_coder.BLOCK_IDS] for i in range(0, len(ids), range_coder.BLOCK_IDS)])
    return b"".join([struct.pack(HEAD, MAGIC, len(doc_ids), len(ids), len(docs), zlib.crc32(docs)), docs, *blocks])


def unpacked(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, which are null, how many token ids each has, the token ids) of a file, checked against its checksums."""
    if len(content) < HEAD_BYTES:
        raise ValueError("not a token file")
    magic, n, total, size, crc = struct.unpack_from(HEAD, content)
    docs = content[HEAD_BYTES : HEAD_BYTES + size]
    if magic != MAGIC or zlib.crc32(docs) != crc:
        raise ValueError("not a token file, or its document list differs from its checksum")
    docs = zstandard.decompress(docs)
    bits = (n + 7) // 8
    doc_ids, sizes = np.cumsum(np.frombuffer(docs[: 8 * n], "<i8")), np.frombuffer(docs[8 * n + bits :], "<i8")
    missing = np.unpackbits(np.frombuffer(docs[8 * n : 8 * n + bits], np.uint8), count=n).astype(bool)
    ids = range_coder.decode(range_coder.split(content[HEAD_BYTES + size :]))
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(ids) != total or int(sizes.sum()) != total:
        raise ValueError("a token file is not whole")
    return doc_ids, missing, sizes, ids


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text: str = "text", file_ids: int = range_coder.LANES * range_coder.BLOCK_IDS, group_chars: int = 4 << 20) -> None:
    """Writes the token ids of docs, each document's followed by ``end_id``, to the table at path: (part, file, n_docs, n_ids, content), in ascending order of id.

    Ids are whole numbers of 64 bits; rows without one come first, rows of one id in the order of their texts' hashes. A null text is an empty one; repeated rows
    are written each; no rows: no file. Texts are shuffled once, by ranges of (id, hash, row), so that an id that very many rows share is dealt
    out too. A task encodes some ``group_chars`` of text at a time and closes a file at the first document that takes it to ``file_ids`` ids. tokenizer:
    a path of the tokenizers library's JSON, byte_bpe_50k.json of public_tokenizers if None.
    """
    model = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, n = kept(("byte_bpe", model), lambda: byte_bpe(model)), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            content = packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            row = {"part": [task], "file": [n], "n_docs": [sum(len(h[0]) for h in held)], "n_ids": [size], "content": [content]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("file", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())]))

        for rows in parts:
            missing, doc_ids, at = rows.column("id").is_null().to_numpy(zero_copy_only=False), rows.column("id").fill_null(0).to_numpy(zero_copy_only=False), 0
            for texts in batches(rows.column("text"), group_chars):
                ids, sizes = encode(texts)
                with_end = np.full(len(ids) + len(sizes), end_id, np.uint32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                held.append((doc_ids[at : at + len(texts)], missing[at : at + len(texts)], sizes + 1, with_end))
                at, size = at + len(texts), size + len(with_end)
                if size >= file_ids:
                    yield closed()
                    n, size = n + 1, 0
                    held.clear()
        if held:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    rows.mapInArrow(pack, "part long, file long, n_docs long, n_ids long, content binary").write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row a document of the files at path: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as little-endian numbers of 32 bits),
    with its ``ids`` if asked for.

    A task decodes one file at a time. Where each file starts is a running sum over one narrow row a file; contents are not shuffled.
    """
    fields = [("part", pa.int64()), ("file", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for part, file, content in zip(rows.column("part").to_pylist(), rows.column("file").to_pylist(), rows.column("content"), strict=True):
                doc_ids, missing, sizes, ids = unpacked(content.as_buffer().to_pybytes())
                ends, raw = np.cumsum(sizes), memoryview(ids.astype("<u4").tobytes())
                begins = ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                for i in range(0, len(sizes), 10_000):
                    own = slice(i, i + 10_000)
                    columns = [np.full(len(sizes[own]), part), np.full(len(sizes[own]), file), pa.array(doc_ids[own], pa.int64(), mask=missing[own]), begins[own], sizes[own], crc[own]]
                    if with_ids:
                        first = begins[own][0]
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins[own], ends[own][-1]) - first, pa.int32()), pa.array(ids[first : ends[own][-1]].astype(np.int64))))
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    files = spark.read.schema("part long, file long, n_docs long, n_ids long, content binary").parquet(path)
    sizes = files.select("part", "file", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(sizes.select("part", "file", before.alias("before")))
    kind = "part long, file long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = files.select("part", "file", "content").mapInArrow(unpack, kind)
    joined = found.join(bounded(starts, starts.count()), ["part", "file"])
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
