"""WARC archives in dictionary-compressed form: a Zstandard dictionary in a leading skippable frame, then one frame a record.

An archive is kept as one row of a Parquet table, the bytes of a ``.warc.zst`` file, so Spark writes, retries and reads it on any
store; :func:`export` makes files of them. Each begins with a ``warcinfo`` record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, hot_join

SKIPPABLE = 0x184D2A5D  # of the dictionary frame, by the .warc.zst specification
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the HTTP header only."""
    uri = "".join(c if c.isprintable() and c not in " <>" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(archive: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: chronoform\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-archive:{archive}>", f"WARC-Date: {DATE}", f"WARC-Filename: {archive}.warc.zst", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of each record of an archive's uncompressed content, in order."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        field = dict(x.split(": ", 1) for x in lines)
        start, size = end + 4, int(field.get("Content-Length", -1))
        if not version.startswith("WARC/") or size < 0 or content[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield field, content[start : start + size]
        at = start + size + 4


def parsed(field: dict, block: bytes) -> dict:
    """The row of a record, of a response with its payload, checked against the digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda name: int(x) if (x := field[name].removeprefix("<urn:x-page:").removesuffix(">")) else None
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of page {page('WARC-Record-ID')} differs from its digest")
    return {"page_id": page("WARC-Record-ID"), "url": field["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": page("WARC-Refers-To") if revisit else None, "payload": None if revisit else payload}


def dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary of about ``size`` bytes from records spread over the archive, a hundred times its size at most.

    Too few or too small records cannot be trained on; then the last ``size`` bytes of them are the dictionary.
    """
    step = max(1, sum(map(len, records)) // (100 * size))
    chosen = records[::step]
    samples = [r[i : i + 4096] for r in chosen for i in range(0, len(r), 4096)]
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chosen)[-size:]


def frames(records: list[bytes], dict_bytes: int, level: int) -> list[bytes]:
    """The dictionary's skippable frame, then a frame for each record."""
    own = dictionary(records, dict_bytes)
    tool = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(own), write_checksum=True, write_content_size=True)
    return [struct.pack("<II", SKIPPABLE, len(own)) + own, *map(tool.compress, records)]


def uncompressed(content: bytes) -> bytes:
    """The records of a ``.warc.zst`` file, one after the other, by its own dictionary."""
    magic, size = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
    if magic != SKIPPABLE or len(content) < 8 + size:
        raise ValueError("the archive does not begin with its dictionary")
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    return tool.stream_reader(io.BytesIO(content[8 + size :]), read_across_frames=True).read()


def classified(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html", max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit). Of equal payloads of ``min_bytes`` or more, the largest page_id is the response.

    Digests are counted before they are shuffled, and of payloads only those of digests that occur twice are looked up, by a broadcast if these
    digests are 500,000 or fewer; beyond that rows are shuffled by digest, the hot ones not. Rows that repeat the largest page_id are
    responses too; a row without an id revisits whatever has one.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    twice = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null")
    twice = cut(twice)
    if twice.count() <= max_broadcast_rows:
        joined = rows.join(F.broadcast(twice.select("digest", "first")), "digest", "left")
    else:
        own = rows.where(F.length("payload") >= min_bytes)
        joined = hot_join(own, twice, "digest", "n").drop("n").unionByName(rows.join(twice.select("digest"), "digest", "left_anti").withColumn("first", F.lit(None).cast("long")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, dict_bytes: int = 32 << 10, level: int = 3, **options) -> None:
    """Writes pages as archives to the table at path: (archive, n_records, content), each content the bytes of a ``.warc.zst`` file.

    A task closes an archive once its records pass ``archive_bytes``, so memory holds one archive and one Arrow batch. No page: no
    archive. Null html: an empty payload. Payloads are not shuffled.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pd.DataFrame:
            name = f"{task:06d}-{n:06d}"
            return pd.DataFrame({"archive": [name], "n_records": [len(held)], "content": [b"".join(frames([info(name), *held], dict_bytes, level))]})

        for rows in batches:
            for page_id, url, payload, refers_to, revisit in zip(rows.page_id.tolist(), rows.url, rows.payload, rows.refers_to.tolist(), rows.revisit, strict=True):
                held.append(record(None if page_id == "" else int(page_id), url, bytes(payload), None if refers_to == "" else int(refers_to), revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()
                    n, held, size = n + 1, [], 0
        if held:
            yield closed()

    ids = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("page_id", "refers_to")]
    rows = classified(pages, **options).select(ids[0], "url", "payload", ids[1], "revisit")
    rows.mapInPandas(pack, "archive string, n_records long, content binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null of a revisit).

    An archive is one row and has a bounded size; nothing is shuffled.
    """
    return unpacked(archives(spark, path))


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def unpacked(found: DataFrame) -> DataFrame:
    """The records of the archives in column ``content``, such as of ``.warc.zst`` files read as binaryFile, without their warcinfo."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in RECORDS.split(", "))])  # whole numbers stay whole, nulls or not
        for rows in batches:
            for content in rows.column("content"):
                got = [parsed(field, block) for field, block in records_of(uncompressed(content.as_py())) if field["WARC-Type"] != "warcinfo"]
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema=schema)

    return found.select("content").mapInArrow(unpack, RECORDS)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, n_records, content): each archive as the bytes of a ``.warc.zst`` file."""
    return spark.read.schema("archive string, n_records long, content binary").parquet(path)


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes each archive of the table at path as a file in the folder, a URI that Arrow's file systems know, and returns (archive, bytes).

    A task writes under a name of its attempt and then renames, so a task that is run again, or twice, leaves the same file.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for rows in batches:
            for name, content in zip(rows.archive, rows.content, strict=True):
                own = f"{base}/.{name}-{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(own) as out:
                    out.write(bytes(content))
                store.move(own, f"{base}/{name}.warc.zst")
            yield pd.DataFrame({"archive": rows.archive, "bytes": rows.content.map(len)})

    return cut(archives(spark, path).mapInPandas(put, "archive string, bytes long"))
