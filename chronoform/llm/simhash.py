"""SimHash near-duplicates, found by Golay-code fuzzy hashing (Berkovich and others).

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded with zeros to a word of the perfect
(23, 12) Golay code. The codewords within distance 4 of a word are its keys: one if the nearest is at distance 2 or less, else
six. Two words at distance 2 or less share a key, the codeword nearest to a word halfway between them. Of 4 errors in three
segments, at most 2 fall in the best two, so two fingerprints at distance 4 or less share the keys of both segments of some
pair. Fingerprints that share such a pair of keys are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import bounded, cut, hot_join, without
from .graph import connected_components, local_forest

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
PAIRS = tuple(combinations(range(3), 2))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
DISTANCE = 4


class Golay:
    """For each of the 2048 syndromes the error patterns of weight 4 or less; built once a Python worker."""

    tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @staticmethod
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    @classmethod
    def build(cls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(syndrome of each bit, patterns by syndrome [2048, 6], how many of them)."""
        if cls.tables is None:
            bits = np.array([cls.remainder(1 << b) for b in range(23)])
            patterns, many = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
            for weight in range(5):
                for at in combinations(range(23), weight):
                    s = int(np.bitwise_xor.reduce(bits[list(at)])) if at else 0
                    if weight < 4 or many[s] and bin(patterns[s, 0]).count("1") == 3:
                        patterns[s, many[s]] = sum(1 << b for b in at)
                        many[s] += 1
            cls.tables = bits, patterns, many
        return cls.tables


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of the codewords within distance 4 of each 23-bit word [n, 6], and how many count (1 or 6)."""
    bits, patterns, many = Golay.build()
    syndrome = np.zeros(len(words), np.int64)
    for b in range(23):
        syndrome ^= np.where(words >> b & 1, bits[b], 0)
    return (words[:, None] ^ patterns[syndrome]) >> 11, many[syndrome]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every pair of segments and every pair of their codewords; fps are unsigned 64-bit."""
    found = [codeword_keys((fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    rows, keys = [], []
    slot = np.arange(6)
    for p, (i, j) in enumerate(PAIRS):
        (a, n), (b, m) = found[i], found[j]
        key = (p << 24 | a[:, :, None] << 12 | b[:, None, :]).reshape(len(fps), 36)
        on = ((slot < n[:, None])[:, :, None] & (slot < m[:, None])[:, None, :]).reshape(len(fps), 36)
        rows.append(np.nonzero(on)[0])
        keys.append(key[on])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint_of(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a whole text: a bit is 1 if set in over half the hashes of its shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]
    bits, n = np.zeros(64, np.int64), len(hashes)
    for k in range(0, n, 65536):
        part = np.array(hashes[k : k + 65536], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def simhash64(texts: pa.Array) -> pa.Array:
    """The fingerprint as a signed long; null text: zero."""
    return pa.array(np.array([fingerprint_of(t.as_py()) for t in texts], np.uint64).view(np.int64))


def compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (unit, fp) in order of unit: a forest of the links inside each run of equal units, (src, dst) fingerprints.

    Holds one run and one batch; a run has at most two chunks of a hot bucket.
    """
    unit, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(unit: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        a, b, d = [], [], 1
        at = np.arange(len(unit))
        while len(at := at[at + d < len(unit)]):
            at = at[unit[at] == unit[at + d]]
            near = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= DISTANCE]
            a.append(fp[near])
            b.append(fp[near + d])
            d += 1
        if not a or not sum(map(len, a)):
            return None
        src, dst = local_forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    for batch in batches:
        unit = np.concatenate([unit, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(unit) and unit[0] != unit[-1]:
            last = int(np.searchsorted(unit, unit[-1]))
            if (out := links(unit[:last], fp[:last])) is not None:
                yield out
            unit, fp = unit[last:], fp[last:]
    if len(unit) and (out := links(unit, fp)) is not None:
        yield out


def near_fingerprints(fps: DataFrame, chunk: int = 4096) -> DataFrame:
    """(src, dst): links between the distinct values of column fp that join up whatever is within 4 bits of each other.

    Buckets of more than ``chunk`` fingerprints are cut into chunks, and each pair of chunks is a unit of its own, so no
    task gets a bucket whole. Only a forest of a unit's links leaves it.
    """

    @F.pandas_udf("array<int>")
    def keys(values: pd.Series) -> pd.Series:
        rows, found = fuzzy_keys(values.to_numpy(np.int64).view(np.uint64))
        order = np.argsort(rows, kind="stable")
        return pd.Series(np.split(found[order].astype(np.int32), np.cumsum(np.bincount(rows, minlength=len(values)))[:-1]))

    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a number of its own: keys are up to 108 times as many rows
    keyed = cut(fps.select("fp", keys("fp").alias("keys")))  # made once, and kept as arrays: half the size of rows
    hot = keyed.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > chunk)
    hot = cut(hot.select("key", F.ceil(F.col("count") / chunk).cast("int").alias("parts")))
    n_hot = hot.count()
    keyed = keyed.select("fp", F.explode("keys").alias("key"))
    unit = F.col("key").cast("long")
    if not n_hot:
        units = keyed.select(unit.alias("unit"), "fp")
    else:
        # unit of chunks i <= j of a bucket: i and j take 18 bits each above the key's 26
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.shiftleft(F.least(own, j).cast("long"), 44).bitwiseOR(F.shiftleft(F.greatest(own, j).cast("long"), 26)).bitwiseOR(unit))
        units = keyed.join(bounded(hot, n_hot), "key", "left").select(F.explode(F.when(F.col("parts").isNull(), F.array(unit)).otherwise(pair)).alias("unit"), "fp")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare_runs, "src long, dst long").distinct()


def grouped(own: DataFrame) -> DataFrame:
    """own, rows with id and ``fp``, with ``root``, which names the group, and ``component_id``, its smallest id.

    A fingerprint that very many rows have, and a group of very many fingerprints, are met by broadcast.
    """
    least = cut(own.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_rows")))
    linked = connected_components(near_fingerprints(least.select("fp"))).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    linked = cut(linked.join(least, "fp"))
    roots = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_fps")))
    found = hot_join(linked.select("fp", "root"), roots, "root", "n_fps").select("fp", "root", "component_id")
    alone = least.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id")).join(linked.select("fp"), "fp", "left_anti")
    named = cut(found.unionByName(alone).join(least.select("fp", "n_rows"), "fp"))
    return hot_join(own, named, "fp", "n_rows").drop("n_rows")


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' ids with ``fp`` (signed long) and ``component_id``, the smallest id reachable over links of 4 bits or less.

    One row for each row of docs. Null, empty and blank texts have fingerprint zero and link like any other. Equal texts
    have equal fingerprints and cost one comparison, whatever their number. A null id takes part but never names a component
    unless it has no other id; then the component is null. No shuffle carries a text.
    """
    own = cut(docs.select(F.col(id_col).alias("id"), simhash64(F.col(text)).alias("fp")))
    return grouped(own).select(F.col("id").alias(id_col), "fp", "component_id")


def hex64(fp) -> F.Column:
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def text_hash(text: Column) -> Column:
    """Equal texts have equal hashes; null is a text of its own."""
    return F.coalesce(F.md5(text), F.lit(""))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of docs whose id is the smallest of its group. Rows are told apart by id and text, so an id that occurs with texts of
    several groups loses only the rows of groups with a smaller id.

    With ``repeats``, repeated rows of the kept id stay, and so do rows without an id. Without, each group keeps exactly one row: the
    smallest id (null last), then the smallest hash of the text, then the smallest row. Rows of one id and text are counted
    before groups are formed, and only a kept id and text that is repeated has its rows aggregated.
    """
    own = cut(docs.select(F.col(id_col).alias("id"), text_hash(F.col(text)).alias("hash"), simhash64(F.col(text)).alias("fp")))
    found = grouped(own.groupBy("id", "hash", "fp").agg(F.count(F.lit(1)).alias("n")))
    key = docs[id_col].eqNullSafe(F.col("__cf_id")) & (text_hash(docs[text]) == F.col("__cf_hash"))
    names = F.col("id").alias("__cf_id"), F.col("hash").alias("__cf_hash")
    if repeats:
        return without(docs, found.where(F.col("component_id") < F.col("id")).select(*names), key)
    found = cut(found.select("id", "hash", "n", "root"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "n")).alias("first"))
    kept = cut(first.select("first.*"))
    single, several = kept.where("n = 1").select("id", "hash"), kept.where("n > 1")
    same = F.expr("a.id <=> b.id and a.hash = b.hash")
    gone = found.alias("a").join(single.alias("b"), same, "left_anti").select(*names)
    out = without(docs, gone, key)
    if several.isEmpty():
        return out
    several = several.select(*names)
    repeated = docs.join(bounded(several, several.count()), key)
    one = repeated.groupBy("__cf_id", "__cf_hash").agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return out.unionByName(one.select("row.*"))
