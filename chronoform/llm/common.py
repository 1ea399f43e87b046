"""What the operators of this subpackage share: the shared folder, lineage cuts, input columns and joins that hot keys do not slow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoform.sources.storage import cut, new_path, shared_dir

__all__ = ["ascii_lower", "bounded", "crc_mod", "cut", "hot_join", "new_path", "shared_dir", "without"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a narrow table that may be broadcast: some 50 MB at 100 bytes a row.
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def bounded(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if its ``rows`` are ``most`` or fewer; else as it is."""
    return F.broadcast(df) if rows <= most else df


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, many: str, least: int = 1000) -> DataFrame:
    """rows joined to lookup, one row a key of which ``many`` tells how many of rows have it.

    Keys of more than ``least`` rows and a hundred-thousandth of all are broadcast, so these are 100,000 at most; the others meet
    in a shuffle in which no key is large. Both tables should be cut before.
    """
    least = max(least, int(lookup.agg(F.sum(many)).first()[0] or 0) // 100_000)
    hot = lookup.where(F.col(many) > least)
    if hot.isEmpty():
        return rows.join(lookup, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(lookup.where(F.col(many) <= least), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def without(docs: DataFrame, gone: DataFrame, on: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that meet none of ``gone``, a narrow table. Texts stay where they are if gone has ``most`` rows or fewer."""
    gone = cut(gone)
    return docs.join(bounded(gone, gone.count(), most), on, "left_anti")
