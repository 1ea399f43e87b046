"""Mixing sources to target weights that change over training: a curriculum over positions between 0 and 1.

A source's weight at time t is w (1 + slope (2 t - 1)). Integrated over time it is w, so the slope moves when a source is read, not
how much of it. A source's documents stand in order of a hash; each has an interval of the tokens that the source has handed
out by then, repeats included. The time at which demand reaches the middle of the interval is the document's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut

BLANKS = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Slopes of the sources in turn, like the weights: the first kind comes early, the second evenly, the third late.
SLOPES = (-0.5, 0.0, 0.5)
MOST_PASSES = 3


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, BLANKS), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target, slope): one row a source, from rows (source, size).

    Sources stand by code point, null last, and take the weights in turn. They share the total by weight; one that would pass
    ``most`` times its size stops there, and the excess goes to the others by weight. The level at which all meet is found by
    sorting the sources by size over weight: those below it are full. Windows here run over one row a source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    own = own.withColumns({"w": F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("double"), "slope": F.element_at(F.array(*map(F.lit, slopes)), nth + 1).cast("double")})
    by_fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    own = own.withColumns(
        {"total": F.sum("source_size").over(everything), "full": F.sum("source_size").over(by_fill) - F.col("source_size"), "open": F.sum("w").over(everything) - F.sum("w").over(by_fill) + F.col("w")}
    )
    # with all earlier sources full, the level for this and the later ones; a source is full if the level passes its bound
    own = own.withColumn("level", (F.col("total") - most * F.col("full")) / F.col("open"))
    own = own.withColumn("is_full", F.col("level") * F.col("w") > most * F.col("source_size"))
    own = own.withColumns({"full": F.sum(F.when(F.col("is_full"), F.col("source_size")).otherwise(0)).over(everything), "open": F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("w"))).over(everything)})
    target = F.when(F.col("is_full"), (most * F.col("source_size")).cast("double")).otherwise((F.col("total") - most * F.col("full")) * F.col("w") / F.col("open"))
    return own.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), "slope")


def position(done: Column, target: Column, slope: Column) -> Column:
    """The time at which a source has handed out ``done`` of its ``target`` tokens: the inverse of t + slope (t^2 - t)."""
    y = F.when(target > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / target))).otherwise(0.0)
    root = F.sqrt(F.greatest(F.lit(0.0), F.pow(1 - slope, 2) + 4 * slope * y))
    return F.when(slope == 0, y).otherwise((root - (1 - slope)) / (2 * slope))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", bucket_rows: int | None = None, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """For each row of docs: id, source, size, source_size, target, taken and positions (one for each pass that takes it), and the columns of ``carry``.

    Every document is in each whole pass; the last, partial pass takes documents until the target is reached and cuts the one
    that reaches it, so a source's sum of taken words differs from its target by less than one word. The order is that of md5(id), or of md5 of the text where the id is null, so
    reruns agree and rows without an id are spread like others; repeated rows are documents of their own. Null source: a source, last. Null or empty text: size 0, taken 0. A
    source without words has target 0. Running sums are kept within hash buckets of some ``bucket_rows`` rows, offset by the sums of
    the buckets before, so that no task gets a source whole; they are 50,000, or 5,000 with carried columns. Carried columns are shuffled once, by bucket; totals are made without them.
    """
    bucket_rows = bucket_rows or (5_000 if carry else 50_000)
    rank = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit("")))))
    read = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), rank.alias("rank"), *([F.struct(*carry).alias("carried")] if carry else []))
    sizes = cut(read.select("id", "source", "size", "rank"))
    targets = cut(source_targets(sizes, **options))
    # the bucket is the leading bits of the rank, so that buckets stand in the order of the documents
    rows = sizes.count()
    digits = next(d for d in range(1, 9) if 16**d * bucket_rows >= rows or d == 8)
    bucket = F.substring("rank", 1, digits).alias("bucket")
    rest = ["a.carried"] if carry else []
    sizes, read = sizes.select("*", bucket), (read if carry else sizes).select("*", bucket)
    totals = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    offsets = cut(offsets)
    ties = [F.xxhash64("carried")] if carry else []
    within = Window.partitionBy("source", "bucket").orderBy("rank", "id", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = read.withColumn("upto", F.sum("size").over(within)).alias("a").join(bounded(offsets, offsets.count()).alias("b"), F.expr("a.source <=> b.source and a.bucket = b.bucket")).select("a.id", "a.source", "size", *rest, (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))
    placed = placed.alias("a").join(bounded(targets, targets.count(), 100_000).alias("b"), F.expr("a.source <=> b.source")).select("a.*", "source_size", "target", "slope")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int")
    left = F.floor(F.col("target") + 1e-6) - F.col("whole") * F.col("source_size") - F.col("start")
    placed = placed.withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0), F.least("size", left)))
    passes = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(0)
    middle = F.col("start") + F.col("size") / 2
    turns = F.transform(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1), lambda k: position(k * F.col("source_size") + middle, F.col("target"), F.col("slope")))
    taken = F.col("whole") * F.col("size") + F.col("part")
    turns = F.when(passes > 0, turns).otherwise(F.array().cast("array<double>"))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", taken.cast("long").alias("taken"), turns.alias("positions"), *(["carried.*"] if carry else []))


def by_position(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows in ranges of the order, sorted in each: partitions stand one after the other."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def schedule(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(position, id): the training order, one row for each time that a document is read, in ranges of position."""
    return by_position(mixed.select(F.explode("positions").alias("position"), id_col), "position", id_col)


def readings(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each time that a document is read, in ranges of its position: mixed with ``pass`` (from 1) and ``position`` in place of
    positions, and ``taken`` the words of this reading. A document that is never read is one row without pass and position, at the end.
    """
    rest = [c for c in mixed.columns if c not in ("positions", "taken")]
    rows = mixed.select(*rest, "taken", F.posexplode_outer("positions").alias("pass", "position"))
    words = F.when(F.col("pass").isNull(), 0).otherwise(F.least("size", F.col("taken") - F.col("pass") * F.col("size"))).cast("long")
    rows = rows.select(*rest, words.alias("taken"), (F.col("pass") + 1).alias("pass"), "position")
    return by_position(rows, F.col("position").asc_nulls_last(), F.col(id_col).asc_nulls_last(), "pass")


def in_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of a mix by their first position, in ranges of it; documents that are never read come last. All positions stay."""
    return by_position(mixed, F.try_element_at("positions", F.lit(1)).asc_nulls_last(), F.col(id_col).asc_nulls_last())
