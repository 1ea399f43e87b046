"""Exact quantiles of groups that no task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoform.sources.storage import cut

#: Buckets of a round: a power of two for each side of zero.
OCTAVE, SIDE = 16, 1 << 15


def coarse(x: Column) -> Column:
    """A number that never falls as x rises: 16 steps an octave on either side of zero. Infinities and NaN, which is the greatest, have their own."""
    steps = F.floor((F.log2(F.greatest(F.abs(x), F.lit(2.0**-1000))) + 1001) * OCTAVE).cast("int")
    return F.when(F.isnan(x), SIDE + 1).when(x == float("inf"), SIDE).when(x == float("-inf"), -SIDE).when(x == 0, 0).otherwise(F.signum(x).cast("int") * steps)


def fine(x: Column, lo: Column, hi: Column) -> Column:
    """The place of x between lo and hi, of 65,536."""
    return F.when(x >= hi, 2 * SIDE - 1).otherwise(F.floor((x - lo) / (hi - lo) * (2 * SIDE - 1))).cast("int")


def at_ranks(df: DataFrame, value: str, ranks: DataFrame, series: str) -> DataFrame:
    """(series, rank, x): the values at ranks(series, rank), counted from 0 in ascending order, for series of very many rows.

    Each round counts the rows of the range that holds a rank in buckets, and goes on with the bucket that holds it: first by magnitude, then evenly between the
    least and the greatest value met. A range of more than one value is always split, and shrinks by 65,536 at each even round, so a handful of rounds end it, the later
    ones over what the first left. A task holds one histogram a rank, whatever the number of rows or of equal ones.
    """
    rows = df.select(series, F.col(value).cast("double").alias("x")).join(F.broadcast(ranks.select(series).distinct()), series)
    open_, done, first = cut(ranks.withColumns({"left": F.col("rank"), "lo": F.lit(float("-inf")), "hi": F.lit(float("nan"))})), None, True
    while not open_.isEmpty():
        met = rows.join(F.broadcast(open_), series) if first else rows.join(F.broadcast(open_), [series, "rank"])
        if not first:
            met = cut(met.where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).select(series, "rank", "x", "left", "lo", "hi"))
            rows = met.select(series, "rank", "x")
        bucket = coarse(F.col("x")) if first else fine(F.col("x"), F.col("lo"), F.col("hi"))
        counts = met.groupBy(series, "rank", "left", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(series, "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        holds = counts.withColumn("before", before).where((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        holds = cut(holds.select(series, "rank", (F.col("left") - F.col("before")).alias("left"), "lo", "hi"))
        found = holds.where("lo <=> hi").select(series, "rank", F.col("lo").alias("x"))
        done, open_ = found if done is None else done.unionByName(found), cut(holds.where("not lo <=> hi"))
        if first:
            rows = rows.join(F.broadcast(open_.select(series, "rank")), series)
        first = False
    return done


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], series: str, hot_rows: int = 1_000_000) -> DataFrame:
    """(series, and a column a quantile): exact, linear between neighbours, as ``percentile``; nulls do not count, and a series of nulls has null.

    Series of up to ``hot_rows`` rows are aggregated, which holds their distinct values; the others by :func:`at_ranks`.
    """
    sizes = cut(df.groupBy(series).agg(F.count(value).alias("n")))
    hot = sizes.where(F.col("n") > hot_rows)
    plain = [F.percentile(value, F.lit(q)).alias(name) for name, q in quantiles.items()]
    if hot.isEmpty():
        return df.groupBy(series).agg(*plain)
    few = df.join(F.broadcast(hot.select(series)), series, "left_anti").groupBy(series).agg(*plain)
    places = hot.select(series, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for name, q in quantiles.items()])).alias("p"))
    places = cut(places.select(series, "p.name", "p.at", F.floor("p.at").alias("below"), F.ceil("p.at").alias("above")))
    ranks = places.select(series, F.explode(F.array("below", "above")).alias("rank")).distinct()
    values = cut(at_ranks(df.where(F.col(value).isNotNull()), value, ranks, series))
    side = lambda c, name: values.select(series, F.col("rank").alias(c), F.col("x").alias(name))
    joined = places.join(side("below", "lo"), [series, "below"]).join(side("above", "hi"), [series, "above"])
    x = F.when(F.col("below") == F.col("above"), F.col("lo")).otherwise((F.col("above") - F.col("at")) * F.col("lo") + (F.col("at") - F.col("below")) * F.col("hi"))
    wide = joined.groupBy(series).agg(*[F.max(F.when(F.col("name") == name, x)).alias(name) for name in quantiles])
    return few.unionByName(wide)
