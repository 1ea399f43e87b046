"""Budgeted samples, per-group limits and rankings with a full order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = "series_id"


def even_frames(start: Column, duration: Column, n: Column) -> Column:
    """Array of up to n distinct frames spread evenly over [start, start + duration), half-even; the first alone if n is 1 or less."""
    m = F.least(n, duration)
    steps = F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)))
    spread = F.transform(steps, lambda i: (start + F.bround(i * (duration - 1) / F.greatest(m - 1, F.lit(1)))).cast("long"))
    return F.when(m <= 0, F.array().cast("array<bigint>")).when(m == 1, F.array(start.cast("long"))).otherwise(F.array_distinct(spread))


def even_sample(ranges: DataFrame, n: int) -> DataFrame:
    """One row for each sampled frame of each range."""
    return ranges.withColumn("frame", F.explode(even_frames(F.col("start"), F.col("end") - F.col("start"), F.lit(n))))


def keyframe_thin(keys: DataFrame, budget: int, order: str = "seq", series: str = SERIES) -> DataFrame:
    """At most ``budget`` rows of each series, at evenly spaced places of its order; all if there are no more."""
    rows = keys.withColumns({"__n": F.row_number().over(Window.partitionBy(series).orderBy(order)) - 1, "__total": F.count("*").over(Window.partitionBy(series))})
    return rows.where((F.col("__total") <= budget) | F.array_contains(even_frames(F.lit(0), F.col("__total"), F.lit(budget)), F.col("__n").cast("long"))).drop("__n", "__total")


def allocate_timestamps(ranges: DataFrame, limit: int, margin: float = 0.1, series: str = SERIES) -> DataFrame:
    """Timestamps shared out over the ranges of a series by duration, at least one each, evenly inside margins, then thinned to the limit."""
    d = F.col("end") - F.col("start")
    share = F.greatest(F.lit(1), F.bround(limit * d / F.sum(d).over(Window.partitionBy(series))).cast("int"))
    rows = ranges.withColumn("share", share)
    lo, span = F.col("start") + margin * d, d * (1 - 2 * margin)
    at = F.transform(F.sequence(F.lit(0), F.col("share") - 1), lambda i: F.when(F.col("share") == 1, lo + span / 2).otherwise(lo + span * i / F.greatest(F.col("share") - 1, F.lit(1))))
    return keyframe_thin(rows.select(series, F.explode(at).alias("t")), limit, "t", series)


def first_k_per_group(df: DataFrame, k: int, *order, group: str = SERIES) -> DataFrame:
    """The first k rows of each group in a full order."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("n") <= k)


def diagnostic_topk(df: DataFrame, residual: str, outlier: str, k: int = 8, order: str = "seq", series: str = SERIES) -> DataFrame:
    """Rows worth a look, each once with its reasons: both ends, outliers, and the k largest residuals."""
    w = Window.partitionBy(series)
    rows = df.withColumns({"__first": F.row_number().over(w.orderBy(order)), "__last": F.row_number().over(w.orderBy(F.desc(order))), "__top": F.row_number().over(w.orderBy(F.desc(residual), order))})
    reasons = F.array_compact(F.array(F.when((F.col("__first") == 1) | (F.col("__last") == 1), "endpoint"), F.when(F.col(outlier), "outlier"), F.when(F.col("__top") <= k, "residual")))
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0).drop("__first", "__last", "__top")


def diagnostic_frames(df: DataFrame, residual: str, outlier: str, phases: DataFrame, available: DataFrame, k: int = 8, order: str = "seq", series: str = SERIES) -> DataFrame:
    """(series, frame, reasons, available): :func:`diagnostic_topk` with the frames of phases(series, frame), kept within the series, and of each the nearest frame
    of available(series, frame), the first among equals.
    """
    from .joins import nearest_timestamp

    ends = df.groupBy(series).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    marks = phases.join(ends, series).select(series, F.greatest("__lo", F.least("__hi", "frame")).alias("frame"), F.lit("phase").alias("reason"))
    own = diagnostic_topk(df, residual, outlier, k, order, series).select(series, F.col(order).alias("frame"), F.explode("reasons").alias("reason"))
    rows = own.unionByName(marks).groupBy(series, "frame").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    near = nearest_timestamp(rows.withColumn("t", F.col("frame").cast("double")), available.select(series, F.col("frame").cast("double").alias("t")).distinct(), "t", series)
    return near.select(series, "frame", "reasons", F.col("nearest").cast("long").alias("available"))


def phase_frames(bounds: DataFrame, *marks: str, series: str = SERIES) -> DataFrame:
    """The marks of each series kept within [lo, hi], distinct and in order."""
    inside = F.array_sort(F.array_distinct(F.array(*[F.least(F.greatest(F.col(m), F.col("lo")), F.col("hi")) for m in marks])))
    return bounds.withColumn("frames", inside)


ROLES = (("interior", 0), ("representative", 1), ("pre", 2), ("post", 2), ("boundary", 3), ("first", 4), ("last", 4), ("pinned", 5))
PROTECTED = ("first", "last", "pre", "boundary", "post", "pinned")


def budgeted_sample(bounds: DataFrame, segments: DataFrame, transitions: DataFrame, pins: DataFrame, per_segment: int, budget: int, series: str = SERIES) -> DataFrame:
    """(series, frame, role, reasons, protected): ends, spread samples of segments, neighbourhoods of transitions, pins, then a fill to the budget.

    A frame keeps its strictly highest role, the earliest added among equals; the fill takes the first new frames of an even sample; over
    budget, unprotected frames go from the end if the protected ones fit. Frames of the fill are candidates from the start and ranked
    with the rest, so all of it is one aggregation and one pass of windows.
    """
    priority = F.create_map(*[F.lit(x) for kv in ROLES for x in kv])
    role = lambda frame, name, step: F.struct(frame.cast("long").alias("frame"), F.lit(name).alias("role"), F.lit(step).alias("step"))
    d = F.col("end") - F.col("start")
    spread = even_frames(F.col("start"), d, F.least(F.lit(per_segment), F.greatest(F.lit(3), F.least(F.lit(5), d.cast("int")))))
    fill = F.transform(even_frames(F.col("lo"), F.col("hi") - F.col("lo"), F.lit(budget)), lambda f: role(f, "interior", 7))
    at = F.col("frame")
    # one branch for each input, which expands to all its roles
    rows = bounds.select(series, F.inline(F.concat(F.array(role(F.col("lo"), "first", 0), role(F.col("hi") - 1, "last", 1)), fill)))
    rows = rows.unionByName(segments.select(series, F.inline(F.transform(spread, lambda f: role(f, "representative", 2)))))
    rows = rows.unionByName(transitions.select(series, F.inline(F.array(role(at - 1, "pre", 3), role(at, "boundary", 4), role(at + 1, "post", 5)))))
    rows = rows.unionByName(pins.select(series, F.inline(F.array(role(at, "pinned", 6)))))
    rows = rows.join(bounds, series).where("frame >= lo and frame < hi").drop("lo", "hi")
    rank = F.struct(priority[F.col("role")].alias("p"), -F.col("step"), F.col("role").alias("role"))
    kept = rows.groupBy(series, "frame").agg(F.max(rank)["role"].alias("role"), F.array_sort(F.collect_set("role")).alias("reasons"))
    fill = F.col("role") == "interior"
    kept = kept.withColumn("reasons", F.when(fill, F.col("reasons")).otherwise(F.array_remove("reasons", "interior")))
    kept = kept.withColumns({"__own": F.sum((~fill).cast("int")).over(Window.partitionBy(series)), "__k": F.row_number().over(Window.partitionBy(series, fill).orderBy("frame"))})
    kept = kept.where(~fill | (F.col("__k") <= budget - F.col("__own"))).drop("__own", "__k")
    kept = kept.withColumn("protected", F.col("role").isin(*PROTECTED))
    w = Window.partitionBy(series)
    kept = kept.withColumns({"__n": F.count("*").over(w), "__safe": F.sum(F.col("protected").cast("int")).over(w), "__k": F.row_number().over(Window.partitionBy(series, "protected").orderBy("frame"))})
    over = (F.col("__n") > budget) & (F.col("__safe") <= budget) & ~F.col("protected") & (F.col("__k") > budget - F.col("__safe"))
    return kept.where(~over).drop("__n", "__safe", "__k")
