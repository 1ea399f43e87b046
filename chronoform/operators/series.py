"""Operators over ordered series: change points, runs, derivatives, filters, curves and phases.

Windows are partitioned by series and run inside one sort of it, so chained operators share one shuffle. Operators that take ``block_rows`` deal series
of more rows than that to blocks (see :mod:`blocks`), with the same results; without it a series is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoform.functions.scalar import clamp, col

from .blocks import BLOCK, NUMBER, in_blocks, numbered, scan, shifted
from .blocks import whole as of_whole
from .quantiles import exact_quantiles

SERIES, ORDER, VALUE = "series_id", "seq", "signal"


def along(series: str = SERIES, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(series).orderBy(order)


def whole(series: str = SERIES) -> WindowSpec:
    return Window.partitionBy(series)


def adjacent_deltas(samples: DataFrame, vector: str = "x", width: int = 8, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """Change of each raster against the one before: mean absolute difference, change of mean, of edges and left-right asymmetry; 0 for the first.

    The change of edges is the mean absolute difference of the horizontal neighbour differences.
    """
    diff = F.zip_with(F.col(vector), F.col("prev"), lambda a, b: F.abs(a - b))
    avg = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    df = shifted(samples, {"prev": (vector, -1)}, series, order, block_rows).withColumn("diff", diff)
    across = lambda xs: F.transform(F.sequence(F.lit(0), F.size(xs) - 2), lambda i: F.abs(F.get(xs, i + 1) - F.get(xs, i)) * (i % width != width - 1).cast("double"))
    edges = F.zip_with(across(F.col(vector)), across(F.col("prev")), lambda a, b: F.abs(a - b))
    left, right = F.filter("diff", lambda x, i: i % width < width // 2), F.filter("diff", lambda x, i: i % width >= width // 2)
    return df.select(
        series,
        order,
        F.coalesce(avg(F.col("diff")), F.lit(0.0)).alias("pixel_change"),
        F.coalesce(F.abs(avg(F.col(vector)) - avg(F.col("prev"))), F.lit(0.0)).alias("luminance_change"),
        F.when(F.col("prev").isNull(), 0.0).otherwise(F.aggregate(edges, F.lit(0.0), lambda s, x: s + x) / (F.size(vector) - F.size(vector) / width)).alias("edge_change"),
        F.when(F.col("prev").isNull(), 0.0).otherwise(F.least(F.lit(1.0), 4 * F.abs(avg(left) - avg(right)))).alias("asymmetry"),
    )


def minmax_normalize(df: DataFrame, value: str = VALUE, series: str = SERIES) -> DataFrame:
    """(x - min) / (max - min) within a series; 0 throughout a constant one."""
    lo, hi = F.min(value).over(whole(series)), F.max(value).over(whole(series))
    return df.withColumn("normalized", F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0))


def unwrap_degrees(df: DataFrame, value: str = VALUE, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """Angles without jumps of a full turn; the first value stays."""
    w = along(series, order)
    step = F.col(value) - F.lag(value).over(w)
    turn = F.coalesce(F.pmod(step + 180.0, F.lit(360.0)) - 180.0, F.lit(0.0))
    df = df.withColumn("__turn", turn)
    return df.withColumn("unwrapped", F.first(value).over(w) + F.sum("__turn").over(w)).drop("__turn")


def robust_threshold(df: DataFrame, value: str = VALUE, k: float = 6.0, floor: float = 0.08, lo: float | None = 0.16, hi: float | None = 0.65, series: str = SERIES, order: str = ORDER, hot_rows: int | None = None) -> DataFrame:
    """(series, median, mad, threshold): median + max(floor, k raw MAD), kept within [lo, hi]. The first row of a series does not count.

    The median is taken in a window and its deviation in the aggregation behind it, all in one partitioning by series. With ``hot_rows``, series of more rows than that
    are held by no task: their first row is the one of the least order, and both medians are found by :func:`quantiles.exact_quantiles`.
    """
    if hot_rows:
        first = df.groupBy(series).agg(F.min(order).alias("__first"))
        rows = df.join(first, series).where(F.col(order) > F.col("__first")).select(series, F.col(value).alias("x"))
        mid = exact_quantiles(rows, "x", {"median": 0.5}, series, hot_rows)
        off = exact_quantiles(rows.join(mid, series).select(series, F.abs(F.col("x") - F.col("median")).alias("x")), "x", {"mad": 0.5}, series, hot_rows)
        return mid.join(off, series).withColumn("threshold", clamp(F.col("median") + F.greatest(F.lit(floor), k * F.col("mad")), lo, hi))
    rows = df.withColumn("__first", F.lag(order).over(along(series, order)).isNull()).where("not __first").select(series, F.col(value).alias("x"))
    rows = rows.withColumn("median", F.percentile("x", F.lit(0.5)).over(whole(series)))
    mad = rows.groupBy(series).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5)).alias("mad"))
    return mad.withColumn("threshold", clamp(F.col("median") + F.greatest(F.lit(floor), k * F.col("mad")), lo, hi))


def local_peaks(df: DataFrame, thresholds: DataFrame, value: str = VALUE, external: DataFrame | None = None, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """Rows at or above the threshold and both neighbours (a missing next one is 0), and rows of the external candidates."""
    rows = shifted(df, {"__prev": (value, -1), "__next": (value, 1)}, series, order, block_rows)
    rows = rows.withColumn("__next", F.coalesce("__next", F.lit(0.0))).join(thresholds.select(series, "threshold"), series)
    peak = F.col("__prev").isNotNull() & (F.col(value) >= F.col("threshold")) & (F.col(value) >= F.col("__prev")) & (F.col(value) >= F.col("__next"))
    if external is not None:
        rows = rows.join(external.select(series, order).distinct().withColumn("__ext", F.lit(True)), [series, order], "left")
        peak = peak | F.coalesce("__ext", F.lit(False))
    return rows.where(peak).drop("__prev", "__next", "__ext")


def islands(df: DataFrame, holds: Column, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """The rows for which the condition holds, with ``island``: the number of rows before for which it does not."""
    df = df.withColumn("__on", F.coalesce(holds, F.lit(False)))
    return scan(df, {"island": ("sum", (~F.col("__on")).cast("long"), True)}, series, order, block_rows=block_rows).where("__on").drop("__on", BLOCK)


def sustained_runs(df: DataFrame, value: str = VALUE, threshold: float = 0.035, min_len: int = 4, min_sum: float = 0.25, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """Longest runs of rows at or above the threshold, of at least min_len rows and min_sum in all."""
    runs = islands(df, F.col(value) >= threshold, series, order, block_rows).groupBy(series, "island")
    return runs.agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count("*").alias("n"), F.sum(value).alias("total")).where((F.col("n") >= min_len) & (F.col("total") >= min_sum)).drop("island")


def isolated_impulses(df: DataFrame, value: str = VALUE, peak: float = 0.35, floor: float = 0.12, share: float = 0.55, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """Rows of at least ``peak`` whose neighbours are at most max(floor, share of it)."""
    rows = shifted(df, {"__prev": (value, -1), "__next": (value, 1)}, series, order, block_rows)
    rows = rows.withColumn("beside", F.greatest(F.coalesce("__prev", F.lit(0.0)), F.coalesce("__next", F.lit(0.0))))
    return rows.where(F.col("__prev").isNotNull() & (F.col(value) >= peak) & (F.col("beside") <= F.greatest(F.lit(floor), share * F.col(value)))).drop("__prev", "__next")


def group_candidates(candidates: DataFrame, isolated: DataFrame, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """(series, start, end, n): runs of consecutive candidates; isolated ones are groups of their own and part the others."""
    alone = isolated.select(series, order).distinct()
    rest = candidates.select(series, order).distinct().join(alone, [series, order], "left_anti")
    rest = numbered(rest, series, order, block_rows=block_rows).withColumn("__g", F.col(order) - F.col(NUMBER))
    grouped = rest.groupBy(series, "__g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count("*").alias("n")).drop("__g")
    return grouped.unionByName(alone.select(series, F.col(order).alias("start"), (F.col(order) + 1).alias("end"), F.lit(1).cast("long").alias("n")))


def sparse_transitions(df: DataFrame, thresholds: DataFrame, value: str = "combined", histogram: str = "hist", min_histogram: float = 0.12, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """Changes between neighbouring observed rows: the frame is their half-even midpoint, the type is unknown."""
    before = F.lag(order).over(along(series, order))
    rows = df.withColumn("before", before).join(thresholds.select(series, "threshold"), series)
    rows = rows.where(F.col("before").isNotNull() & (F.col(value) >= F.col("threshold")) & (F.col(histogram) >= min_histogram))
    middle = F.bround((F.col("before") + F.col(order)) / 2.0).cast("long")
    return rows.select(series, F.greatest(F.col("before") + 1, F.least(F.col(order), middle)).alias("frame"), F.lit("unknown").alias("type"), F.least(F.lit(0.5), F.greatest(F.lit(0.3), F.col(value))).alias("confidence"))


def segment(bounds: DataFrame, boundaries: DataFrame, min_confidence: float = 0.55, series: str = SERIES, block_rows: int | None = None) -> DataFrame:
    """Contiguous half-open segments of bounds(series, start, end), cut at boundaries(series, frame, confidence) strictly inside."""
    cuts = boundaries.where(F.col("confidence") >= min_confidence).join(bounds, series).where((F.col("frame") > F.col("start")) & (F.col("frame") < F.col("end"))).select(series, "frame")
    marks = cuts.unionByName(bounds.select(series, F.col("start").alias("frame"))).unionByName(bounds.select(series, F.col("end").alias("frame"))).distinct()
    rows = numbered(marks, series, "frame", block_rows=block_rows)
    rows = shifted(rows, {"end": ("frame", 1)}, series, "frame", block_rows).withColumn("n", F.col(NUMBER) + 1).where("end is not null")
    return rows.select(series, F.format_string("shot-%04d", "n").alias("segment_id"), F.col("frame").alias("start"), "end")


def level_intervals(df: DataFrame, holds: Column, min_len: int, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """Half-open runs of rows for which the condition holds, of at least min_len rows; a run open at the end goes to the end."""
    runs = islands(df, holds, series, order, block_rows).groupBy(series, "island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= min_len).drop("island")


def rms_windows(df: DataFrame, n: int = 320, value: str = VALUE, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """Root mean square of disjoint windows of exactly n rows; a shorter tail is dropped."""
    rows = df.groupBy(series, F.floor(F.col(order) / n).alias("window")).agg(F.count("*").alias("__n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return rows.where(F.col("__n") == n).drop("__n")


def periodic_rhythm(onsets: DataFrame, time: str = "t_seconds", strength: str = "strength", strong: float = 0.65, series: str = SERIES) -> DataFrame:
    """(series, kind, start, end): one music span and a beat for each strong onset, where three or more come at a steady interval."""
    rows = onsets.where(F.col(strength) >= strong)
    rows = rows.withColumn("gap", F.col(time) - F.lag(time).over(along(series, time)))
    mid = rows.groupBy(series).agg(F.median("gap").alias("median"), F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    mad = rows.join(mid.select(series, "median"), series).groupBy(series).agg(F.median(F.abs(F.col("gap") - F.col("median"))).alias("mad"))
    steady = mid.join(mad, series).where((F.col("n") >= 3) & F.col("median").between(0.2, 2.0) & (F.col("mad") / F.col("median") <= 0.15))
    music = steady.select(series, F.lit("music").alias("kind"), F.col("first").alias("start"), F.col("last").alias("end"))
    return music.unionByName(rows.join(steady.select(series), series).select(series, F.lit("beat").alias("kind"), F.col(time).alias("start"), F.col(time).alias("end")))


def gradient(value: str, rate: float, w: WindowSpec, second_order: bool = True) -> Column:
    """Central differences at a fixed rate; one-sided at the ends, of second order where three rows exist; 0 for a lone row."""
    x, p1, p2, n1, n2 = F.col(value), F.lag(value).over(w), F.lag(value, 2).over(w), F.lead(value).over(w), F.lead(value, 2).over(w)
    first, last = n1 - x, x - p1
    if second_order:
        first = F.when(n2.isNotNull(), (-3 * x + 4 * n1 - n2) / 2).otherwise(n1 - x)
        last = F.when(p2.isNotNull(), (3 * x - 4 * p1 + p2) / 2).otherwise(x - p1)
    return F.when(p1.isNull() & n1.isNull(), 0.0).when(p1.isNull(), first).when(n1.isNull(), last).otherwise((n1 - p1) / 2) * rate


def finite_derivatives(df: DataFrame, rate: float, value: str = VALUE, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """velocity, acceleration and jerk by three rounds of differences, over one sort. A round looks at two rows on a side at most, so six reach all of them."""

    def derive(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order)
        rows = rows.withColumn("velocity", gradient(value, rate, w))
        rows = rows.withColumn("acceleration", gradient("velocity", rate, w))
        return rows.withColumn("jerk", gradient("acceleration", rate, w))

    return in_blocks(df, 6, derive, series, order, block_rows)


def hampel(df: DataFrame, half: int = 2, sigma: float = 3.5, value: str = VALUE, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """``outlier`` by the median and MAD of a centred window, and ``filtered``: outliers interpolated between their unflagged neighbours, however far those are."""
    columns = df.columns
    df = numbered(df, series, order, block_rows=block_rows)
    df = of_whole(df, {"__top": F.max(value), "__low": F.min(value)}, series, block_rows, order)

    def near(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
        return rows.withColumns({"__med": F.percentile(value, F.lit(0.5)).over(frame), "__near": F.collect_list(value).over(frame)})

    df = in_blocks(df, half, near, series, order, block_rows)
    dev = F.array_sort(F.transform("__near", lambda x: F.abs(x - F.col("__med"))))
    size = F.size(dev)
    mad = (F.element_at(dev, F.floor((size + 1) / 2).cast("int")) + F.element_at(dev, F.floor((size + 2) / 2).cast("int"))) / 2
    df = df.withColumn("outlier", F.abs(F.col(value) - F.col("__med")) > F.greatest(F.greatest(F.lit(1e-9), 0.02 * (F.col("__top") - F.col("__low"))), sigma * 1.4826 * mad)).drop("__near")
    good = F.when(~F.col("outlier"), F.struct(F.col(NUMBER).alias("n"), F.col(value).alias("x")))
    df = scan(df.withColumn("__down", -F.col(NUMBER)), {"__a": ("last", good, False)}, series, NUMBER, block_rows=block_rows).drop(BLOCK)
    df = scan(df, {"__b": ("last", good, False)}, series, "__down", block_rows=block_rows)
    between = F.col("__a.x") + (F.col("__b.x") - F.col("__a.x")) * (F.col(NUMBER) - F.col("__a.n")) / (F.col("__b.n") - F.col("__a.n"))
    return df.withColumn("filtered", F.when(~F.col("outlier"), F.col(value)).otherwise(F.coalesce(between, F.col("__a.x"), F.col("__b.x"), F.col(value)))).select(*columns, "outlier", "filtered")


CURVES = ("linear", "ease_in", "ease_out", "ease_in_out", "cubic_bezier", "hermite", "overshoot", "settle")
#: Control points of the Bezier easing.
BEZIER = (0.18, 0.82, 0.38, 1.0)


def classify_curve(df: DataFrame, value: str = VALUE, curves: tuple = CURVES, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, curve, error, confidence): the easing nearest to the normalised series over evenly spaced progress.

    Fewer than 4 rows: underdetermined; start and end equal: hold. One aggregation; the curves are columns, not rows.
    """
    from chronoform.functions.scalar import bezier_easing, easing

    w = along(series, order)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = df.withColumns({"a": first, "b": last, "p": (F.row_number().over(w) - 1) / (F.count("*").over(whole(series)) - 1)})
    rows = rows.withColumn("y", F.when(F.abs(F.col("b") - F.col("a")) >= 1e-8, (F.col(value) - F.col("a")) / (F.col("b") - F.col("a"))))
    if "cubic_bezier" in curves:
        rows = rows.withColumn("__bezier", bezier_easing(*BEZIER)(F.col("p")))
    eased = lambda c: F.col("__bezier") if c == "cubic_bezier" else easing(c, F.col("p"))
    errors = [F.sqrt(F.avg(F.pow(F.col("y") - eased(c), F.lit(2.0)))).alias(f"__{c}") for c in curves]
    out = rows.groupBy(series).agg(F.count("*").alias("n"), F.max(F.abs(F.col("b") - F.col("a"))).alias("delta"), *errors)
    ranked = F.array_sort(F.array(*[F.struct(F.col(f"__{c}").alias("error"), F.lit(i).alias("i"), F.lit(c).alias("curve")) for i, c in enumerate(curves)]))
    out = out.withColumn("ranked", ranked)
    best, second = F.element_at("ranked", 1), F.element_at("ranked", 2)
    separation = clamp((second["error"] - best["error"]) / F.greatest(second["error"], F.lit(1e-12)), 0.0, 1.0)
    fitted = (F.col("n") >= 4) & (F.col("delta") >= 1e-8)
    return out.select(
        series,
        F.when(F.col("n") < 4, "underdetermined").when(F.col("delta") < 1e-8, "hold").otherwise(best["curve"]).alias("curve"),
        F.when(fitted, best["error"]).otherwise(0.0).alias("error"),
        F.when(F.col("n") < 4, 0.0).when(F.col("delta") < 1e-8, 1.0).otherwise(clamp(0.55 * separation + 0.45 * F.exp(-12 * best["error"]), 0.0, 1.0)).alias("confidence"),
    )


def curve_driver(channels: DataFrame, ranks: dict[str, int], channel: str = "channel", value: str = "value", series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, driver, range): the channel with the widest range among those that end elsewhere than they start; by rank among equals."""
    agg = channels.groupBy(series, channel).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"), (F.max(value) - F.min(value)).alias("range"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(channel))
    rows = agg.where(F.abs(F.col("b") - F.col("a")) > 1e-6).withColumn("n", F.row_number().over(Window.partitionBy(series).orderBy(F.desc("range"), rank)))
    return agg.select(series).distinct().join(rows.where("n = 1").select(series, F.col(channel).alias("driver"), "range"), series, "left").select(series, F.coalesce("driver", F.lit("none")).alias("driver"), F.coalesce("range", F.lit(0.0)).alias("range"))


def phase_boundaries(df: DataFrame, value: str = VALUE, share: float = 0.08, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, onset, peak, settle): first and last rows of notable speed, and the first row of the greatest."""
    rows = df.withColumn("speed", F.abs(gradient(value, 1.0, along(series, order), second_order=False)))
    rows = rows.withColumn("top", F.max("speed").over(whole(series)))
    active = F.col("speed") >= F.greatest(F.lit(1e-9), share * F.col("top"))
    return rows.groupBy(series).agg(F.min(F.when(active, F.col(order))).alias("onset"), F.min(F.when(F.col("speed") == F.col("top"), F.col(order))).alias("peak"), F.max(F.when(active, F.col(order))).alias("settle"))


def path_curvature(df: DataFrame, x: str, y: str, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """Curvature of the path (x, y) at each row; 0 where it stands still."""
    w = along(series, order)
    df = df.withColumns({"__x1": gradient(x, 1.0, w, False), "__y1": gradient(y, 1.0, w, False)}).withColumns({"__x2": gradient("__x1", 1.0, w, False), "__y2": gradient("__y1", 1.0, w, False)})
    bottom = F.pow(F.col("__x1") * F.col("__x1") + F.col("__y1") * F.col("__y1"), F.lit(1.5))
    top = F.abs(F.col("__x1") * F.col("__y2") - F.col("__y1") * F.col("__x2"))
    return df.withColumn("curvature", F.when(bottom > 1e-12, top / bottom).otherwise(0.0)).drop("__x1", "__y1", "__x2", "__y2")


def overshoot(df: DataFrame, value: str = VALUE, tolerance: float | None = None, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, overshoot, below, above): whether a series leaves the band between its ends, widened by the tolerance (2% of the span if None)."""
    agg = df.groupBy(series).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    slack = F.lit(tolerance) if tolerance is not None else F.greatest(F.lit(1e-6), 0.02 * F.abs(F.col("b") - F.col("a")))
    below, above = F.greatest(F.lit(0.0), F.least("a", "b") - slack - F.col("lo")), F.greatest(F.lit(0.0), F.col("hi") - F.greatest("a", "b") - slack)
    return agg.select(series, ((below > 0) | (above > 0)).alias("overshoot"), below.alias("below"), above.alias("above"))


def path_overshoot(df: DataFrame, x: str, y: str, scale: str, rotation: str, scale_slack: float, rotation_slack: float, centre_slack: float, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, by_scale, by_rotation, by_centre, overshoot): whether scale or rotation leave the band between their ends, or the centre's progress
    along the line between its ends leaves [0, 1], each by more than its slack. A path that ends where it starts makes no progress.
    """
    ends = F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(scale).alias("s"), F.col(rotation).alias("r"))
    agg = df.groupBy(series).agg(F.min(ends).alias("a"), F.max(ends).alias("b"), F.min(scale).alias("s0"), F.max(scale).alias("s1"), F.min(rotation).alias("r0"), F.max(rotation).alias("r1"))
    agg = agg.withColumns({"dx": F.col("b.x") - F.col("a.x"), "dy": F.col("b.y") - F.col("a.y")}).withColumn("norm", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    along_line = F.when(F.col("norm") > 1e-12, ((F.col(x) - F.col("a.x")) * F.col("dx") + (F.col(y) - F.col("a.y")) * F.col("dy")) / F.col("norm")).otherwise(0.0)
    far = df.select(series, x, y).join(agg.select(series, "a", "dx", "dy", "norm"), series).withColumn("__p", along_line).groupBy(series).agg(F.min("__p").alias("p0"), F.max("__p").alias("p1"))
    out = lambda k, slack: (F.col(f"{k}0") < F.least(f"a.{k}", f"b.{k}") - slack) | (F.col(f"{k}1") > F.greatest(f"a.{k}", f"b.{k}") + slack)
    rows = agg.join(far, series).select(series, out("s", scale_slack).alias("by_scale"), out("r", rotation_slack).alias("by_rotation"), ((F.col("p0") < -centre_slack) | (F.col("p1") > 1 + centre_slack)).alias("by_centre"))
    return rows.withColumn("overshoot", F.col("by_scale") | F.col("by_rotation") | F.col("by_centre"))


def monotonicity(df: DataFrame, value: str = VALUE, tolerance: float = 0.005, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, direction, ratio): increasing, decreasing or none, and the share of steps that go one way within the tolerance."""
    step = df.withColumn("d", F.col(value) - F.lag(value).over(along(series, order)))
    up, down = F.avg(F.when(F.col("d").isNotNull(), (F.col("d") >= -tolerance).cast("double"))), F.avg(F.when(F.col("d").isNotNull(), (F.col("d") <= tolerance).cast("double")))
    direction = F.when(F.min("d") >= 0, "increasing").when(F.max("d") <= 0, "decreasing").otherwise("none")
    return step.groupBy(series).agg(direction.alias("direction"), F.coalesce(F.greatest(up, down), F.lit(0.0)).alias("ratio"))


def motion_summary(df: DataFrame, mean: str, p95: str, residual: str, found: str, segment_id: str = "segment", series: str = SERIES) -> DataFrame:
    """Per segment: mean motion, largest p95, residual and found ratios, class and confidence."""
    agg = df.groupBy(series, segment_id).agg(F.avg(mean).alias("mean"), F.max(p95).alias("p95"), F.avg(residual).alias("residual"), F.avg(F.col(found).cast("double")).alias("found"), F.count("*").alias("n"))
    kind = (
        F.when(F.col("n") <= 1, "unknown").when(F.col("mean") < 0.00015, "static").when((F.col("found") >= 0.5) & (F.col("residual") < 0.45), "global")
        .when((F.col("found") < 0.35) & (F.col("residual") >= 0.55), "independent").otherwise("mixed")
    )
    return agg.withColumns({"motion_class": kind, "confidence": clamp(0.55 + 0.35 * F.col("found"), 0.25, 0.98)})


#: Offsets from which a median speaks for a movement of the camera.
HYPOTHESES = (("pan", "dx", 0.0, 0.0005), ("tilt", "dy", 0.0, 0.0005), ("zoom", "scale", 1.0, 0.0005), ("rotation", "rotation", 0.0, 0.03))


def camera_hypotheses(df: DataFrame, found: str, segment_id: str = "segment", series: str = SERIES) -> DataFrame:
    """(series, segment, hypotheses): movements whose median over the rows with a transform is off by enough. df has dx, dy, scale and rotation."""
    medians = [F.median(F.when(F.col(found), F.col(c))).alias(f"__{name}") for name, c, _, _ in HYPOTHESES]
    out = df.groupBy(series, segment_id).agg(*medians)
    return out.select(series, segment_id, F.array_compact(F.array(*[F.when(F.abs(F.col(f"__{name}") - rest) >= least, name) for name, _, rest, least in HYPOTHESES])).alias("hypotheses"))


def quarter_phases(df: DataFrame, segments: DataFrame, magnitude: str, segment_id: str = "segment", series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, segment, role, start, end, confidence): the quarters of segments(start, end) of 4 rows or more; the peak is surer if the largest magnitude lies in it."""
    top = df.groupBy(series, segment_id).agg((-F.max(F.struct(F.col(magnitude), (-F.col(order)).alias("o")))["o"]).alias("__at"))
    rows = segments.where(F.col("end") - F.col("start") >= 4).join(top, [series, segment_id], "left")
    d = F.col("end") - F.col("start")
    points = [F.col("start"), F.col("start") + F.floor(d / 4), F.col("start") + F.floor(d / 2), F.col("start") + F.floor(3 * d / 4), F.col("end")]
    phase = lambda role, a, b: F.struct(F.lit(role).alias("role"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    rows = rows.select(series, segment_id, "__at", F.inline(F.array(*[phase(r, a, b) for r, a, b in zip(("onset", "development", "peak", "settle"), points, points[1:], strict=False)])))
    sure = (F.col("role") == "peak") & (F.col("__at") >= F.col("start")) & (F.col("__at") < F.col("end"))
    return rows.select(series, segment_id, "role", "start", "end", F.when(sure, 0.8).otherwise(0.65).alias("confidence"))


def dominant_model(df: DataFrame, model: str = "kind", series: str = SERIES, order: str = ORDER, unknown: str = "unknown") -> DataFrame:
    """(series, model, mismatch): unknown if a quarter of the rows are; else the most frequent known one, the first seen among equals."""
    counts = df.groupBy(series, model).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    counts = counts.withColumn("total", F.sum("n").over(whole(series)))
    agg = counts.groupBy(series).agg(
        F.max(F.when(F.col(model) == unknown, F.col("n") / F.col("total"))).alias("unknown_share"),
        F.max(F.when(F.col(model) != unknown, F.struct("n", -F.col("seen"), F.col(model).alias("model"), "total"))).alias("best"),
        F.sum(F.when(F.col(model) != unknown, F.col("n"))).alias("known"),
    )
    is_unknown = (F.coalesce("unknown_share", F.lit(0.0)) >= 0.25) | F.col("best").isNull()
    minority = (F.col("known") - F.col("best.n")) / F.col("best.total")
    return agg.select(series, F.when(is_unknown, unknown).otherwise(F.col("best.model")).alias("model"), F.coalesce(minority >= 0.30, F.lit(False)).alias("mismatch"))


def activity_stats(df: DataFrame, value: str = VALUE, still: float = 0.008, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, mean, p90, static_share) of the absolute change between neighbouring rows; a series of one row is static."""
    d = df.withColumn("d", F.abs(F.col(value) - F.lag(value).over(along(series, order))))
    return d.groupBy(series).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean"), F.coalesce(F.percentile("d", F.lit(0.9)), F.lit(0.0)).alias("p90"), F.coalesce(F.avg(F.when(F.col("d").isNotNull(), (F.col("d") < still).cast("double"))), F.lit(1.0)).alias("static_share"))


def ambiguous_rows(df: DataFrame, limits: DataFrame, confidence: str, model: str, outlier: str, residual: str, series: str = SERIES) -> DataFrame:
    """Rows of low confidence, unknown model, outliers, or with a residual above the series' limit."""
    rows = df.join(limits.select(series, F.col("threshold").alias("__limit")), series)
    return rows.where((F.col(confidence) < 0.6) | (F.col(model) == "unknown") | F.col(outlier) | (F.col(residual) > F.col("__limit"))).drop("__limit")


def time_warp(df: DataFrame, anchors: DataFrame, value: str = VALUE, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """The series resampled through a piecewise linear map: anchors(series, output, source) say which source row each output row shows.

    One range join to the anchor segment (hash-joined on the series), then two equi-joins on the rows below and above.
    """
    seg = anchors.withColumns({"output2": F.lead("output").over(Window.partitionBy(series).orderBy("output")), "source2": F.lead("source").over(Window.partitionBy(series).orderBy("output"))}).where("output2 is not null")
    outs = seg.withColumn("last", F.lead("output2").over(Window.partitionBy(series).orderBy("output")).isNull())
    outs = outs.select(series, "output", "output2", "source", "source2", F.explode(F.sequence(F.ceil("output").cast("long"), F.when(F.col("last"), F.floor("output2")).otherwise(F.ceil("output2") - 1).cast("long"))).alias("out"))
    at = F.col("source") + (F.col("source2") - F.col("source")) * (F.col("out") - F.col("output")) / (F.col("output2") - F.col("output"))
    outs = outs.select(series, "out", at.alias("shown")).withColumns({"below": F.floor("shown").cast("long"), "above": F.ceil("shown").cast("long")})
    low = df.select(series, F.col(order).alias("below"), F.col(value).alias("__lo"))
    high = df.select(series, F.col(order).alias("above"), F.col(value).alias("__hi"))
    joined = outs.join(low, [series, "below"]).join(high, [series, "above"])
    return joined.select(series, F.col("out").alias(order), "shown", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("shown") - F.col("below"))).alias(value))


def warp_slopes(anchors: DataFrame, series: str = SERIES) -> DataFrame:
    """(series, bend, largest, n): how far the slopes between anchors are from 1, with the mean shift as regularisation."""
    w = Window.partitionBy(series).orderBy("output")
    rows = anchors.withColumns({"slope": (F.col("source") - F.lag("source").over(w)) / (F.col("output") - F.lag("output").over(w)), "shift": F.abs(F.col("source") - F.col("output"))})
    return rows.groupBy(series).agg((F.sum(F.pow(F.col("slope") - 1, F.lit(2.0))) + 2 * F.avg("shift")).alias("bend"), F.max(F.abs(F.col("slope") - 1)).alias("largest"), F.count("slope").alias("n"))


def binding_continuity(rows: DataFrame, spec: str, ord_: str, group: str, start: str, end: str, speed: str, frames: str) -> DataFrame:
    """Rows that break continuity with the row before of their group: a gap, a jump of speed, or a wrong number of frames."""
    w = Window.partitionBy(spec, group).orderBy(ord_)
    prev_end, prev_speed = F.lag(end).over(w), F.lag(speed).over(w)
    ratio = F.greatest(F.col(speed) / prev_speed, prev_speed / F.col(speed))
    wanted = F.greatest(F.lit(1), F.bround(F.col(frames) * F.col(speed)).cast("long"))
    checked = rows.withColumns({"gap": F.coalesce(prev_end != F.col(start), F.lit(False)), "speed_jump": F.coalesce(ratio > 4, F.lit(False)), "wrong_duration": F.col(end) - F.col(start) != wanted})
    return checked.where("gap or speed_jump or wrong_duration")


def focus_breaks(rows: DataFrame, spec: str, ord_: str, group: str, focus_start: str, focus_end: str) -> DataFrame:
    """Rows whose focus does not begin where that of the row before ends, if both are of the same continuity group."""
    w = Window.partitionBy(spec).orderBy(ord_)
    same = F.col(group) == F.lag(group).over(w)
    return rows.withColumn("__broken", F.coalesce(same & ~F.col(focus_start).eqNullSafe(F.lag(focus_end).over(w)), F.lit(False))).where("__broken").drop("__broken")


def order_breaks(rows: DataFrame, spec: str, ord_: str, part: str, segment_order: str) -> DataFrame:
    """Rows whose segment order does not count from one within each run of rows of the same part."""
    w = Window.partitionBy(spec).orderBy(ord_)
    new = ~F.col(part).eqNullSafe(F.lag(part).over(w)) | (F.row_number().over(w) == 1)
    runs = rows.withColumn("__new", new.cast("long")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.withColumn("expected", F.row_number().over(Window.partitionBy(spec, "__run").orderBy(ord_)))
    return runs.where(F.col(segment_order) != F.col("expected")).drop("__new", "__run")


def group_reappears(rows: DataFrame, spec: str, ord_: str, group: str) -> DataFrame:
    """(spec, group): groups whose rows are not together in the order."""
    w = Window.partitionBy(spec).orderBy(ord_)
    starts = rows.withColumn("__new", ~F.col(group).eqNullSafe(F.lag(group).over(w)) | (F.row_number().over(w) == 1))
    return starts.groupBy(spec, group).agg(F.sum(F.col("__new").cast("long")).alias("runs")).where("runs > 1")


def study_deltas(passes: DataFrame, study: str, pass_: str, metric: str, value: str) -> DataFrame:
    """Each metric's change against the pass before."""
    w = Window.partitionBy(study, metric).orderBy(pass_)
    return passes.withColumn("delta", F.col(value) - F.lag(value).over(w))


def same_candidates(passes: DataFrame, study: str, pass_: str, candidate: str) -> DataFrame:
    """passes with ``same``: whether the candidate is that of the pass before; false for the first."""
    w = Window.partitionBy(study).orderBy(pass_)
    return passes.withColumn("same", F.coalesce(F.col(candidate) == F.lag(candidate).over(w), F.lit(False)))


def selection_gate(passes: DataFrame, study: str, selected: Column, passed: Column) -> DataFrame:
    """(study, n_selected, ok): exactly one selected pass, and it passes."""
    return passes.groupBy(study).agg(F.sum(selected.cast("long")).alias("n_selected"), F.sum((selected & passed).cast("long")).alias("__ok")).select(study, "n_selected", ((F.col("n_selected") == 1) & (F.col("__ok") == 1)).alias("ok"))


def bounded_retime(df: DataFrame, start: int, end: int, power: float, value: str = VALUE, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """Rows of [start, end] shown at start + span p^power of their progress p, linearly interpolated; all other rows stay."""
    span = end - start
    at = F.when(F.col(order).between(start, end), start + span * F.pow((F.col(order) - start) / span, F.lit(power))).otherwise(F.col(order).cast("double"))
    w = whole(series)
    rows = df.withColumn("at", F.least(at, F.max(order).over(w).cast("double"))).withColumns({"below": F.floor("at").cast("long"), "above": F.ceil("at").cast("long")})
    low, high = df.select(series, F.col(order).alias("below"), F.col(value).alias("__lo")), df.select(series, F.col(order).alias("above"), F.col(value).alias("__hi"))
    joined = rows.join(low, [series, "below"]).join(high, [series, "above"])
    return joined.withColumn("retimed", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("at") - F.col("below"))).drop("__lo", "__hi", "below", "above")


def validate_partition(segments: DataFrame, bounds: DataFrame, series: str = SERIES) -> DataFrame:
    """(series, problem): segments that do not start, follow on or end as their range does, or share an id."""
    w = Window.partitionBy(series).orderBy("start")
    rows = segments.withColumn("next", F.lead("start").over(w))
    gap = rows.where("next is not null and next <> end").select(series, F.lit("gap").alias("problem"))
    ends = segments.groupBy(series).agg(F.min("start").alias("a"), F.max("end").alias("b"), F.count("*").alias("n"), F.count_distinct("segment_id").alias("ids")).join(bounds.select(series, F.col("start").alias("lo"), F.col("end").alias("hi")), series)
    return gap.unionByName(ends.where("a <> lo").select(series, F.lit("start").alias("problem"))).unionByName(ends.where("b <> hi").select(series, F.lit("end").alias("problem"))).unionByName(ends.where("n <> ids").select(series, F.lit("duplicate id").alias("problem")))


def circular_mean(df: DataFrame, angle: str, series: str = SERIES) -> DataFrame:
    """(series, mean): mean direction in degrees, null for no rows."""
    mean = F.atan2(F.avg(F.sin(F.radians(col(angle)))), F.avg(F.cos(F.radians(col(angle)))))
    return df.groupBy(series).agg(F.degrees(mean).alias("mean"))
