"""Interval algebra and timelines over half-open ranges (start, end)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .blocks import BLOCK, scan

SERIES = "series_id"


def merge_ranges(ranges: DataFrame, series: str = SERIES, block_rows: int | None = None) -> DataFrame:
    """Overlapping or touching ranges of a series as one, with the number merged. A range that reaches over block borders is one."""
    rows = scan(ranges, {"__far": ("max", F.col("end"), False)}, series, "start", "end", block_rows=block_rows)
    rows = rows.withColumn("__new", F.coalesce((F.col("start") > F.col("__far")).cast("long"), F.lit(1)))
    rows = scan(rows, {"__g": ("sum", F.col("__new"), True)}, series, "start", "end", block_rows=block_rows)
    return rows.groupBy(series, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("__g")


def gaps(segments: DataFrame, totals: DataFrame, tolerance: float = 0.05, series: str = SERIES, block_rows: int | None = None) -> DataFrame:
    """Spans of [0, total) longer than the tolerance that no segment covers, the tail included; totals(series, total)."""
    marked = segments.select(series, "start", "end").unionByName(totals.select(series, F.col("total").alias("start"), F.col("total").alias("end")))
    rows = scan(marked, {"__far": ("max", F.col("end"), False)}, series, "start", "end", block_rows=block_rows)
    rows = rows.withColumn("__from", F.coalesce(F.greatest(F.col("__far"), F.lit(0)), F.lit(0)))
    return rows.where(F.col("start") - F.col("__from") > tolerance).select(series, F.col("__from").alias("start"), F.col("start").alias("end"))


def keep_complement(silences: DataFrame, totals: DataFrame, pad: float = 0.08, minimum: float = 0.12, series: str = SERIES) -> DataFrame:
    """What stays when padded silences are cut out of [0, total): spans of at least the minimum; the whole range if none does.

    The silences of a series are disjoint and sorted by start, as :func:`merge_ranges` returns them: the cursor is the end of the one before.
    """
    rows = silences.join(totals, series).select(series, "start", "end", "total")
    w = Window.partitionBy(series).orderBy("start")
    rows = rows.withColumns({"__a": F.greatest(F.lit(0.0), F.lag("end").over(w) - pad), "__b": F.greatest(F.lit(0.0), F.col("start") + pad), "__last": F.lead("start").over(w).isNull()})
    head = rows.select(series, F.coalesce("__a", F.lit(0.0)).alias("start"), F.least("__b", "total").alias("end"))
    tail = rows.where("__last").select(series, F.greatest(F.lit(0.0), F.col("end") - pad).alias("start"), F.col("total").cast("double").alias("end"))
    kept = head.unionByName(tail).where(F.col("end") - F.col("start") >= minimum)
    none = totals.join(kept.select(series).distinct(), series, "left_anti").select(series, F.lit(0.0).alias("start"), F.col("total").cast("double").alias("end"))
    return kept.unionByName(none)


def pack_timeline(clips: DataFrame, fps: float, order: str = "seq", series: str = SERIES, block_rows: int | None = None) -> DataFrame:
    """Clips laid one after another: frames = max(1, half-even seconds x fps), out_start = the sum of those before."""
    frames = F.greatest(F.lit(1), F.bround((F.col("end") - F.col("start")) * fps).cast("long"))
    rows = scan(clips.withColumn("frames", frames), {"out_start": ("sum", F.col("frames"), False)}, series, order, block_rows=block_rows)
    return rows.withColumn("out_start", F.coalesce("out_start", F.lit(0))).drop(BLOCK)


def montage(segments: DataFrame, fps: float, shortest: float = 0.35, first: int = 6, longest: float = 2.5, series: str = SERIES) -> DataFrame:
    """The first segments of each asset that are long enough, each cut to the longest, packed one after another; an asset with none gives all of it."""
    whole = segments.groupBy(series).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    fit = segments.where(F.col("end") - F.col("start") >= shortest).select(series, "start", "end")
    rows = fit.unionByName(whole.join(fit.select(series).distinct(), series, "left_anti").select(series, "start", "end"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(series).orderBy("start", "end"))).where(F.col("n") <= first)
    frames = F.least(F.greatest(F.lit(1), F.bround((F.col("end") - F.col("start")) * fps).cast("long")), F.bround(F.lit(longest * fps)).cast("long"))
    before = Window.partitionBy(series).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("frames", frames).withColumn("out_start", F.coalesce(F.sum("frames").over(before), F.lit(0)))


def resequence(clips: DataFrame, reverse: bool = False, sparse: bool = False, order: str = "seq", frames: str = "frames", series: str = SERIES) -> DataFrame:
    """Clips in reverse order and/or every second one, packed again from zero."""
    w = Window.partitionBy(series).orderBy(F.desc(order) if reverse else F.asc(order))
    rows = clips.withColumn("n", F.row_number().over(w) - 1)
    rows = rows.where("n % 2 = 0") if sparse else rows
    before = Window.partitionBy(series).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("out_start", F.coalesce(F.sum(frames).over(before), F.lit(0)))


def validate_timeline(clips: DataFrame, durations: DataFrame, layered: tuple = ("audio", "caption"), series: str = SERIES) -> DataFrame:
    """(series, clip_id, problem): overlaps on a track that is not layered, repeated ids, clips beyond the duration."""
    w = Window.partitionBy(series, "track_id").orderBy("start", "clip_id")
    late = clips.where(~F.col("track_kind").isin(*layered)).withColumn("__next", F.lead("start").over(w)).where("__next < end").select(series, "clip_id", F.lit("overlap").alias("problem"))
    twice = clips.groupBy(series, "clip_id").count().where("count > 1").select(series, "clip_id", F.lit("duplicate id").alias("problem"))
    beyond = clips.join(durations, series).where(F.col("end") > F.col("duration")).select(series, "clip_id", F.lit("beyond end").alias("problem"))
    return late.unionByName(twice).unionByName(beyond)


def focused_ranges(unresolved: DataFrame, bounds: DataFrame, first: int = 8, pad: int = 6, series: str = SERIES) -> DataFrame:
    """The first merged ranges, padded within [lo, hi), with both ends as pins; bounds(series, lo, hi)."""
    merged = merge_ranges(unresolved, series).withColumn("n", F.row_number().over(Window.partitionBy(series).orderBy("start"))).where(F.col("n") <= first)
    rows = merged.drop("n").join(bounds, series).withColumns({"start": F.greatest("lo", F.col("start") - pad), "end": F.least("hi", F.col("end") + pad)}).where("end > start")
    return rows.select(series, "start", "end", F.array(F.col("start"), F.col("end") - 1).alias("pins"))


def seconds_to_frames(spans: DataFrame, fps: float, limit: str, series: str = SERIES) -> DataFrame:
    """Half-even frames of (start, end) seconds, kept within [0, limit); empty ones are dropped."""
    at = lambda c: F.least(F.greatest(F.bround(F.col(c) * fps).cast("long"), F.lit(0)), F.col(limit))
    return spans.withColumns({"first": at("start"), "last": at("end")}).where("last > first")


def editorial_roles(scenes: DataFrame, score: str, order: str = "seq", series: str = SERIES) -> DataFrame:
    """A role for each scene: first hook, highest score within as climax (second last if that is an end), last conclusion, second setup, else development."""
    w = Window.partitionBy(series)
    rows = scenes.withColumns({"n": F.row_number().over(w.orderBy(order)), "total": F.count("*").over(w), "__top": F.row_number().over(w.orderBy(F.desc(score), order)) == 1})
    rows = rows.withColumn("__top", F.max(F.when(F.col("__top"), F.col("n"))).over(w))
    climax = F.when((F.col("__top") > 1) & (F.col("__top") < F.col("total")), F.col("__top")).otherwise(F.col("total") - 1)
    role = F.when(F.col("n") == 1, "hook").when(F.col("n") == F.col("total"), "conclusion").when((F.col("n") == climax) & (F.col("total") > 2), "climax").when(F.col("n") == 2, "setup").otherwise("development")
    return rows.withColumn("role", role).drop("__top", "total")


#: Documents whose operations are Python objects at the same time.
DOCUMENTS_AT_ONCE = 128


def failed_patches(ops: list[dict]) -> list[str]:
    """The patches of one document, in order, that hold a ``test`` that fails. A failed patch is undone before the next one begins, so later ones see what was before it."""
    state: dict[str, str | None] = {}
    undo, failed, current = [], [], None
    for o in ops:
        if o["patch"] != current:
            undo, current = [], o["patch"]
        if failed and failed[-1] == current:
            continue
        if o["op"] == "test":
            if state.get(o["path"]) != o["value"]:
                failed.append(current)
                for path, value in reversed(undo):
                    state[path] = value
        else:
            undo.append((o["path"], state.get(o["path"])))
            state[o["path"]] = None if o["op"] == "remove" else o["value"]
    return failed


def patch_log(ops: DataFrame, doc: str = "doc_id", path: str = "path", order: str = "seq", patch: str | None = None) -> DataFrame:
    """Each change of a scalar path with the value before: the inverse log, to be applied from the last to the first.

    A patch is the operations of one ``patch`` id, which follow one another in the order; without it all of a document are one. A patch with a ``test`` that does not
    hold is aborted as a whole and changes nothing: its operations have no inverse, and what comes later sees the state before it. An inverse of a
    first ``add`` is a remove. Only operations on paths that a document tests are walked in order, one document a row; the rest are windows by path.
    """
    rows = ops.withColumn("__patch", F.col(patch).cast("string") if patch else F.lit("0"))
    tested = rows.where(F.col("op") == "test").select(doc, path).distinct()
    lists = rows.join(tested, [doc, path]).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col("__patch").alias("patch"), F.col(path).alias("path"), "op", "value"))).alias("ops"))

    @F.arrow_udf("array<string>")
    def failures(groups: pa.Array) -> pa.Array:
        # a batch may hold 10,000 documents, whose operations as objects take many times what its columns do
        some = lambda at: pa.array([failed_patches(list(g)) for g in groups.slice(at, DOCUMENTS_AT_ONCE).to_pandas()], pa.list_(pa.string()))
        return pa.concat_arrays([some(at) for at in range(0, len(groups), DOCUMENTS_AT_ONCE)] or [pa.array([], pa.list_(pa.string()))])

    failed = lists.select(doc, F.explode(failures("ops")).alias("__patch")).distinct().withColumn("__failed", F.lit(True))
    rows = rows.join(failed, [doc, "__patch"], "left").withColumn("aborted", F.coalesce("__failed", F.lit(False)))
    before = Window.partitionBy(doc, path).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("aborted"), None).when(F.col("op").isin("add", "replace"), F.struct(F.col("value").alias("v"))).when(F.col("op") == "remove", F.struct(F.lit(None).cast("string").alias("v")))
    rows = rows.withColumn("before", F.last(state, ignorenulls=True).over(before)["v"])
    inverse = F.when(F.col("aborted"), None).when(F.col("op") == "test", "test").when(F.col("before").isNull(), "remove").when(F.col("op") == "remove", "add").otherwise("replace")
    return rows.withColumns({"inverse_op": inverse, "inverse_value": F.when(~F.col("aborted"), F.col("before"))}).drop("before", "__patch", "__failed")


def curve_segments(keys: DataFrame, times: DataFrame, values: tuple[str, ...], order: str, series: str, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(times within a segment, with x0, x1, p and for each value v its v_0 and v_1, and so for the columns of ``also``; times outside with the value held there)."""
    from .joins import point_in_range

    w = Window.partitionBy(series).orderBy(order)
    ends = [F.col(c).alias(f"{c}_0") for c in (*values, *also)] + [F.lead(c).over(w).alias(f"{c}_1") for c in (*values, *also)]
    seg = keys.select(series, F.col(order).alias("start"), F.lead(order).over(w).alias("end"), *ends).where("end is not null")
    held = F.struct(F.col(order).alias("o"), *values)
    edge = keys.groupBy(series).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"), F.min_by(held, order).alias("__first"), F.max_by(held, order).alias("__last"))
    rows = times.join(edge, series)
    at_end = lambda v: F.when(F.col("t") < F.col("__lo"), F.col(f"__first.{v}")).otherwise(F.col(f"__last.{v}"))
    outside = rows.where("t < __lo or t >= __hi").select(series, "t", *[at_end(v).alias(v) for v in values])
    inner = point_in_range(rows.where("t >= __lo and t < __hi").select(series, "t"), seg, order="t", series=series)
    inner = inner.withColumns({"x0": F.col("start").cast("double"), "x1": F.col("end").cast("double")}).withColumn("p", (F.col("t") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return inner, outside


def blend(p: Column, span: Column, y0: Column, y1: Column, m0: Column, m1: Column) -> Column:
    """The cubic from y0 to y1 with slopes m0 and m1 over a span, at progress p."""
    return (2 * p * p * p - 3 * p * p + 1) * y0 + (-2 * p * p * p + 3 * p * p) * y1 + (p * p * p - 2 * p * p + p) * span * m0 + (p * p * p - p * p) * span * m1


def monotone_tangents(keys: DataFrame, value: str, order: str = "seq", series: str = SERIES) -> DataFrame:
    """keys with ``m``: the harmonic mean of the slopes on either side, weighted by their widths; 0 where they differ in sign; the one slope at an end."""
    w = Window.partitionBy(series).orderBy(order)
    h = F.col(order) - F.lag(order).over(w)
    rows = keys.withColumns({"__h": h, "__s": (F.col(value) - F.lag(value).over(w)) / h})
    rows = rows.withColumns({"__h1": F.lead("__h").over(w), "__s1": F.lead("__s").over(w)})
    a, b = 2 * F.col("__h1") + F.col("__h"), F.col("__h1") + 2 * F.col("__h")
    inner = F.when(F.col("__s") * F.col("__s1") > 0, (a + b) / (a / F.col("__s") + b / F.col("__s1"))).otherwise(0.0)
    return rows.withColumn("m", F.coalesce(F.when(F.col("__s").isNull(), F.col("__s1")).when(F.col("__s1").isNull(), F.col("__s")).otherwise(inner), F.lit(0.0))).drop("__h", "__s", "__h1", "__s1")


def densify_curve(keys: DataFrame, times: DataFrame, mode: str = "linear", value: str | tuple[str, ...] = "value", order: str = "seq", series: str = SERIES) -> DataFrame:
    """Values of a keyframe curve at times(series, t): held before the first and after the last key; between, by mode.

    hold, linear, hermite (flat at the keys), monotone (tangents of :func:`monotone_tangents`) or tangents (for each value v the columns v_in and v_out are the
    slopes before and after a key). Several values are the coordinates of one path. The time meets its segment by a bucketed range join.
    """
    values = (value,) if isinstance(value, str) else tuple(value)
    also: list[str] = []
    for v in values:
        if mode == "monotone":
            keys = monotone_tangents(keys, v, order, series).withColumnRenamed("m", f"__m_{v}")
            also.append(f"__m_{v}")
        elif mode == "tangents":
            also += [f"{v}_in", f"{v}_out"]
    inner, outside = curve_segments(keys, times, values, order, series, tuple(also))
    p, span, none = F.col("p"), F.col("x1") - F.col("x0"), F.lit(0.0)
    out = []
    for v in values:
        y0, y1 = F.col(f"{v}_0"), F.col(f"{v}_1")
        slopes = {"monotone": (f"__m_{v}_0", f"__m_{v}_1"), "tangents": (f"{v}_out_0", f"{v}_in_1")}.get(mode)
        at = {"hold": y0, "linear": y0 + (y1 - y0) * p}.get(mode)
        out.append((at if at is not None else blend(p, span, y0, y1, *(map(F.col, slopes) if slopes else (none, none)))).alias(v))
    return inner.select(series, "t", *out).unionByName(outside)


def bezier_parameter(steps: int = 12):
    """The parameter at which a cubic Bezier of times (x0, a, b, x1) is at t, as a vectorised function: Newton steps kept between bounds that close in on it."""

    @F.pandas_udf("double")
    def solve(t: pd.Series, x0: pd.Series, a: pd.Series, b: pd.Series, x1: pd.Series) -> pd.Series:
        t, x0, a, b, x1 = (c.to_numpy(float) for c in (t, x0, a, b, x1))
        lo, hi = np.zeros(len(t)), np.ones(len(t))
        u = np.clip((t - x0) / (x1 - x0), 0, 1)
        for _ in range(steps):
            v = 1 - u
            off = v**3 * x0 + 3 * v * v * u * a + 3 * v * u * u * b + u**3 * x1 - t
            slope = 3 * v * v * (a - x0) + 6 * v * u * (b - a) + 3 * u * u * (x1 - b)
            done = np.abs(off) <= 1e-12
            lo, hi = np.where(off < 0, u, lo), np.where(off < 0, hi, u)
            step = u - off / np.where(np.abs(slope) > 1e-12, slope, np.inf)
            inside = (np.abs(slope) > 1e-12) & (step > lo) & (step < hi)
            u = np.where(done, u, np.where(inside, step, (lo + hi) / 2))
        return pd.Series(u)

    return solve


def densify_bezier(keys: DataFrame, times: DataFrame, value: str | tuple[str, ...] = "value", order: str = "seq", series: str = SERIES) -> DataFrame:
    """A curve of cubic Bezier segments at times(series, t): keys have out_t and in_t, the handles' offsets in time, and for each value v its v_out and v_in offsets.

    A path's coordinates share the handles' times, so the parameter is solved once a time.
    """
    values = (value,) if isinstance(value, str) else tuple(value)
    inner, outside = curve_segments(keys, times, values, order, series, ("out_t", "in_t", *[f"{v}_{d}" for v in values for d in ("out", "in")]))
    rows = inner.withColumn("u", bezier_parameter()(F.col("t").cast("double"), "x0", F.col("x0") + F.col("out_t_0"), F.col("x1") + F.col("in_t_1"), "x1"))
    u = F.col("u")
    at = lambda v: (1 - u) * (1 - u) * (1 - u) * F.col(f"{v}_0") + 3 * (1 - u) * (1 - u) * u * (F.col(f"{v}_0") + F.col(f"{v}_out_0")) + 3 * (1 - u) * u * u * (F.col(f"{v}_1") + F.col(f"{v}_in_1")) + u * u * u * F.col(f"{v}_1")
    return rows.select(series, "t", *[at(v).alias(v) for v in values]).unionByName(outside)


def densify_matrix(keys: DataFrame, times: DataFrame, mode: str = "linear", matrix: str = "m", order: str = "seq", series: str = SERIES) -> DataFrame:
    """(series, t, matrix): a curve of 3 x 3 matrices (arrays of 9) element by element; hold, linear or tangents (columns ``<matrix>_in`` and ``<matrix>_out``).

    Between keys the result is divided by its last element unless that is 0; a singular one fails the query.
    """
    inner, outside = curve_segments(keys, times, (matrix,), order, series, (f"{matrix}_in", f"{matrix}_out") if mode == "tangents" else ())
    p, span, a, b = F.col("p"), F.col("x1") - F.col("x0"), F.col(f"{matrix}_0"), F.col(f"{matrix}_1")
    if mode == "hold":
        mixed = a
    elif mode == "linear":
        mixed = F.zip_with(a, b, lambda x, y: x + (y - x) * p)
    else:
        mixed = F.zip_with(F.arrays_zip(a.alias("y"), F.col(f"{matrix}_out_0").alias("m")), F.arrays_zip(b.alias("y"), F.col(f"{matrix}_in_1").alias("m")), lambda s, e: blend(p, span, s["y"], e["y"], s["m"], e["m"]))
    rows = inner.select(series, "t", mixed.alias("__m"))
    last = F.get("__m", F.lit(8))
    rows = rows.select(series, "t", F.when(F.abs(last) > 1e-12, F.transform("__m", lambda x: x / last)).otherwise(F.col("__m")).alias(matrix))
    m = [F.get(matrix, F.lit(i)) for i in range(9)]
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    sound = F.when(F.abs(det) > 1e-12, F.col(matrix)).otherwise(F.raise_error(F.lit("an interpolated matrix is singular")).cast("array<double>"))
    return rows.select(series, "t", sound.alias(matrix)).unionByName(outside)


def curve_extrema(keys: DataFrame, densify, parts: int = 64, order: str = "seq", value: str = "value", series: str = SERIES) -> DataFrame:
    """(series, least, most) of a curve seen at ``parts`` evenly spaced times of each segment and at its last key; densify(keys, times) gives its values."""
    w = Window.partitionBy(series).orderBy(order)
    spans = keys.select(series, F.col(order).alias("a"), F.lead(order).over(w).alias("b"))
    inside = spans.where("b is not null").select(series, F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / parts)).alias("t"))
    times = inside.unionByName(spans.where("b is null").select(series, F.col("a").cast("double").alias("t")))
    return densify(keys, times).groupBy(series).agg(F.min(value).alias("least"), F.max(value).alias("most"))


@F.pandas_udf(LongType())
def common_divisor(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(np.int64), b.to_numpy(np.int64)))


def retime_curve(keys: DataFrame, source: tuple[int, int], target: tuple[int, int], order: str = "seq", tangents: tuple[str, ...] = (), handles: tuple[str, ...] = ()) -> DataFrame:
    """keys with their times moved from the source range to the target range, exactly: ``num`` over ``den`` in lowest terms; slopes and handle times follow.

    A source that does not hold a key fails the query.
    """
    (a, b), (c, d) = source, target
    if a >= b or c >= d:
        raise ValueError("ranges must have a positive length")
    k = F.when(F.col(order).between(a, b), F.col(order).cast("long")).otherwise(F.raise_error(F.lit("a key lies outside the source range")).cast("long"))
    num, den = F.lit(c * (b - a)).cast("long") + (k - a) * (d - c), F.lit(b - a).cast("long")
    rows = keys.withColumns({"num": num, "den": den})
    rows = rows.withColumn("__g", common_divisor("num", "den"))
    scale = (d - c) / (b - a)
    rows = rows.withColumns({"num": (F.col("num") / F.col("__g")).cast("long"), "den": (F.col("den") / F.col("__g")).cast("long")} | {t: F.col(t) / scale for t in tangents} | {h: F.col(h) * scale for h in handles})
    return rows.drop("__g")


def event_timeline(*parts: DataFrame, totals: DataFrame, series: str = SERIES) -> DataFrame:
    """All events (series, kind, start, end, strength) clipped to [0, total), with their place in order of (start, end, kind)."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.join(totals, series).withColumns({"start": F.greatest(F.lit(0.0), F.col("start").cast("double")), "end": F.least(F.col("total").cast("double"), F.col("end").cast("double"))}).where("end >= start").drop("total")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(series).orderBy("start", "end", "kind", "strength")))
