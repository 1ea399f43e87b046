"""Ordered folds and fits that windows cannot express, one series (or a bounded part of one) a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoform.functions.scalar import clamp
from chronoform.sources.storage import cut

from .blocks import NUMBER, in_blocks, numbered, shifted
from .blocks import whole as of_whole

SERIES, ORDER, VALUE = "series_id", "seq", "signal"


def classify_transition(groups: DataFrame, samples: DataFrame, external: DataFrame | None = None, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """(series, start, end, type, confidence, win_start, win_end) for each group of rows: the first rule that its shape meets.

    groups(series, start, end) meet their rows and three on either side in a bucketed range join; the shape is then one aggregation and
    the rules one expression. samples have pixel, hist, asym, combined and luminance.
    """
    from .joins import point_in_range

    wide = groups.select(series, F.greatest(F.lit(1), F.col("start") - 3).alias("start"), (F.col("end") + 3).alias("end"), F.col("start").alias("g0"), F.col("end").alias("g1"))
    rows = point_in_range(samples.select(series, order, "pixel", "hist", "asym", "combined", "luminance"), wide, order, series)
    inside = (F.col(order) >= F.col("g0")) & (F.col(order) < F.col("g1"))
    only = lambda c: F.when(inside, c)
    best = F.when(F.col("g1") - F.col("g0") >= 4, F.when(F.col(order) == F.col("g0") + F.floor((F.col("g1") - F.col("g0")) / 2), 1.0)).otherwise(only(F.col("combined")))
    agg = rows.groupBy(series, "g0", "g1").agg(
        F.max(F.when(inside & best.isNotNull(), F.struct(best.alias("b"), (-F.col(order)).alias("o"), "pixel", "hist", "asym", "combined", F.col(order).alias("at")))).alias("item"),
        F.avg(F.when(~inside, F.col("combined"))).alias("neighbor"), F.array_sort(F.collect_list(F.struct(order, "luminance"))).alias("lumas"),
        F.max(F.when(F.col(order) == F.col("g0") - 1, F.col("luminance"))).alias("pre"), F.max(F.when(F.col(order) == F.col("g1"), F.col("luminance"))).alias("post"),
        F.avg(only(F.col("pixel"))).alias("mean_pixel"), F.avg(only(F.col("hist"))).alias("mean_hist"), F.max(only(F.col("asym"))).alias("asym"),
    )
    lum, item = F.col("lumas.luminance"), F.col("item")
    steps = F.zip_with(F.slice(lum, F.lit(2), F.greatest(F.size(lum) - 1, F.lit(0))), F.slice(lum, F.lit(1), F.greatest(F.size(lum) - 1, F.lit(0))), lambda b, a: b - a)
    share = lambda f: F.size(F.filter(steps, f)) / F.greatest(F.size(steps), F.lit(1))
    agg = agg.withColumns({"n": F.col("g1") - F.col("g0"), "neighbor": F.coalesce("neighbor", F.lit(0.0)), "mono": F.greatest(share(lambda x: x >= -0.005), share(lambda x: x <= 0.005)), "__ext": F.lit(0.0)})
    if external is not None:
        near = external.select(series, F.explode(F.array(F.col(order) - 1, F.col(order), F.col(order) + 1)).alias("__at")).distinct().withColumn("__hit", F.lit(0.05))
        agg = agg.withColumn("__at", F.col("item.at")).join(near, [series, "__at"], "left").withColumn("__ext", F.coalesce("__hit", F.lit(0.0)))
    n, top, low = F.col("n"), F.array_max(lum), F.array_min(lum)
    rise = top - F.greatest("pre", "post")
    first, last = F.element_at(lum, 1), F.element_at(lum, -1)
    rules = [
        ((n <= 3) & F.col("pre").isNotNull() & F.col("post").isNotNull() & (rise >= 0.30) & (F.abs(F.col("pre") - F.col("post")) <= 0.08) & (item["pixel"] >= 0.15), F.lit("flash"), F.least(F.lit(0.98), 0.65 + 0.2 * rise + 0.1 * item["pixel"])),
        ((n >= 4) & (F.size(lum) >= 5) & (F.col("mono") >= 0.75) & (low < 0.12), F.when(last < first, "fade-out").otherwise("fade-in"), F.least(F.lit(0.9), 0.55 + 0.35 * F.col("mono"))),
        (n >= 24, F.lit("continuous"), F.least(F.lit(0.82), 0.5 + F.col("mean_pixel") + 0.2 * F.col("mean_hist"))),
        ((n >= 4) & (F.col("asym") >= 0.25) & (F.col("mean_pixel") >= 0.04), F.lit("wipe"), F.least(F.lit(0.88), 0.52 + 0.32 * F.col("asym"))),
        ((n >= 4) & (F.col("mean_hist") >= 0.08), F.lit("dissolve"), F.least(F.lit(0.88), 0.52 + 0.25 * F.col("mean_hist"))),
        ((n <= 2) & (item["hist"] >= 0.35) & (F.col("neighbor") <= F.greatest(F.lit(0.08), 0.45 * item["combined"])), F.lit("hard-cut"), F.least(F.lit(0.99), 0.55 + 0.25 * item["hist"] + 0.15 * item["pixel"] + F.col("__ext"))),
        ((item["asym"] >= 0.3) & (item["pixel"] >= 0.05), F.lit("wipe"), F.least(F.lit(0.85), 0.5 + 0.35 * item["asym"])),
        ((F.col("neighbor") >= 0.035) & (item["hist"] >= 0.12), F.lit("dissolve"), F.least(F.lit(0.85), 0.5 + 0.25 * item["hist"] + F.col("neighbor"))),
        ((item["pixel"] >= 0.04) & (item["hist"] < 0.12), F.lit("continuous"), F.least(F.lit(0.75), 0.45 + item["pixel"])),
    ]
    kind, confidence = F.lit("unknown"), F.least(F.lit(0.6), F.greatest(F.lit(0.2), item["combined"]))
    for met, name, value in reversed(rules):
        kind, confidence = F.when(F.coalesce(met, F.lit(False)), name).otherwise(kind), F.when(F.coalesce(met, F.lit(False)), value).otherwise(confidence)
    ends = samples.groupBy(series).agg(F.min(order).alias("__lo"), (F.max(order) + 1).alias("__hi"))
    out = agg.join(ends, series)
    return out.select(series, F.col("g0").alias("start"), F.col("g1").alias("end"), kind.alias("type"), clamp(confidence, 0.0, 1.0).alias("confidence"), F.greatest("__lo", F.col("g0") - 4).alias("win_start"), F.least("__hi", F.col("g1") + 4).alias("win_end"))


def energy_onsets(df: DataFrame, thresholds: DataFrame, gap: float = 0.15, value: str = VALUE, time: str = "t_seconds", series: str = SERIES) -> DataFrame:
    """(series, t, strength, kind): rises above the threshold, at least ``gap`` seconds after the last kept one.

    Only the rises reach Python. They are cut where two neighbours are a gap apart, since the later one is then kept whatever was
    before; a group is a run of rises closer than that.
    """
    w = Window.partitionBy(series).orderBy(time)
    rows = df.withColumn("__rise", F.greatest(F.lit(0.0), F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))))
    rows = rows.withColumn("strength", F.col("__rise") / F.max("__rise").over(Window.partitionBy(series))).join(thresholds.select(series, "threshold"), series).where("__rise > 0 and __rise >= threshold")
    rows = rows.withColumn("__cut", (F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(1e18)) >= gap).cast("long"))
    rows = rows.withColumn("__run", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    runs = rows.groupBy(series, "__run").agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), "strength"))).alias("run"))

    @F.pandas_udf("array<struct<t double, strength double>>")
    def keep(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            last, kept = -np.inf, []
            for row in group:
                if row["t"] - last >= gap:
                    kept.append(row)
                    last = row["t"]
            out.append(kept)
        return pd.Series(out)

    kept = runs.select(series, F.inline(keep("run")))
    return kept.withColumn("kind", F.when(F.col("strength") >= 0.75, "accent").otherwise("onset"))


def polynomial_weights(size: int, degree: int) -> np.ndarray:
    """[place, coefficient, row]: least-squares polynomial coefficients about each place of a window, as weights of its rows."""
    x = np.arange(size)
    return np.stack([np.linalg.pinv(np.vander(x - p, degree + 1, increasing=True).astype(float)) for p in x])


def weights_sql(window: int, degree: int) -> str:
    """The weights of every window length up to ``window`` as one constant, [length - 1][place][coefficient][row]; coefficients beyond the degree are zero."""
    text = lambda xs: "array(" + ",".join(f"{x!r}D" if isinstance(x, float) else text(x) for x in xs) + ")"
    out = []
    for n in range(1, window + 1):
        w = polynomial_weights(n, min(degree, n - 1))
        out.append(np.pad(w, ((0, 0), (0, max(0, 4 - w.shape[1])), (0, 0)))[:, :4].tolist())
    return text(out)


def local_polynomials(df: DataFrame, rate: float, values: dict[str, str], window: int = 15, degree: int = 3, series: str = SERIES, order: str = ORDER, odd: bool = False, block_rows: int | None = None) -> DataFrame:
    """df with a struct<smooth, velocity, acceleration, jerk> for each of the values (name of the struct to column), of a polynomial fitted to a full
    window at each row, shifted inside the ends.

    A fit at a given place in its window is a fixed weighting of the rows, so this is a dot product over a window frame, however long
    the series is, and all channels share one sort. Smoothed ends keep their raw values. A series not longer than the degree is fitted by its own length. With
    ``odd``, a series shorter than the window has the longest odd window that fits, of 3 rows at least.
    """
    near = {f"__near_{k}": F.collect_list(F.col(c).cast("double")) for k, c in values.items()}

    def gather(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), window - 1)
        return rows.withColumns({k: c.over(frame) for k, c in near.items()})

    rows = of_whole(df if NUMBER in df.columns else numbered(df, series, order, block_rows=block_rows), {"__total": F.count("*")}, series, block_rows, order)
    rows = in_blocks(rows, window - 1, gather, series, order, block_rows).withColumnRenamed(NUMBER, "__n")
    size = F.least(F.lit(window), F.col("__total")).cast("int")
    if odd:
        size = F.when((size % 2 == 0) & (size > 3), size - 1).otherwise(size)
    start = F.greatest(F.lit(0), F.least(F.col("__n") - window // 2, F.col("__total") - size))
    rows = rows.withColumns({"__size": size, "__place": (F.col("__n") - start).cast("int"), "__skip": (start - F.greatest(F.lit(0), F.col("__n") - (window - 1))).cast("int")})
    at = F.get(F.get(F.expr(weights_sql(window, degree)), F.col("__size") - 1), F.col("__place"))
    ends = (F.col("__n") == 0) | (F.col("__n") == F.col("__total") - 1)
    rows = rows.withColumn("__w", at)
    for k, c in values.items():
        xs = F.slice(f"__near_{k}", F.col("__skip") + 1, F.col("__size"))
        dot = lambda i, xs=xs: F.aggregate(F.zip_with(xs, F.get("__w", F.lit(i)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        smooth = F.when(ends, F.col(c)).otherwise(dot(0))
        rows = rows.withColumn(k, F.struct(smooth.alias("smooth"), (dot(1) * rate).alias("velocity"), (dot(2) * (2 * rate**2)).alias("acceleration"), (dot(3) * (6 * rate**3)).alias("jerk")))
    return rows.drop("__n", "__total", "__size", "__place", "__skip", "__w", *near)


def local_polynomial(df: DataFrame, rate: float, window: int = 15, degree: int = 3, value: str = VALUE, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """df with ``smooth``, ``velocity``, ``acceleration`` and ``jerk`` of :func:`local_polynomials` for one channel."""
    return local_polynomials(df, rate, {"__fit": value}, window, degree, series, order, block_rows=block_rows).select("*", "__fit.*").drop("__fit")


def similarity_coupling(df: DataFrame, rate: float, cx: str, cy: str, scale: str, rotation: str, series: str = SERIES, order: str = ORDER) -> DataFrame:
    """How the centre's progress runs against that of scale and rotation: (series, relation, explanation, start, peak, end, max_offset (signed), lag, rmse,
    centre_rmse, deviation, heading_change, confidence).

    The four channels are smoothed by :func:`local_polynomials`, and so are the velocities of both progresses and of the path; what follows are windows
    and one aggregation. Places are row numbers from 0. Series of fewer than 5 rows, and those whose centre, or whose scale and rotation, end
    where they start, have no progress to compare and are left out.
    """
    names = {"cx": cx, "cy": cy, "sc": scale, "ro": rotation}
    wide = local_polynomials(df.select(series, order, *[F.col(c).alias(n) for n, c in names.items()]), rate, {f"f{n}": n for n in names}, series=series, order=order)
    w = Window.partitionBy(series).orderBy(order)
    wide = wide.select(series, order, *[F.col(f"f{n}.smooth").alias(n) for n in names], (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(series)).alias("total")).where("total >= 5")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b = (lambda c: F.first(c).over(every)), (lambda c: F.last(c).over(every))
    rows = wide.withColumns({f"d{c}": b(c) - a(c) for c in names} | {f"x{c}": F.col(c) - a(c) for c in names})
    part = lambda c: F.when(F.abs(F.col(f"d{c}")) > 1e-9, F.col(f"x{c}") / F.col(f"d{c}"))
    norm = F.col("dcx") * F.col("dcx") + F.col("dcy") * F.col("dcy")
    rows = rows.withColumns({"ps": part("sc"), "pr": part("ro"), "norm": norm}).where("norm > 1e-12 and (ps is not null or pr is not null)")
    shared = F.coalesce((F.col("ps") + F.col("pr")) / 2, "ps", "pr")
    rows = rows.withColumns({"shared": shared, "centre": (F.col("xcx") * F.col("dcx") + F.col("xcy") * F.col("dcy")) / F.col("norm"), "gap": F.abs(F.col("xcx") * F.col("dcy") - F.col("xcy") * F.col("dcx")) / F.sqrt("norm")})
    rows = local_polynomials(rows.select(series, order, "i", "cx", "cy", "ps", "pr", "shared", "centre", "gap"), rate, {"vs": "shared", "vc": "centre", "vx": "cx", "vy": "cy"}, series=series, order=order, odd=True)
    v = lambda c: F.col(f"{c}.velocity")
    rows = rows.select(series, order, "i", "ps", "pr", "gap", (F.col("shared") - F.col("centre")).alias("offset"), F.abs(v("vs")).alias("vs"), F.abs(v("vc")).alias("vc"), F.hypot(v("vx"), v("vy")).alias("speed"), F.atan2(v("vy"), v("vx")).alias("heading"))
    all_ = Window.partitionBy(series)
    rows = rows.withColumns({"most": F.max(F.abs("offset")).over(all_), "fastest": F.max("speed").over(all_), "turn": F.pmod(F.col("heading") - F.lag("heading").over(w) + np.pi, F.lit(2 * np.pi)) - np.pi})
    strong, active = F.abs("offset") >= F.greatest(F.lit(0.02), 0.75 * F.col("most")), F.col("speed") >= F.greatest(F.lit(1e-12), 0.15 * F.col("fastest"))
    rows = rows.withColumns({"active": active, "first": F.min(F.when(active, F.col("i"))).over(all_), "last": F.max(F.when(active, F.col("i"))).over(all_)})
    peak = lambda c: F.struct(c.alias("x"), (-F.col("i")).alias("i"))
    agg = rows.groupBy(series).agg(
        F.max(F.struct(F.abs("offset").alias("x"), (-F.col("i")).alias("i"), F.col("offset").alias("v"))).alias("top"), F.min(F.when(strong, F.col("i"))).alias("s0"), F.max(F.when(strong, F.col("i"))).alias("s1"),
        (F.max(peak(F.col("vs")))["i"] - F.max(peak(F.col("vc")))["i"]).alias("lag"), F.coalesce(F.sqrt(F.avg(F.pow(F.col("ps") - F.col("pr"), F.lit(2.0)))), F.lit(0.0)).alias("rmse"),
        F.sqrt(F.avg(F.col("offset") * F.col("offset"))).alias("centre_rmse"), F.max("gap").alias("deviation"), F.coalesce(F.degrees(F.sum(F.when((F.col("i") > F.col("first")) & (F.col("i") <= F.col("last")), F.col("turn")))), F.lit(0.0)).alias("heading_change"),
    )
    extreme, place = F.col("top.v"), -F.col("top.i")
    size = F.abs(extreme)
    relation = F.when(size < 0.02, "synchronized").when(extreme > 0, "centre lags").otherwise("centre leads")
    explained = F.when(F.col("rmse") > 0.05, "scale and rotation differ").when((size >= 0.05) & (F.col("deviation") >= 0.001), "offset on a curve").when(size >= 0.05, "offset").when(F.col("deviation") >= 0.001, "curve").otherwise("shared")
    confidence = clamp(F.exp(-20 * F.col("rmse")) * (0.7 + 0.3 * F.least(F.lit(1.0), size / 0.08 + F.col("deviation") / 0.005)), 0.0, 1.0)
    return agg.select(
        series, relation.alias("relation"), explained.alias("explanation"), F.coalesce("s0", place).alias("start"), place.alias("peak"), F.coalesce("s1", place).alias("end"), extreme.alias("max_offset"), "lag", "rmse", "centre_rmse", "deviation", "heading_change",
        confidence.alias("confidence"),
    )


def clamped(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    """The map x -> min(hi, max(lo, a x + b)), a not negative."""
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def applied(f: Column, x: Column) -> Column:
    return F.least(f["hi"], F.greatest(f["lo"], f["a"] * x + f["b"]))


def after(f: Column, g: Column) -> Column:
    """g after f, again a map of the kind: g moves what f is clamped to, and clamps it."""
    return clamped(g["a"] * f["a"], g["a"] * f["b"] + g["b"], applied(g, f["lo"]), applied(g, f["hi"]))


def integrate_transform(steps: DataFrame, dx: str, dy: str, factor: str, checkpoints: int = 5, series: str = SERIES, order: str = ORDER, part_rows: int = 1024, block_rows: int | None = None) -> DataFrame:
    """(series, n, x, y, scale) at evenly spaced checkpoints: steps added and multiplied with a clamp after each; factors are not negative.

    A clamped step is a map x -> min(hi, max(lo, a x + b)), and one such map after another is one again. So the steps of each ``part_rows`` rows are composed
    to one map, the maps of a series give where each part begins, and only the parts that hold a checkpoint are walked step by step. A group is a
    part, or one row a part; rows are numbered in blocks of ``block_rows`` (see :mod:`blocks`).
    """
    names = ("x", "y", "scale")
    rows = numbered(steps.select(series, order, F.col(dx).alias("dx"), F.col(dy).alias("dy"), F.col(factor).alias("f")), series, order, block_rows=block_rows)
    one, zero, unit = F.lit(1.0), F.lit(0.0), (F.lit(0.0), F.lit(1.0))
    most = (F.lit(0.25), F.lit(4.0))
    step = F.struct(clamped(one, F.col("dx"), *unit).alias("x"), clamped(one, F.col("dy"), *unit).alias("y"), clamped(F.col("f"), zero, *most).alias("scale"))
    parts = rows.groupBy(series, F.floor(F.col(NUMBER) / part_rows).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(NUMBER).alias("n"), step.alias("m")))), lambda s: s["m"]).alias("steps"))
    parts = cut(parts)
    still = F.struct(*[clamped(one, zero, *(most if c == "scale" else unit)).alias(c) for c in names])  # of what is in range already
    composed = F.aggregate("steps", still, lambda f, g: F.struct(*[after(f[c], g[c]).alias(c) for c in names]))
    whole = parts.select(series, "part", F.size("steps").alias("n"), composed.alias("m"))
    line = whole.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("maps"), F.sum("n").alias("total"))
    begin = F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(1.0).alias("scale"))
    walk = lambda maps: F.aggregate(maps, begin, lambda at, m: F.struct(*[applied(m["m"][c], at[c]).alias(c) for c in names]))
    wanted = line.select(series, "maps", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(checkpoints - 1)), lambda i: F.bround(i * (F.col("total") - 1) / (checkpoints - 1)).cast("long")))).alias("n"))
    wanted = wanted.withColumn("part", F.floor(F.col("n") / part_rows)).select(series, "n", "part", walk(F.slice("maps", F.lit(1), F.col("part").cast("int"))).alias("at"))
    own = wanted.join(parts, [series, "part"]).withColumn("steps", F.slice("steps", F.lit(1), (F.col("n") % part_rows + 1).cast("int")))
    found = F.aggregate("steps", F.col("at"), lambda at, m: F.struct(*[applied(m[c], at[c]).alias(c) for c in names]))
    return own.select(series, "n", found.alias("v")).select(series, "n", *[f"v.{c}" for c in names])


def search_phase_warp(df: DataFrame, shifts: tuple[int, ...], best: int = 10, value: str = VALUE, series: str = SERIES, order: str = ORDER, block_rows: int | None = None) -> DataFrame:
    """(series, early, tail, error, bend): the anchor shifts at a third and two thirds of a series that bring it nearest to a straight ramp.

    The grid is bounded by ``shifts``, the same for every series, and evaluated for all series in one job. The order counts frames, one row each at most; a warp moves
    no frame farther than the greatest shift, so warped values are taken from a window frame of that reach, and nothing is joined by frame. What lies before the first anchor
    follows from ``early`` alone and what lies behind the second from ``tail``, so only the middle is measured for every pair, and what is shuffled is a row a frame. Of more
    than ``best`` shifts, a first pass over single shifts keeps the ``best`` of either anchor; otherwise every pair is evaluated.
    """
    reach = max(map(abs, shifts), default=0) + 1
    rows = df.select(series, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value)).where(F.col(series).isNotNull() & F.col(order).isNotNull())
    rows = of_whole(rows, {"last": F.max(order), "a": F.min_by(value, order), "b": F.max_by(value, order)}, series, block_rows, order).where((F.col("last") >= 6) & (F.col(order) >= 0))
    # a frame without a row has no value, but others are shown in its place: the row before stands for it too
    rows = shifted(rows, {"__next": (order, 1), "__before": (order, -1)}, series, order, block_rows)
    frames = F.sequence(F.when(F.col("__before").isNull(), 0).otherwise(F.col(order)), F.greatest(F.col(order), F.coalesce(F.col("__next") - 1, order)))
    rows = rows.withColumn(NUMBER, F.explode(frames)).select(series, NUMBER, "last", "a", "b", F.when(F.col(NUMBER) == F.col(order), F.col(value)).alias("__x"))

    def gather(part: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        # a list leaves out nulls, a struct is none
        near = F.collect_list(F.struct("__x")).over(Window.partitionBy(*keys).orderBy(NUMBER).rowsBetween(-reach, reach))
        return part.withColumn("__near", near)

    rows = in_blocks(rows, reach, gather, series, NUMBER, block_rows).withColumnRenamed(NUMBER, "out")
    anchors = {"o1": F.floor(F.col("last") / 3), "o2": F.floor(2 * F.col("last") / 3)}

    def errors(rows: DataFrame, pairs: Column) -> DataFrame:
        """(series, early, tail, error) of the pairs, an array of struct<early, tail>, that leave the anchors in order."""
        none = F.lit(None).cast("int")
        early = F.transform(F.array_distinct(pairs["early"]), lambda e: F.struct(e.alias("early"), none.alias("tail")))
        tail = F.transform(F.array_distinct(pairs["tail"]), lambda t: F.struct(none.alias("early"), t.alias("tail")))
        found = rows.withColumns(anchors)
        found = found.withColumn("pair", F.explode(F.when(F.col("out") <= F.col("o1"), early).when(F.col("out") <= F.col("o2"), pairs).otherwise(tail)))
        found = found.withColumns({"early": F.col("pair.early"), "tail": F.col("pair.tail")}).withColumns({"s1": F.col("o1") + F.col("early"), "s2": F.col("o2") + F.col("tail")})
        piece = lambda x0, x1, y0, y1: y0 + (y1 - y0) * (F.col("out") - x0) / (x1 - x0)
        at = F.when(F.col("out") <= F.col("o1"), piece(F.lit(0), F.col("o1"), F.lit(0), F.col("s1"))).when(F.col("out") <= F.col("o2"), piece(F.col("o1"), F.col("o2"), F.col("s1"), F.col("s2"))).otherwise(piece(F.col("o2"), F.col("last"), F.col("s2"), F.col("last")))
        at_place = lambda n: F.get("__near", (n - F.greatest(F.lit(0), F.col("out") - reach)).cast("int"))["__x"]
        found = found.withColumn("at", at).withColumns({"__lo": at_place(F.floor("at")), "__hi": at_place(F.ceil("at"))})
        shown = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("at") - F.floor("at"))
        ramp = F.col("a") + (F.col("b") - F.col("a")) * F.col("out") / F.col("last")
        square = F.pow(shown - ramp, F.lit(2.0))
        sums = found.groupBy(series, "early", "tail").agg(F.sum(square).alias("s"), F.count(square).alias("n"), F.max("last").alias("last"))
        only = lambda key, other: F.max(F.when(F.col(other).isNull(), F.struct("s", "n"))).over(Window.partitionBy(series, key))
        sums = sums.withColumn("__first", only("early", "tail")).withColumn("__third", only("tail", "early")).where("early is not null and tail is not null").withColumns(anchors)
        sums = sums.where("o1 + early > 0 and o2 + tail > o1 + early and o2 + tail < last")
        parts = ("__first.", "", "__third.")
        n = sum((F.col(f"{p}n") for p in parts), F.lit(0))
        total = sum((F.coalesce(f"{p}s", F.lit(0.0)) for p in parts), F.lit(0.0))
        return sums.select(series, "early", "tail", F.sqrt(F.when(n > 0, total / n)).alias("error"))

    whole_grid = lambda early, tail: F.array(*[F.struct(F.lit(e).alias("early"), F.lit(t).alias("tail")) for e in early for t in tail])

    def top(name: str, single: DataFrame) -> DataFrame:
        kept = single.withColumn("k", F.row_number().over(Window.partitionBy(series).orderBy(F.round("error", 9), F.abs(name), name))).where(F.col("k") <= best)
        return kept.groupBy(series).agg(F.collect_list(name).alias(f"__{name}"))

    if len(shifts) <= best:
        found = errors(rows, whole_grid(shifts, shifts))
    else:
        both = top("early", errors(rows, whole_grid(shifts, (0,)))).join(top("tail", errors(rows, whole_grid((0,), shifts))), series)
        pairs = F.flatten(F.transform("__early", lambda e: F.transform("__tail", lambda t: F.struct(e.alias("early"), t.alias("tail")))))
        found = errors(rows.join(both.select(series, pairs.alias("pairs")), series), F.col("pairs"))
    found = found.withColumn("bend", F.abs(F.col("early")) + F.abs(F.col("tail")))
    rank = Window.partitionBy(series).orderBy(F.round("error", 9), "bend", F.abs(F.col("early")), "early", "tail")
    return found.withColumn("k", F.row_number().over(rank)).where("k = 1").drop("k")


def silence_cues(scripts: DataFrame, series: str = SERIES) -> DataFrame:
    """(series, bounds): cue boundaries of scripts(series, weights, silences, frames): each at the nearest pause to its share of time, in order.

    A script of fewer frames than turns has no bounds that rise: null.

    One row a script; the weights and pauses of a script are its arrays.
    """

    @F.pandas_udf("array<long>")
    def bounds(weights: pd.Series, silences: pd.Series, frames: pd.Series) -> pd.Series:
        out = []
        for w, pauses, total in zip(weights, silences, frames, strict=True):
            if total < len(w):
                out.append(None)
                continue
            share = np.cumsum(np.maximum(0.5, np.asarray(w, float)))
            wanted = [round(total * s / share[-1]) for s in share[:-1]]
            pauses, cues = np.unique(np.asarray(pauses, np.int64)), [0]
            for left, want in zip(range(len(wanted), 0, -1), wanted, strict=True):
                lo, hi = cues[-1] + 1, total - left
                fit = pauses[(pauses >= lo) & (pauses <= hi)]
                pick = int(fit[np.abs(fit - want).argmin()]) if len(fit) else want
                cues.append(min(max(pick, lo), hi))
            out.append([*cues, total])
        return pd.Series(out)

    return scripts.select(series, bounds("weights", "silences", "frames").alias("bounds"))


def align_to_script(scripts: DataFrame, series: str = SERIES) -> DataFrame:
    """(series, cost, ends): the cheapest split of a script's transcript segments into one consecutive part for each beat.

    scripts(series, beats array<string>, segments array<string>), normalised. A part costs 1 - similarity + .15 |its share of segments -
    the beat's share of words|. Fewer segments than beats: null. One row a script, bounded by beats x segments.
    """
    import difflib

    @F.pandas_udf("cost double, ends array<long>")
    def split(beats: pd.Series, segments: pd.Series) -> pd.DataFrame:
        out = []
        for b, s in zip(beats, segments, strict=True):
            m, n = len(b), len(s)
            if n < m or not m:
                out.append((None, None))
                continue
            words = np.array([max(1, len(x.split())) for x in b], float)
            share = words / words.sum()
            best = np.full((m + 1, n + 1), np.inf)
            came = np.zeros((m + 1, n + 1), int)
            best[0, 0] = 0
            for i in range(1, m + 1):
                matcher = difflib.SequenceMatcher(None, "", "")
                for end in range(i, n - (m - i) + 1):
                    for start in range(i - 1, end):
                        so_far = best[i - 1, start] + 0.15 * abs((end - start) / n - share[i - 1])
                        if so_far >= best[i, end]:  # a part costs nothing at least
                            continue
                        matcher.set_seqs(b[i - 1], " ".join(s[start:end]))
                        if so_far + 1 - matcher.real_quick_ratio() >= best[i, end] or so_far + 1 - matcher.quick_ratio() >= best[i, end]:  # no ratio is above these
                            continue
                        cost = best[i - 1, start] + 1 - matcher.ratio() + 0.15 * abs((end - start) / n - share[i - 1])
                        if cost < best[i, end]:
                            best[i, end], came[i, end] = cost, start
            ends, at = [], n
            for i in range(m, 0, -1):
                ends.append(at)
                at = int(came[i, at])
            out.append((float(best[m, n]), ends[::-1]))
        return pd.DataFrame(out, columns=["cost", "ends"])

    return scripts.select(series, split("beats", "segments").alias("s")).select(series, "s.*")


def run_analyzers(df: DataFrame, analyzers: dict, key: str, value: str, existing: DataFrame | None = None) -> DataFrame:
    """(key, kind, ok, value, error_type, message): every named function on every row; a failure is a row, and what exists already is not run again.

    Functions take a value and return a float, or (kind, float); a kind other than the one asked for is a failure too.
    """
    rows = df.select(key, F.col(value).alias("__v"), F.explode(F.array(*map(F.lit, sorted(analyzers)))).alias("kind"))
    rows = rows.join(existing.select(key, "kind"), [key, "kind"], "left_anti") if existing is not None else rows

    @F.pandas_udf("ok boolean, value double, error_type string, message string")
    def run(kinds: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = []
        for kind, v in zip(kinds, values, strict=True):
            try:
                got = analyzers[kind](v)
                named, got = got if isinstance(got, tuple) else (kind, got)
                if named != kind:
                    raise ValueError(f"contract mismatch: expected {kind}, received {named}")
                out.append((True, float(got), None, None))
            except Exception as e:  # any failure of a plugged-in function is a typed row, by contract
                out.append((False, None, type(e).__name__, str(e)))
        return pd.DataFrame(out, columns=["ok", "value", "error_type", "message"])

    return rows.select(key, "kind", run("kind", "__v").alias("r")).select(key, "kind", "r.*")
