"""Operators on rasters and histograms held as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoform.functions import scalar
from chronoform.sources.storage import cut

from .quantiles import exact_quantiles


def quantile_mask(df: DataFrame, value: str, quantiles: dict[str, float], series: str = "series_id", hot_rows: int = 1_000_000) -> DataFrame:
    """For each named quantile: its exact (linear) value in the series and the share of rows at or above it. No task holds a series of more than ``hot_rows`` rows."""
    limits = exact_quantiles(df, value, quantiles, series, hot_rows)
    shares = [F.avg((F.col(value) >= F.col(name)).cast("double")).alias(f"{name}_share") for name in quantiles]
    return df.select(series, value).join(limits, series).groupBy(series, *quantiles).agg(*shares)


def image_stats(df: DataFrame, red: str, green: str, blue: str, width: int, height: int) -> DataFrame:
    """df with mean luminance, mean saturation, edge energy (mean gradient length) and base-2 entropy of 256 grey levels; channels in [0, 1], by rows."""
    @F.pandas_udf("mean_luminance double, mean_saturation double, edge_energy double, entropy double")
    def stats(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x in zip(r, g, b, strict=True):
            rgb = np.stack([np.asarray(c, float).reshape(height, width) for c in x])
            grey = np.tensordot((0.2126, 0.7152, 0.0722), rgb, 1)
            down, across = np.gradient(grey)
            share = np.bincount(np.clip(np.rint(grey * 255), 0, 255).astype(int).ravel()) / grey.size
            share = share[share > 0]
            out.append((grey.mean(), (rgb.max(0) - rgb.min(0)).mean(), np.hypot(across, down).mean(), -(share * np.log2(share)).sum()))
        return pd.DataFrame(out, columns=["mean_luminance", "mean_saturation", "edge_energy", "entropy"])

    return df.withColumn("stats", stats(red, green, blue)).select(*df.columns, "stats.*")


def saliency(df: DataFrame, red: str, green: str, blue: str, width: int, height: int) -> DataFrame:
    """df with ``saliency``: .45 normalised edges + .25 saturation + .30 nearness to the centre, for each pixel by rows."""
    y, x = np.mgrid[0:height, 0:width]
    near = np.clip(1 - np.hypot(x / max(width - 1, 1) - 0.5, y / max(height - 1, 1) - 0.5) / 0.7072, 0, 1)

    @F.pandas_udf("array<double>")
    def score(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for c in zip(r, g, b, strict=True):
            rgb = np.stack([np.asarray(v, float).reshape(height, width) for v in c])
            edges = np.hypot(*np.gradient(np.tensordot((0.2126, 0.7152, 0.0722), rgb, 1)))
            span = edges.max() - edges.min()
            norm = (edges - edges.min()) / span if span > 0 else np.zeros_like(edges)
            out.append((0.45 * norm + 0.25 * (rgb.max(0) - rgb.min(0)) + 0.30 * near).ravel())
        return pd.Series(out)

    return df.withColumn("saliency", score(red, green, blue))


#: Below all of these at once, two rows are near duplicates.
MINIMA = {"pixel": 0.02, "histogram": 0.04, "hash": 4.0, "luminance": 0.01, "structure": 0.02, "edge": 0.01}


def measured(df: DataFrame, minima: dict[str, float], vector: str, series: str, order: str) -> DataFrame:
    """df without ``vector``, with what pairs of rows are compared by: x, its mean m, rough and bits, and the luminance band.

    Left out are rows without a vector, series or order, and those that are near duplicates of none, not of their copies either: black, infinite or undefined ones.
    """
    xs = F.col("x")
    rough = scalar.pairwise(F.slice(xs, F.lit(2), F.size(xs) - 1), F.slice(xs, F.lit(1), F.size(xs) - 1), lambda p, q: F.abs(p - q)) / F.size(xs)
    bits = F.aggregate(scalar.dhash_bits(xs, 8, 8), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, 1).bitwiseOR(v.cast("long")))
    others = [c for c in df.columns if c not in (series, order, vector)]
    total = F.aggregate(xs, F.lit(0.0), lambda a, v: a + F.abs(v))
    rows = df.select(series, order, *others, F.col(vector).cast("array<double>").alias("x")).where((total > 0) & (total < float("inf")) & F.col(series).isNotNull() & F.col(order).isNotNull())
    return rows.withColumn("m", scalar.mean(xs)).withColumns({"rough": rough, "bits": bits, "__band": F.floor(F.col("m") / minima["luminance"])})


def compared(own: DataFrame, met: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], out: str, series: str, order: str, chunk: int) -> DataFrame:
    """(series, out): what ``compare`` makes of the rows of ``own`` and those of ``met`` whose mean is in the same or a neighbouring band.

    A band and what it meets are dealt out into chunks of some ``chunk`` rows; each pair of chunks is a unit of its own, which a task compares.
    """
    around = F.explode(F.array(F.col("__band") - 1, F.col("__band"), F.col("__band") + 1)).alias("__band")
    near = met.groupBy(series, "__band").count().select(series, around, "count").groupBy(series, "__band").agg(F.sum("count").alias("__near"))
    sizes = cut(own.groupBy(series, "__band").count().join(near, [series, "__band"]).select(series, "__band", F.ceil(F.col("count") / chunk).alias("__m"), F.ceil(F.col("__near") / chunk).alias("__n")))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    deal = lambda n: F.pmod(F.xxhash64(order), F.col(n))
    facts = [order, "x", "m", "rough", "bits"]
    a = own.join(sizes, [series, "__band"]).select(series, "__band", deal("__m").alias("__a"), spread(F.col("__n")).alias("__b"), *facts, *[c for c in own.columns if c == "__limit"])
    b = met.withColumn("__band", around).join(sizes, [series, "__band"]).select(series, "__band", spread(F.col("__m")).alias("__a"), deal("__n").alias("__b"), *facts)
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of their own, since both sides may come from the same rows
    kinds, unit, names = dict(own.dtypes), [series, "__band", "__a", "__b"], [c.split()[0] for c in out.split(", ")]

    def one(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame({c: [] for c in names}) if first.empty or second.empty else compare(first, second)
        found.insert(0, series, first[series].iloc[0] if len(found) else None)
        return found

    # a unit is little data and much work, so how many tasks there are does not follow from its bytes
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.sparkSession.sparkContext.defaultParallelism)
    a, b = a.repartition(parts, *unit), b.repartition(parts, *unit)
    return a.groupBy(*unit).cogroup(b.groupBy(*unit)).applyInPandas(one, f"{series} {kinds[series]}, {out}")


def near_duplicates(df: DataFrame, minima: dict[str, float] = MINIMA, vector: str = "x", series: str = "series_id", order: str = "seq", chunk: int = 2048) -> DataFrame:
    """(series, seq, duplicate_of): pairs of rows of a segment whose six differences are all below their minima.

    The luminance minimum makes an equi-key: candidates have their mean in the same or a neighbouring band, so a segment is not paired
    whole. A band and what it meets are dealt out into chunks of some ``chunk`` rows; each pair of chunks is a unit of its own, which a task compares as matrices, a
    few rows at a time. All pairs are what it returns; :func:`dedup` makes do without most of them.
    """
    rows = measured(df.select(series, order, vector), minima, vector, series, order)
    return links_of(rows, minima, series, order, chunk)


def links_of(rows: DataFrame, minima: dict[str, float], series: str, order: str, chunk: int) -> DataFrame:
    """(series, seq, duplicate_of): all pairs of near duplicates of measured rows."""

    def compare(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
        at, partner = linked_pairs(first, second, order, minima)
        return pd.DataFrame({order: at, "duplicate_of": partner})

    kind = dict(rows.dtypes)[order]
    return compared(rows, rows, compare, f"{order} {kind}, duplicate_of {kind}", series, order, chunk)


def earlier_partners(rows: DataFrame, minima: dict[str, float], series: str, order: str, chunk: int) -> DataFrame:
    """(series, seq, __n): how many near duplicates each of the measured rows has before it, for those that have any; a task returns a number a row, no pairs."""

    def compare(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
        at, n = np.unique(linked_pairs(first, second, order, minima)[0], return_counts=True)
        return pd.DataFrame({order: at, "__n": n})

    return compared(rows, rows, compare, f"{order} {dict(rows.dtypes)[order]}, __n long", series, order, chunk).groupBy(series, order).agg(F.sum("__n").alias("__n"))


def first_partners(targets: DataFrame, sources: DataFrame, minima: dict[str, float], series: str, order: str, chunk: int) -> DataFrame:
    """(series, seq, duplicate_of): the first of the sources that is a near duplicate of a target and lies before its ``__limit``, for those that have one.

    A task returns a row a target, no pairs. The first ``chunk`` sources of each series go first, then three times as many as before; a target
    that has found one needs none of the later ones.
    """

    def compare(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
        at, partner = first_linked(first, second, order, minima)
        return pd.DataFrame({order: at, "duplicate_of": partner})

    kind = dict(targets.dtypes)[order]
    most = sources.groupBy(series).count().agg(F.max("count")).first()[0] or 0
    places = sources.select(series, order).withColumn("__place", F.row_number().over(Window.partitionBy(series).orderBy(order)))
    found, done, upto = None, 0, chunk
    places = cut(places) if most > chunk else places
    while done < most:
        part = sources if most <= chunk else sources.join(places.where((F.col("__place") > done) & (F.col("__place") <= upto)), [series, order], "left_semi")
        left = targets.join(found, [series, order], "left_anti") if found is not None else targets
        left = left.join(part.groupBy(series).agg(F.min(order).alias("__from")), series).where(F.col("__limit") > F.col("__from")).drop("__from")
        new = compared(left, part, compare, f"{order} {kind}, duplicate_of {kind}", series, order, chunk).groupBy(series, order).agg(F.min("duplicate_of").alias("duplicate_of"))
        found = cut(new if found is None else found.unionByName(new))
        done, upto = upto, 4 * upto
    return targets.select(series, order, F.col(order).alias("duplicate_of")).where("false") if found is None else found


def arrays_of(rows: pd.DataFrame, order: str) -> dict[str, np.ndarray]:
    """What :func:`near_pairs` reads of the rows of a chunk."""
    x, m = np.stack(rows["x"].to_numpy()), rows["m"].to_numpy()
    off = x - m[:, None]
    return {"at": rows[order].to_numpy(), "x": x, "m": m, "rough": rows["rough"].to_numpy(), "bits": rows["bits"].to_numpy(), "root": np.sqrt(np.abs(x)), "total": np.abs(x).sum(axis=1), "off": off, "var": (off * off).mean(axis=1)}


def near_pairs(p: dict[str, np.ndarray], q: dict[str, np.ndarray], minima: dict[str, float], pairs: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in p, j in q) of near duplicates of which that of p comes first: the cheap differences and the products as matrices, the sums of absolute differences of what is left."""
    n, later, earlier = p["x"].shape[1], [], []
    with np.errstate(all="ignore"):
        near = (p["at"][:, None] < q["at"]) & (np.abs(p["m"][:, None] - q["m"]) < minima["luminance"]) & (np.abs(p["rough"][:, None] - q["rough"]) < minima["edge"])
        near &= np.bitwise_count((p["bits"][:, None] ^ q["bits"]).view(np.uint64)) < minima["hash"]
        overlap = p["root"] @ q["root"].T / np.sqrt(p["total"][:, None] * q["total"])
        near &= np.sqrt(np.clip(1 - overlap, 0.0, 1.0)) < minima["histogram"]
        means, covariance = 2 * p["m"][:, None] * q["m"], p["off"] @ q["off"].T / n
        ssim = (means + 0.01**2) * (2 * covariance + 0.03**2) / ((p["m"][:, None] ** 2 + q["m"] ** 2 + 0.01**2) * (p["var"][:, None] + q["var"] + 0.03**2))
        near &= np.clip(1 - ssim, 0.0, 1.0) < minima["structure"]
        i, j = np.nonzero(near)
        for c in range(0, len(i), pairs):
            u, v = i[c : c + pairs], j[c : c + pairs]
            close = np.abs(p["x"][u] - q["x"][v]).sum(axis=1) / n < minima["pixel"]
            later.append(v[close])
            earlier.append(u[close])
    return (np.concatenate(earlier), np.concatenate(later)) if later else (i, j)


def linked_pairs(first: pd.DataFrame, second: pd.DataFrame, order: str, minima: dict[str, float], rows: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier) orders of the rows of two chunks that are near duplicates, ``rows`` rows of the first at a time."""
    p, q = arrays_of(first, order), arrays_of(second, order)
    later, earlier = [], []
    for k in range(0, len(first), rows):
        i, j = near_pairs({c: v[k : k + rows] for c, v in p.items()}, q, minima)
        later.append(q["at"][j])
        earlier.append(p["at"][i + k])
    return np.concatenate(later), np.concatenate(earlier)


def first_linked(targets: pd.DataFrame, sources: pd.DataFrame, order: str, minima: dict[str, float], rows: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(targets, first sources) by their orders: ``rows`` sources at a time, in order; a target that has found one meets no more."""
    p, q = arrays_of(sources.sort_values(order), order), arrays_of(targets, order)
    ids, q["at"] = q["at"], targets["__limit"].to_numpy()
    at, partner = [ids[:0]], [ids[:0]]
    for k in range(0, len(sources), rows):
        block = {c: v[k : k + rows] for c, v in p.items()}
        i, j = near_pairs(block, q, minima)
        if not len(j):
            continue
        best = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(best, j, block["at"][i])
        hit = np.zeros(len(ids), bool)
        hit[j] = True
        at.append(ids[hit])
        partner.append(best[hit])
        ids, q = ids[~hit], {c: v[~hit] for c, v in q.items()}
        if not len(ids):
            break
    return np.concatenate(at), np.concatenate(partner)


def linked_runs(links: DataFrame, series: str, order: str) -> DataFrame:
    """links(series, order, duplicate_of) with ``__run`` and ``__size``: runs of links whose spans touch, so no link leads from one run to another."""
    spans = links.groupBy(series, order).agg(F.min("duplicate_of").alias("__low"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(series).orderBy(order)
    # from the last row backwards: a run starts where no later row reaches before it
    reach = F.min("__low").over(Window.partitionBy(series).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = spans.withColumn("__reach", reach)
    fresh = F.coalesce((F.lag(order).over(w) < F.col("__reach")).cast("int"), F.lit(1))
    spans = spans.withColumn("__run", F.sum(fresh).over(w))
    spans = spans.withColumn("__size", F.sum("__n").over(Window.partitionBy(series, "__run")))
    return links.join(spans.select(series, order, "__run", "__size"), [series, order])


def greedy_dedup(df: DataFrame, duplicates: DataFrame, protected: str, series: str = "series_id", order: str = "seq", fold_links: int = 2_000_000) -> DataFrame:
    """df with ``kept`` and ``duplicate_of``: in order, a row is dropped if a kept one before it is its near duplicate; protected rows always stay.

    duplicates(series, seq, duplicate_of) are the linked pairs; order and ids are whole numbers. A protected partner is kept, so no later partner of a row can be its
    first kept one: these links go first. The others fall into runs that no link joins: one of up to ``fold_links`` links is
    settled by one walk over it in a task. Longer runs are settled in rounds, each a join: a row is settled once all its
    earlier partners are, so these rounds are as many as the longest chain of partners. Repeated (series, seq) are one row to the links.
    """
    links = duplicates.join(df.where(~F.col(protected)).select(series, order), [series, order], "left_semi")
    safe = df.where(protected).select(series, order).distinct().join(df.where(~F.col(protected)).select(series, order), [series, order], "left_anti").select(series, F.col(order).alias("duplicate_of"))
    bound = links.join(safe, [series, "duplicate_of"]).groupBy(series, order).agg(F.min("duplicate_of").alias("__bound"))
    links = cut(links.join(bound, [series, order], "left").where(F.col("__bound").isNull() | (F.col("duplicate_of") <= F.col("__bound"))).drop("__bound"))
    known = cut(df.select(series, order).join(links.select(series, order).distinct(), [series, order], "left_anti").withColumns({"kept": F.lit(True), "duplicate_of": F.lit(None).cast("long")}))
    links = cut(linked_runs(links, series, order))
    kinds = dict(links.dtypes)

    def walk(run: pd.DataFrame) -> pd.DataFrame:
        """A run's rows in order: the first kept partner before each, if any."""
        run = run.sort_values([order, "duplicate_of"])
        gone, out = set(), []
        for at, partners in run.groupby(order, sort=True)["duplicate_of"]:
            first = next((int(p) for p in partners if int(p) not in gone), None)
            if first is not None:
                gone.add(int(at))
            out.append((at, first is None, first))
        found = pd.DataFrame({order: pd.array([o[0] for o in out], "Int64"), "kept": [o[1] for o in out], "duplicate_of": pd.array([o[2] for o in out], "Int64")})
        found.insert(0, series, run[series].iloc[0])
        return found

    folded = links.where(F.col("__size") <= fold_links).groupBy(series, "__run").applyInPandas(walk, f"{series} {kinds[series]}, {order} {kinds[order]}, kept boolean, duplicate_of long")
    known = cut(known.unionByName(folded))
    waiting = links.where(F.col("__size") > fold_links).drop("__run", "__size")
    while not waiting.isEmpty():
        state = known.select(series, F.col(order).alias("duplicate_of"), F.col("kept").alias("__k"))
        seen = waiting.join(state, [series, "duplicate_of"], "left")
        ready = seen.groupBy(series, order).agg(F.sum(F.col("__k").isNull().cast("int")).alias("__open"), F.min(F.when(F.col("__k"), F.col("duplicate_of"))).alias("duplicate_of"), F.min(F.when(F.col("__k").isNull(), F.col("duplicate_of"))).alias("__first_open"))
        # settled too if a kept partner comes before every open one would be the survivor anyway
        done = ready.where((F.col("__open") == 0) | (F.col("duplicate_of") < F.col("__first_open")))
        known = cut(known.unionByName(done.select(series, order, F.col("duplicate_of").isNull().alias("kept"), "duplicate_of")))
        waiting = cut(waiting.join(known.select(series, order), [series, order], "left_anti"))
    return df.join(known, [series, order], "left")


def dedup(df: DataFrame, protected: str, minima: dict[str, float] = MINIMA, vector: str = "x", series: str = "series_id", order: str = "seq", chunk: int = 4096, row_links: int = 64) -> DataFrame:
    """df with ``kept`` and ``duplicate_of``, as :func:`greedy_dedup` over :func:`near_duplicates`, without their pairs.

    Of the rows of one vector the first is settled; any later one has its partners, so it is a duplicate of the first kept one of these, or of that first row: a still picture of n rows makes no pairs.
    Protected rows are kept, so rows that have one before them are no partners of others. Of the rest, the first ones in order, as many as
    have ``row_links`` links a row of their series, are settled by their links, and all rows look for their first partner among those kept of them; this is repeated until none is left.
    So links are never more than ``row_links`` a row at a time, however many near duplicates there are.
    """
    rows = df.select(series, order, F.col(vector).cast("array<double>").alias("x"), F.coalesce(protected, F.lit(False)).alias("__safe"))
    firsts = rows.groupBy(series, "x").agg(F.min(order).alias(order), F.min(F.when(F.col("__safe"), F.col(order))).alias("__guard"), (F.count(F.lit(1)) > 1).alias("__copied"))
    nodes = cut(measured(firsts, minima, "x", series, order))
    guarded = F.coalesce(F.col("__guard") == F.col(order), F.lit(False))
    targets = nodes.where(~guarded | F.col("__copied")).withColumn("__limit", F.col(order))
    found = first_partners(targets, nodes.where("__guard IS NOT NULL").withColumn(order, F.col("__guard")), minima, series, order, chunk)
    sizes = cut(nodes.groupBy(series).agg((F.count(F.lit(1)) * row_links).alias("__most")))
    waiting = cut(nodes.where(~guarded).select(series, order).join(found, [series, order], "left_anti"))
    while not waiting.isEmpty():
        turn, many = waiting, F.col("count") * (F.col("count") - 1) > 2 * F.col("__most")
        if not waiting.groupBy(series).count().join(sizes, series).where(many).isEmpty():
            before = earlier_partners(nodes.join(waiting, [series, order], "left_semi"), minima, series, order, chunk)
            upto = F.sum(F.coalesce("__n", F.lit(0))).over(Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            turn = cut(waiting.join(before, [series, order], "left").withColumn("__upto", upto).join(sizes, series).where(F.col("__upto") <= F.col("__most")).select(series, order))
        links = cut(links_of(nodes.join(turn, [series, order], "left_semi"), minima, series, order, chunk))
        stay = greedy_dedup(turn.withColumn("__safe", F.lit(False)), links, "__safe", series, order).where("kept").select(series, order)
        known = found.withColumnRenamed("duplicate_of", "__by")
        limited = targets.join(known, [series, order], "left").withColumn("__limit", F.coalesce("__by", "__limit")).drop("__by")
        better = first_partners(limited, nodes.join(cut(stay), [series, order], "left_semi"), minima, series, order, chunk)
        found = cut(found.unionByName(better).groupBy(series, order).agg(F.min("duplicate_of").alias("duplicate_of")))
        waiting = cut(waiting.join(turn, [series, order], "left_anti").join(found, [series, order], "left_anti"))
    gone = found
    copied = nodes.where("__copied").select(series, "x", F.col(order).alias("__first"))
    if not copied.isEmpty():
        partner = copied.join(found.withColumnRenamed(order, "__first"), [series, "__first"], "left").select(series, "x", "__first", F.coalesce("duplicate_of", "__first").alias("duplicate_of"))
        rest = rows.join(partner, [series, "x"]).where(F.col(order) != F.col("__first")).select(series, order, "duplicate_of")
        gone = found.unionByName(rest)
    gone = gone.groupBy(series, order).agg(F.min("duplicate_of").alias("__by"))
    dropped = F.col("__by").isNotNull() & ~F.coalesce(protected, F.lit(False))
    return df.join(gone, [series, order], "left").withColumns({"kept": ~dropped, "duplicate_of": F.when(dropped, F.col("__by"))}).drop("__by")
