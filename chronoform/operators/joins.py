"""Joins of ordered data: aligned, as-of, by range and by overlap, and the checks made with semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoform.sources.storage import cut

SERIES, ORDER = "series_id", "seq"


def bucketed(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Each row of [start, end) once for each bucket of the given width that it touches: the equi-key of a range join."""
    last = F.greatest(F.floor((F.col(end) - 1) / width), F.floor(F.col(start) / width))
    return df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), last)))


def usual_length(ranges: DataFrame, start: str = "start", end: str = "end") -> int:
    """The length that nine tenths of the ranges do not pass: as a bucket's width, most ranges lie in two buckets and few are cut into many."""
    return max(1, int(ranges.agg(F.percentile_approx(F.col(end) - F.col(start), F.lit(0.9))).first()[0] or 1))


def dealt(rows: DataFrame, lookup: DataFrame, key: list[str], chunk: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on key, and the key: where more than ``chunk`` of rows share one, they are dealt out by a hash of the row and lookup goes to each part. None: as they are.

    A hash and no running number, so a task that is run again deals alike; rows that are equal in all columns stay together.
    """
    if not chunk:
        return rows, lookup, key
    full = cut(rows.groupBy(*key).count().where(F.col("count") > chunk).select(*key, F.ceil(F.col("count") / chunk).alias("__parts")))
    if full.isEmpty():
        return rows, lookup, key
    parts = F.coalesce("__parts", F.lit(1))
    spread = F.pmod(F.xxhash64(*rows.columns), parts)
    rows = rows.join(full, key, "left").withColumn("__part", spread).drop("__parts")
    lookup = lookup.join(full, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return rows, lookup, [*key, "__part"]


def point_in_range(points: DataFrame, ranges: DataFrame, order: str = ORDER, series: str = SERIES, width: int | None = 64, chunk: int | None = None) -> DataFrame:
    """points with the columns of the half-open range of their series that they lie in; points outside every range are left out.

    The join is by series and bucket, so it hashes; the range condition filters within a bucket. A width of None is taken from the ranges'
    lengths, by a pass of its own: for ranges much longer or shorter than the default. With ``chunk``, buckets of more points than that are
    found by a pass and dealt out over several tasks. Ranges may overlap: a point comes once for each that holds it.
    """
    width = width or usual_length(ranges)
    rows, parts, key = dealt(points.withColumn("__bucket", F.floor(F.col(order) / width)), bucketed(ranges, "start", "end", width), [series, "__bucket"], chunk)
    return rows.join(parts, key).where((F.col(order) >= F.col("start")) & (F.col(order) < F.col("end"))).drop("__bucket", "__part")


def required_range(points: DataFrame, ranges: DataFrame, order: str = ORDER, series: str = SERIES, width: int = 64) -> DataFrame:
    """points with the columns of the range that they lie in; a point that lies in none fails the query, as :func:`point_in_range` would lose it.

    A point comes once for each range that holds it, so ranges that overlap repeat it.
    """
    parts = bucketed(ranges, "start", "end", width).withColumn("__in", F.lit(True))
    rows = points.withColumn("__bucket", F.floor(F.col(order) / width)).withColumn("__id", F.monotonically_increasing_id())
    inside = (rows[order] >= F.col("start")) & (rows[order] < F.col("end"))
    met = rows.alias("p").join(parts.alias("r"), (F.col(f"p.{series}") == F.col(f"r.{series}")) & (F.col("p.__bucket") == F.col("r.__bucket")) & inside, "left")
    problem = F.concat(F.lit("no range holds "), F.col(f"p.{order}").cast("string"), F.lit(" of series "), F.col(f"p.{series}").cast("string"))
    held = F.when(F.col("__in"), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    return met.where(held).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"r.{c}") for c in ranges.columns if c != series])


def inclusive_overlap(left: DataFrame, right: DataFrame, fps: float, series: str = SERIES, width: int = 256) -> DataFrame:
    """Pairs of left(first, last in seconds) and right(start, end in frames): the half-even last frame at or after the start, the first before the end.

    Ends count in, so an event that ends on the frame where a range starts belongs to it.
    """
    at = lambda c: F.bround(F.col(c) * fps).cast("long")
    rows = left.withColumns({"start": at("first"), "end": at("last") + 1})
    named = right.withColumnsRenamed({"start": "start2", "end": "end2"})
    return interval_overlap(rows, named, series, width).drop("overlap_start", "overlap_end")


def remapped_captions(captions: DataFrame, kept: DataFrame, totals: DataFrame, fps: float, series: str = SERIES, width: int = 256) -> DataFrame:
    """captions(start, end in seconds) cut to kept(start, end, output_start) spans and moved to where the output shows these: (cue_start, cue_duration) in frames.

    A cue starts before the end of totals(series, total) and lasts a frame at least, but not beyond it.
    """
    seconds = 1000  # buckets are made of whole milliseconds
    a = captions.withColumns({"__s": F.col("start"), "__e": F.col("end"), "start": F.floor(F.col("start") * seconds), "end": F.ceil(F.col("end") * seconds)})
    b = kept.select(series, "output_start", F.col("start").alias("__ks"), F.col("end").alias("__ke"), F.floor(F.col("start") * seconds).alias("start2"), F.ceil(F.col("end") * seconds).alias("end2"))
    rows = interval_overlap(a, b, series, width * seconds).withColumns({"from": F.greatest("__s", "__ks"), "to": F.least("__e", "__ke")}).where(F.col("to") > F.col("from")).join(totals, series)
    rows = rows.withColumn("cue_start", F.least(F.col("total") - 1, F.col("output_start") + F.bround((F.col("from") - F.col("__ks")) * fps).cast("long")))
    length = F.greatest(F.lit(1), F.bround((F.col("to") - F.col("from")) * fps).cast("long"))
    rows = rows.withColumn("cue_duration", F.greatest(F.lit(1), F.least(length, F.col("total") - F.col("cue_start"))))
    return rows.drop("__s", "__e", "__ks", "__ke", "start", "end", "start2", "end2", "overlap_start", "overlap_end")


def interval_overlap(left: DataFrame, right: DataFrame, series: str = SERIES, width: int | None = 256, chunk: int | None = None) -> DataFrame:
    """Pairs of left(start, end) and right(start2, end2) of a series that overlap, with their intersection.

    A pair is reported by the bucket that its intersection starts in, so none is repeated. A width of None is the larger usual length of both sides.
    With ``chunk``, a bucket of more left rows than that is dealt out over several tasks.
    """
    width = width or max(usual_length(left), usual_length(right, "start2", "end2"))
    a, b = bucketed(left, "start", "end", width), bucketed(right, "start2", "end2", width)
    a, b, key = dealt(a, b, [series, "__bucket"], chunk)
    both = a.join(b, key).where("start < end2 and start2 < end")
    both = both.withColumns({"overlap_start": F.greatest("start", "start2"), "overlap_end": F.least("end", "end2")})
    return both.where(F.floor(F.col("overlap_start") / width) == F.col("__bucket")).drop("__bucket", "__part")


def frame_align(expected: DataFrame, actual: DataFrame, values: tuple[str, ...], series: str = SERIES, order: str = ORDER) -> DataFrame:
    """Both values of every frame side by side, with ``side``: both, expected or actual."""
    e = expected.select(series, order, *[F.col(v).alias(f"{v}_expected") for v in values], F.lit(1).alias("__e"))
    a = actual.select(series, order, *[F.col(v).alias(f"{v}_actual") for v in values], F.lit(1).alias("__a"))
    side = F.when(F.col("__e").isNull(), "actual").when(F.col("__a").isNull(), "expected").otherwise("both")
    return e.join(a, [series, order], "full_outer").withColumn("side", side).drop("__e", "__a")


def nearest_timestamp(points: DataFrame, targets: DataFrame, time: str = "t", series: str = SERIES) -> DataFrame:
    """points with ``nearest``: the target time of the series closest to each, the earlier among equals; null if there is none.

    One sort of the union of both: the last target before and the first after meet in two windows, so nothing is paired.
    """
    both = points.withColumn("__t", F.lit(None).cast("double")).unionByName(targets.select(series, time).withColumn("__t", F.col(time).cast("double")), allowMissingColumns=True)
    w = Window.partitionBy(series).orderBy(time, F.col("__t").isNull())
    before = F.last("__t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("__t", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = both.withColumns({"__before": before, "__after": after}).where("__t is null")
    near = F.when(F.col("__before").isNull() | (F.col("__after") - F.col(time) < F.col(time) - F.col("__before")), F.col("__after")).otherwise(F.col("__before"))
    return rows.withColumn("nearest", F.coalesce(near, "__before")).drop("__t", "__before", "__after")


def exists_in_range(ranges: DataFrame, points: DataFrame, series: str = SERIES, order: str = ORDER, width: int = 64) -> DataFrame:
    """ranges with ``found``: whether a point of the series lies in them."""
    spans = ranges.select(series, "start", "end").distinct()
    hits = point_in_range(points.select(series, order), spans, order, series, width).select(series, "start", "end").distinct().withColumn("found", F.lit(True))
    return ranges.join(hits, [series, "start", "end"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def near_boundary_lookup(rows: DataFrame, transitions: DataFrame, distance: int = 1, series: str = SERIES, frame: str = "frame") -> DataFrame:
    """rows with ``near``: the first transition frame of the series at most so far away, or null."""
    offsets = F.explode(F.sequence(F.lit(-distance), F.lit(distance)))
    spread = transitions.select(series, F.col(frame).alias("near"), offsets.alias("__o")).select(series, "near", (F.col("near") + F.col("__o")).alias(frame))
    first = spread.groupBy(series, frame).agg(F.min("near").alias("near"))
    return rows.join(first, [series, frame], "left")


def assemble_segments(segments: DataFrame, motion: DataFrame, observation: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """segments with the last motion row and the first observation of each (by id); missing confidences are .5, the joint one is the least."""
    latest = motion.groupBy(*key).agg(F.max_by("motion_class", "id").alias("motion_class"), F.max_by("confidence", "id").alias("__m"))
    earliest = observation.groupBy(*key).agg(F.min_by("label", "id").alias("label"), F.min_by("confidence", "id").alias("__o"))
    rows = segments.join(latest, list(key), "left").join(earliest, list(key), "left")
    return rows.withColumn("confidence", F.least("confidence", F.coalesce("__m", F.lit(0.5)), F.coalesce("__o", F.lit(0.5)))).drop("__m", "__o")


def missing_required(required: DataFrame, present: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, problem): required but not there, or there but not required."""
    r, p = required.select(*key).distinct(), present.select(*key).distinct()
    return r.join(p, list(key), "left_anti").withColumn("problem", F.lit("missing")).unionByName(p.join(r, list(key), "left_anti").withColumn("problem", F.lit("extra")))


def dangling_edges(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(src, dst, problem): edges with an end that is no node."""
    known = nodes.select(F.col(node).alias("__k")).distinct()
    gone = lambda end: edges.join(known, F.col(end) == F.col("__k"), "left_anti").select("src", "dst", F.lit(f"no {end}").alias("problem"))
    return gone("src").unionByName(gone("dst"))


def graph_problems(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph, problem, id): ids that a graph has twice, edges that leave it, approved graphs without a version, and in those decisions that are not
    approved or cannot be undone. nodes(graph, id, approval, n_inverse), edges(graph, src, dst), graphs(graph, state, version).
    """
    twice = nodes.groupBy("graph", "id").count().where("count > 1").select("graph", F.lit("repeated id").alias("problem"), "id")
    known = nodes.select("graph", F.col("id").alias("__k")).distinct()
    gone = lambda end: edges.alias("e").join(known.alias("k"), (F.col("e.graph") == F.col("k.graph")) & (F.col(f"e.{end}") == F.col("__k")), "left_anti").select("graph", F.lit(f"no {end}").alias("problem"), F.col(end).alias("id"))
    approved = graphs.where("state = 'approved'")
    unnamed = approved.where("version is null").join(nodes.select("graph").distinct(), "graph", "left_semi").select("graph", F.lit("no version").alias("problem"), F.lit(None).cast(nodes.schema["id"].dataType).alias("id"))
    open_ = nodes.where("not (approval <=> 'approved') or coalesce(n_inverse, 0) = 0").join(approved.select("graph"), "graph", "left_semi").select("graph", F.lit("not approved or not reversible").alias("problem"), "id")
    return twice.unionByName(gone("src")).unionByName(gone("dst")).unionByName(unnamed).unionByName(open_)


def version_chain(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, ancestor, steps): everything above the starts, following edges(child, parent), each ancestor once, by the shortest way.

    One join a step, ending when nothing new is found, so a cycle ends too; with ``depth``, after that many steps.
    """
    level = cut(starts.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps")).distinct())
    found, n = level, 0
    while depth is None or n < depth:
        n += 1
        step = level.join(edges, F.col("ancestor") == F.col("child")).select("id", F.col("parent").alias("ancestor"), F.lit(n).alias("steps")).distinct()
        level = cut(step.join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def prefer_source(keys: DataFrame, *sources: DataFrame, key: str = SERIES) -> DataFrame:
    """The row of the first source that has the key, with ``method`` (source name in its column ``method``)."""
    ranked = sources[0].withColumn("__rank", F.lit(0))
    for n, source in enumerate(sources[1:], 1):
        ranked = ranked.unionByName(source.withColumn("__rank", F.lit(n)))
    best = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__rank"))).where("__n = 1").drop("__n", "__rank")
    return keys.select(key).distinct().join(best, key, "left")
