"""Aligned comparison: errors, scorecards, checks and overall status."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import along, gradient


def rmse(df: DataFrame, pairs: dict[str, tuple[Column, Column]], group: str, angular: tuple[str, ...] = ()) -> DataFrame:
    """(group, channel errors): root mean square differences; of angular channels the shortest turn. No row with both values: infinity."""
    out = []
    for name, (expected, actual) in pairs.items():
        d = F.pmod(expected - actual + 180.0, F.lit(360.0)) - 180.0 if name in angular else expected - actual
        out.append(F.coalesce(F.sqrt(F.avg(d * d)), F.lit(float("inf"))).alias(name))
    return df.groupBy(group).agg(*out)


def centre_rmse(df: DataFrame, group: str, ex: str, ey: str, ax: str, ay: str) -> DataFrame:
    """Root mean square distance of two paths."""
    dx, dy = F.col(ex) - F.col(ax), F.col(ey) - F.col(ay)
    return df.groupBy(group).agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("centre"))


def derivative_rmse(df: DataFrame, position: tuple[tuple[str, str], tuple[str, str]], scale: tuple[str, str], rotation: tuple[str, str], rate: float, group: str = "series_id", order: str = "seq") -> DataFrame:
    """(group, velocity, acceleration and jerk errors of position, scale and rotation, combined_jerk): by finite differences of expected and actual.

    position has the (x, y) columns of the expected and the actual path, the others (expected, actual); rotation is unwrapped before. The error
    of position is that of the distance; combined_jerk is the largest of the three. No row: infinity.
    """
    w = along(group, order)
    names = {"ex": position[0][0], "ey": position[0][1], "ax": position[1][0], "ay": position[1][1], "es": scale[0], "as": scale[1], "er": rotation[0], "ar": rotation[1]}
    rows = df.select(group, order, *[F.col(c).cast("double").alias(f"{k}0") for k, c in names.items()])
    for n in range(3):
        rows = rows.withColumns({f"{k}{n + 1}": gradient(f"{k}{n}", rate, w) for k in names})
    off = lambda a, n: F.col(f"e{a}{n}") - F.col(f"a{a}{n}")
    root = lambda c: F.coalesce(F.sqrt(F.avg(c)), F.lit(float("inf")))
    out = []
    for n, name in enumerate(("velocity", "acceleration", "jerk"), 1):
        out += [root(off("x", n) * off("x", n) + off("y", n) * off("y", n)).alias(f"{name}_position"), root(off("s", n) * off("s", n)).alias(f"{name}_scale"), root(off("r", n) * off("r", n)).alias(f"{name}_rotation")]
    return rows.groupBy(group).agg(*out).withColumn("combined_jerk", F.greatest("jerk_position", "jerk_scale", "jerk_rotation"))


GRID9 = tuple((x, y) for y in (0.0, 0.5, 1.0) for x in (0.0, 0.5, 1.0))
GRID5 = ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5))


def projected_grid_rmse(df: DataFrame, expected: str, actual: str, width: float, height: float, key: str, grid: tuple = GRID9, diagonal: bool = False) -> DataFrame:
    """(key, error): distance of grid points sent through two 3 x 3 matrices (arrays of 9), normalised by axis or by the diagonal."""
    points = F.array(*[F.struct(F.lit(x * width).alias("x"), F.lit(y * height).alias("y")) for x, y in grid])
    rows = df.select(key, F.col(expected).alias("e"), F.col(actual).alias("a"), F.explode(points).alias("p"))

    def sent(m: str) -> tuple[Column, Column]:
        at = lambda i: F.get(F.col(m), F.lit(i))
        x, y = F.col("p.x"), F.col("p.y")
        w = at(6) * x + at(7) * y + at(8)
        return (at(0) * x + at(1) * y + at(2)) / w, (at(3) * x + at(4) * y + at(5)) / w

    (ex, ey), (ax, ay) = sent("e"), sent("a")
    across, down = (F.lit((width**2 + height**2) ** 0.5),) * 2 if diagonal else (F.lit(width), F.lit(height))
    dx, dy = (ex - ax) / across, (ey - ay) / down
    mean = F.avg((dx * dx + dy * dy) / 2) if diagonal else F.avg(dx * dx + dy * dy)
    return rows.groupBy(key).agg(F.sqrt(mean).alias("error"))


def threshold_checks(metrics: DataFrame, criteria: dict[str, tuple[str, float]], key: str) -> DataFrame:
    """(key, metric, value, limit, status): each metric against its minimum or maximum; a null value fails."""
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(kind).alias("kind"), F.lit(float(limit)).alias("limit")) for m, (kind, limit) in criteria.items()]
    rows = metrics.select(key, F.inline(F.array(*parts)))
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return rows.select(key, "metric", "value", "limit", F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status"))


#: Limits that hold where no criterion is given.
DEFAULT_CRITERIA = {"scale_rmse": ("max", 0.03), "rotation_rmse_degrees": ("max", 0.30), "center_rmse_normalized": ("max", 0.015), "vmaf_mean": ("min", 80.0), "ssim_all": ("min", 0.90)}


def criteria_checks(metrics: DataFrame, criteria: DataFrame, key: str, defaults: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(key, metric, value, limit, status): metrics in columns against criteria(key, metric, limit); a metric without one has its default limit."""
    defaults = defaults or DEFAULT_CRITERIA
    own = criteria.groupBy(key, "metric").agg(F.max("limit").alias("__own"))
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(kind).alias("kind"), F.lit(float(limit)).alias("__default")) for m, (kind, limit) in defaults.items() if m in metrics.columns]
    rows = metrics.select(key, F.inline(F.array(*parts))).join(own, [key, "metric"], "left").withColumn("limit", F.coalesce("__own", "__default"))
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return rows.select(key, "metric", "value", "limit", F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status"))


def overall_status(checks: DataFrame, key: str, warn_is_ok: bool = False) -> DataFrame:
    """(key, status, n): fail if any check fails, warn if any warns or is skipped, else pass; with warn_is_ok, warnings pass."""
    grade = F.when(F.col("status") == "fail", 2).when(F.col("status").isin("warn", "skip"), 0 if warn_is_ok else 1).otherwise(0)
    worst = F.max(grade)
    return checks.groupBy(key).agg(F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass").alias("status"), F.count("*").alias("n"))


#: Runs that are Python objects at the same time.
RUNS_AT_ONCE = 128


def nearest_free(wanted: list[tuple[int, int]], found: list[int]) -> list[dict]:
    """Each wanted (frame, tolerance) in order with the nearest detection that none before took, the lower of two equally near; None if none is within its tolerance.

    What is free to the left and right of a place is kept as pointers that skip what is taken and are shortened as they are followed, so a run takes near-linear time.
    """
    found = sorted(found)
    n = len(found)
    left, right = list(range(n + 1)), list(range(n + 1))  # of place i - 1 for left, so that 0 stands for none; of place i for right, n for none

    def free(of: list[int], i: int) -> int:
        root = i
        while of[root] != root:
            root = of[root]
        while of[i] != root:
            of[i], i = root, of[i]
        return root

    out = []
    for frame, tolerance in sorted(wanted):
        at = bisect.bisect_left(found, frame)
        below, above = free(left, at) - 1, free(right, at)
        near = [(abs(found[i] - frame), found[i], i) for i in (below, above) if 0 <= i < n and abs(found[i] - frame) <= tolerance]
        best = min(near) if near else None
        if best:
            left[best[2] + 1], right[best[2]] = best[2], best[2] + 1
        out.append({"frame": frame, "detected_frame": best[1] if best else None})
    return out


def match_within_tolerance(truth: DataFrame, detected: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, frame, detected_frame): greedy one-to-one matching. Truth rows in order take the nearest unused detection within their tolerance, the first among equals.

    truth(series, frame, tolerance), detected(series, frame). A series is split where no tolerance reaches across, so a group is a run of
    truth rows that compete for detections, not a whole series.
    """
    t = truth.select(series, "frame", "tolerance", (F.col("frame") - F.col("tolerance")).alias("__lo"), (F.col("frame") + F.col("tolerance")).alias("__hi"), F.lit(1).alias("__truth"))
    f = detected.select(series, "frame", F.lit(0).cast("long").alias("tolerance"), F.col("frame").alias("__lo"), F.col("frame").alias("__hi"), F.lit(0).alias("__truth"))
    w = Window.partitionBy(series).orderBy("__lo", "__hi", "__truth")
    rows = t.unionByName(f).withColumn("__new", (F.col("__lo") > F.coalesce(F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(2**62)))).cast("long"))
    rows = rows.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    in_truth = F.col("__truth") == 1
    runs = rows.groupBy(series, "__g").agg(F.collect_list(F.when(in_truth, F.struct("frame", "tolerance"))).alias("t"), F.collect_list(F.when(~in_truth, F.col("frame"))).alias("f")).where(F.size("t") > 0)

    kind = pa.list_(pa.struct([("frame", pa.int64()), ("detected_frame", pa.int64())]))

    @F.arrow_udf("array<struct<frame long, detected_frame long>>")
    def matched(t: pa.Array, f: pa.Array) -> pa.Array:
        def some(at: int) -> pa.Array:  # a batch may hold 10,000 runs, whose rows as objects take many times what its columns do
            pairs = zip(t.slice(at, RUNS_AT_ONCE).to_pandas(), f.slice(at, RUNS_AT_ONCE).to_pandas(), strict=True)
            return pa.array([nearest_free([(w["frame"], w["tolerance"]) for w in wanted], found.tolist()) for wanted, found in pairs], kind)

        return pa.concat_arrays([some(at) for at in range(0, len(t), RUNS_AT_ONCE)] or [pa.array([], kind)])

    return runs.select(series, F.inline(matched("t", "f")))


def boundary_scorecard(truth: DataFrame, detected: DataFrame, matches: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, n_truth, n_detected, n_matched, precision, recall, mean_error): with the rules for empty sides."""
    t, f = truth.groupBy(series).agg(F.count("*").alias("n_truth")), detected.groupBy(series).agg(F.count("*").alias("n_detected"))
    m = matches.where("detected_frame is not null").groupBy(series).agg(F.count("*").alias("n_matched"), F.avg(F.abs(F.col("detected_frame") - F.col("frame"))).alias("mean_error"))
    rows = t.join(f, series, "full_outer").join(m, series, "left").fillna(0, ["n_truth", "n_detected", "n_matched"])
    precision = F.when(F.col("n_detected") > 0, F.col("n_matched") / F.col("n_detected")).when(F.col("n_truth") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("n_truth") > 0, F.col("n_matched") / F.col("n_truth")).otherwise(1.0)
    return rows.select(series, "n_truth", "n_detected", "n_matched", precision.alias("precision"), recall.alias("recall"), F.coalesce("mean_error", F.lit(0.0)).alias("mean_error"))


#: Transitions that part no shots, and the confidence that others need to do so.
NO_SPLIT, SPLIT_CONFIDENCE = ("flash", "continuous"), 0.55


def full_scorecard(
    totals: DataFrame, truth: DataFrame, detected: DataFrame, short: DataFrame, samples: DataFrame, unresolved: DataFrame, labels: DataFrame, observed: DataFrame, audio_truth: DataFrame, audio: DataFrame, series: str = "series_id"
) -> DataFrame:
    """The ten metrics of each series of totals(series, total): precision, recall, mean_error, type_accuracy, short_recall, duplicate_reduction,
    unresolved_ratio, audio_coverage, label_error and accent_error.

    truth(frame, tolerance, type, splits, label), detected(frame, type, confidence), short(start, end), samples(frame, kept),
    unresolved(start, end), labels(label), observed(label), audio_truth(kind), audio(kind, frame). Precision and recall are of true splits against detections that part
    shots; the type is judged over all of both. Nothing wanted counts as reached; an accent error is measured from the boundary whose label ends in
    ``boundary``, and is the whole range if there is no accent.
    """
    from .joins import exists_in_range

    splits = detected.where(~F.col("type").isin(*NO_SPLIT) & (F.col("confidence") >= SPLIT_CONFIDENCE))
    split_truth = truth.where("splits")
    card = boundary_scorecard(split_truth, splits, match_within_tolerance(split_truth, splits.select(series, "frame"), series), series).select(series, "n_truth", "n_detected", "precision", "recall", "mean_error")
    every = match_within_tolerance(truth, detected.select(series, "frame"), series).where("detected_frame is not null")
    kinds = truth.select(series, "frame", F.col("type").alias("__t")).join(every, [series, "frame"]).join(detected.select(series, F.col("frame").alias("detected_frame"), F.col("type").alias("__d")), [series, "detected_frame"])
    right = kinds.groupBy(series).agg(F.sum((F.col("__t") == F.col("__d")).cast("long")).alias("__right"))
    n_all = truth.groupBy(series).agg(F.count("*").alias("__all"))
    seen = exists_in_range(short, samples.where("kept"), series, "frame").groupBy(series).agg(F.avg(F.col("found").cast("double")).alias("short_recall"))
    dropped = samples.groupBy(series).agg(F.avg((~F.col("kept")).cast("double")).alias("duplicate_reduction"))
    lost = unresolved.groupBy(series).agg(F.sum(F.col("end") - F.col("start")).alias("__lost"))
    reached = lambda wanted, there, c, out: wanted.select(series, c).distinct().join(there.select(series, c).distinct().withColumn("__there", F.lit(1.0)), [series, c], "left").groupBy(series).agg(F.avg(F.coalesce("__there", F.lit(0.0))).alias(out))
    mark = truth.where(F.col("label").endswith("boundary")).groupBy(series).agg(F.min("frame").alias("__mark"))
    accents = audio.where("kind = 'accent'").join(mark, series).groupBy(series).agg(F.min(F.abs(F.col("frame") - F.col("__mark"))).cast("double").alias("__accent"))
    rows = totals
    for part in (card, right, n_all, seen, dropped, lost, reached(labels, observed, "label", "__labels"), reached(audio_truth, audio, "kind", "audio_coverage"), mark, accents):
        rows = rows.join(part, series, "left")
    one, none = F.lit(1.0), F.lit(0.0)
    return rows.select(
        series, F.coalesce("precision", one).alias("precision"), F.coalesce("recall", one).alias("recall"), F.coalesce("mean_error", none).alias("mean_error"),
        F.coalesce(F.coalesce("__right", F.lit(0)) / F.col("__all"), one).alias("type_accuracy"), F.coalesce("short_recall", one).alias("short_recall"), F.coalesce("duplicate_reduction", none).alias("duplicate_reduction"),
        (F.coalesce("__lost", F.lit(0)) / F.col("total")).alias("unresolved_ratio"), F.coalesce("audio_coverage", one).alias("audio_coverage"), F.coalesce(1 - F.col("__labels"), none).alias("label_error"),
        F.when(F.col("__mark").isNull(), 0.0).otherwise(F.coalesce("__accent", F.col("total").cast("double"))).alias("accent_error"),
    )


def aggregate_scorecard(cases: DataFrame, group: str, fixture: str, profile: str, preferred: str = "structural") -> DataFrame:
    """(group, n, precision, recall, reduction, coverage): one case a fixture, the preferred profile's if any; micro from counts, mean and minimum."""
    rest = F.struct("matched", "detected", "truth", "reduction", "coverage")
    one = cases.groupBy(group, fixture).agg(F.max_by(rest, F.struct((F.col(profile) == preferred).alias("p"), -F.col("case_id"))).alias("c")).select(group, "c.*")
    micro = lambda below: F.when(F.sum(below) > 0, F.sum("matched") / F.sum(below))
    return one.groupBy(group).agg(F.count("*").alias("n"), F.coalesce(micro("detected"), F.lit(0.0)).alias("precision"), F.coalesce(micro("truth"), F.lit(1.0)).alias("recall"), F.avg("reduction").alias("reduction"), F.min("coverage").alias("coverage"))


def coverage_report(segments: DataFrame, samples_in: DataFrame, totals: DataFrame, gap_rows: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, ratio, n_segments, n_empty): share of the range without gaps, and segments that have no sample."""
    counts = segments.select(series, "segment_id").join(samples_in.groupBy(series, "segment_id").agg(F.count("*").alias("n")), [series, "segment_id"], "left")
    per = counts.groupBy(series).agg(F.count("*").alias("n_segments"), F.sum(F.col("n").isNull().cast("long")).alias("n_empty"))
    lost = gap_rows.groupBy(series).agg(F.sum(F.col("end") - F.col("start")).alias("lost"))
    return totals.join(per, series, "left").join(lost, series, "left").select(series, (1 - F.coalesce("lost", F.lit(0)) / F.col("total")).alias("ratio"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("n_empty", F.lit(0)).alias("n_empty"))


def coverage_checks(gap_rows: DataFrame, protected: DataFrame, totals: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, n_gaps, gaps_overlap, outside, n_protected): whether gaps overlap one another or leave [0, total), and how many samples are protected."""
    w = Window.partitionBy(series).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = gap_rows.withColumn("__reach", F.max("end").over(w)).join(totals, series)
    found = rows.groupBy(series).agg(F.count("*").alias("n_gaps"), F.max(F.coalesce(F.col("__reach") > F.col("start"), F.lit(False))).alias("gaps_overlap"), F.max((F.col("start") < 0) | (F.col("end") > F.col("total"))).alias("outside"))
    ids = protected.groupBy(series).agg(F.count_distinct("sample_id").alias("n_protected"))
    no = F.lit(False)
    return totals.select(series).join(found, series, "left").join(ids, series, "left").select(series, F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("gaps_overlap", no).alias("gaps_overlap"), F.coalesce("outside", no).alias("outside"), F.coalesce("n_protected", F.lit(0)).alias("n_protected"))


def manifest_order(rows: DataFrame, group: str, key: str, place: str, time: str) -> DataFrame:
    """(group, chronological, unique_ids): times never go back in order of place, and no id is there twice."""
    back = rows.withColumn("__back", F.col(time) < F.lag(time).over(Window.partitionBy(group).orderBy(place)))
    return back.groupBy(group).agg((F.max(F.coalesce("__back", F.lit(False)).cast("int")) == 0).alias("chronological"), (F.count_distinct(key) == F.count("*")).alias("unique_ids"))


def manifest_counts(rows: DataFrame, group: str, key: str, duplicate_of: str) -> DataFrame:
    """(group, n, n_kept, n_duplicate, n_dangling): duplicates must point to a row of the group."""
    there = rows.select(group, F.col(key).alias(duplicate_of), F.lit(1).alias("__there"))
    joined = rows.join(there, [group, duplicate_of], "left")
    is_dup = F.col(duplicate_of).isNotNull()
    return joined.groupBy(group).agg(F.count("*").alias("n"), F.sum((~is_dup).cast("long")).alias("n_kept"), F.sum(is_dup.cast("long")).alias("n_duplicate"), F.sum((is_dup & F.col("__there").isNull()).cast("long")).alias("n_dangling"))


def confidence_rollup(parts: DataFrame, series: str, dimension: str, confidence: str, dimensions: tuple[str, ...]) -> DataFrame:
    """(series, one mean a dimension (0 if it has none), overall: the least)."""
    means = [F.coalesce(F.avg(F.when(F.col(dimension) == d, F.col(confidence))), F.lit(0.0)).alias(d) for d in dimensions]
    out = parts.groupBy(series).agg(*means)
    return out.withColumn("overall", F.least(*dimensions))


def structure_confidence(all_series: DataFrame, segments: DataFrame, transitions: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, confidence): the mean over segments and transitions together; 1 for a series with neither."""
    both = segments.select(series, "confidence").unionByName(transitions.select(series, "confidence"))
    return all_series.select(series).distinct().join(both.groupBy(series).agg(F.avg("confidence").alias("confidence")), series, "left").select(series, F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def ordered_means(df: DataFrame, values: dict[str, str], order: tuple[str, ...], others: dict[str, Column], series: str = "series_id") -> DataFrame:
    """(series, the mean of each value, other aggregates): doubles are added up row by row along a unique ``order``, so a mean is the same to the bit however rows are dealt."""
    w = Window.partitionBy(series).orderBy(*order)
    running = df.withColumns({f"__{name}": F.avg(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for name, c in values.items()})
    return running.groupBy(series).agg(*[F.max_by(f"__{name}", F.struct(*order)).alias(name) for name in values], *[c.alias(name) for name, c in others.items()])


def completeness_status(coverage: DataFrame, series: str, needed: dict[str, float], unresolved: str, slack: float = 1e-10) -> DataFrame:
    """(series, reasons, status): complete if every dimension is covered as needed and nothing is unresolved.

    A coverage that is less by no more than ``slack`` is as needed: sums of doubles in another order differ by less, and a mean on the limit is not below it.
    """
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0.0)) < least - slack, F.lit(f"{c} below {least}")) for c, least in needed.items()], F.when(F.col(unresolved) > 0, F.lit("unresolved"))))
    return coverage.select(series, F.array_join(F.array_sort(F.array_distinct(reasons)), ",").alias("reasons"), F.when(F.size(reasons) == 0, "complete").otherwise("partial").alias("status"))


def hypothesis_gates(rows: DataFrame, series: str, valid: Column, least: int = 2, share: float = 0.05) -> DataFrame:
    """(series, n, n_valid, status): supported if more rows are valid than max(least, floor(share n))."""
    out = rows.groupBy(series).agg(F.count("*").alias("n"), F.sum(F.coalesce(valid, F.lit(False)).cast("long")).alias("n_valid"))
    return out.withColumn("status", F.when(F.col("n_valid") > F.greatest(F.lit(least), F.floor(share * F.col("n"))), "supported").when(F.col("n_valid") > 0, "weak").otherwise("unsupported"))


def phase_model(rows: DataFrame, series: str, model: str) -> DataFrame:
    """(series, model, perspective): unknown or perspective where their shares say so, else the most frequent, the first by name among equals."""
    counts = rows.groupBy(series, model).agg(F.count("*").alias("n"))
    agg = counts.groupBy(series).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col(model) == "homography", F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col(model) == "unknown", F.col("n"))), F.lit(0)).alias("u"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(model).alias("m"))))[0]["m"].alias("most"),
    )
    share = F.col("p") / F.col("total")
    return agg.select(series, F.when(share >= 0.25, "homography").when(F.col("u") / F.col("total") >= 0.20, "unknown").otherwise(F.col("most")).alias("model"), share.alias("perspective"))


def twist_candidates(rows: DataFrame, coupling: DataFrame, series: str, model: str) -> DataFrame:
    """(series, explanation, twist): why a series turns as it does, and how much of a twist that is.

    coupling(series, explanation, max_offset, deviation, confidence) as of ``similarity_coupling``; perspective and unknown shares go before
    its explanation.
    """
    shares = rows.groupBy(series).agg(F.avg((F.col(model) == "homography").cast("double")).alias("__p"), F.avg((F.col(model) == "unknown").cast("double")).alias("__u"))
    out = shares.join(coupling, series)
    explanation = F.when(F.col("__p") >= 0.25, "perspective with coupled rotation").when(F.col("__u") >= 0.20, "structured residual or local warp").otherwise(F.col("explanation"))
    twist = F.col("confidence") * F.least(F.lit(1.0), F.abs(F.col("max_offset")) / 0.20 + F.col("deviation") / 0.02)
    return out.select(series, explanation.alias("explanation"), twist.alias("twist"))


def paired_diagnostics(pairs: DataFrame, group: str, reference: str, candidate: str, order: str = "seq") -> DataFrame:
    """(group, means, black, sharpness, mae, rmse): rasters of a candidate against those of a reference, errors weighted by element count."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    mean = lambda c: total(F.col(c)) / F.size(c)
    rough = lambda c: total(F.zip_with(F.slice(F.col(c), F.lit(2), F.size(c) - 1), F.slice(F.col(c), F.lit(1), F.size(c) - 1), lambda a, b: F.abs(a - b)))
    rows = pairs.withColumns({
        "__r": mean(reference), "__c": mean(candidate), "__sharp": rough(candidate) / F.greatest(F.lit(1e-9), rough(reference)), "__n": F.size(reference),
        "__abs": total(F.zip_with(reference, candidate, lambda a, b: F.abs(a - b))), "__sq": total(F.zip_with(reference, candidate, lambda a, b: (a - b) * (a - b))),
    })
    w = Window.partitionBy(group).orderBy(order)
    rows = rows.withColumn("__dt", (F.col("__c") - F.lag("__c").over(w)) - (F.col("__r") - F.lag("__r").over(w)))
    return rows.groupBy(group).agg(
        F.avg("__r").alias("reference_mean"), F.avg("__c").alias("candidate_mean"), F.sum(((F.col("__c") <= 1) & (F.col("__r") >= 5)).cast("long")).alias("unexpected_black"), F.percentile("__sharp", F.lit(0.1)).alias("sharpness_p10"),
        F.sqrt(F.avg(F.col("__dt") * F.col("__dt"))).alias("temporal_rmse"), (F.sum("__abs") / F.sum("__n")).alias("mae"), F.sqrt(F.sum("__sq") / F.sum("__n")).alias("rmse"),
    )


def corpus_diversity(cases: DataFrame, group: str, digest: str, aspect: str, kind: str, required: tuple[str, ...]) -> DataFrame:
    """(group, n, n_unique, min_aspect, max_aspect, n_missing): how varied a corpus is, and how many required kinds it lacks."""
    lacking = [(F.max((F.col(kind) == k).cast("int")) == 0).cast("int") for k in required]
    missing = lacking[0]
    for c in lacking[1:]:
        missing = missing + c
    return cases.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("n_unique"), F.min(aspect).alias("min_aspect"), F.max(aspect).alias("max_aspect"), missing.alias("n_missing"))


def corpus_replay(cases: DataFrame, replayed: DataFrame, group: str, case: str, digest: str) -> DataFrame:
    """(group, n, n_equal, n_only, replay_equal): whether a second run made the same digests for the same cases."""
    b = replayed.select(group, case, F.col(digest).alias("__d"), F.lit(1).alias("__b"))
    rows = cases.select(group, case, digest, F.lit(1).alias("__a")).join(b, [group, case], "full_outer")
    same = F.col(digest).eqNullSafe(F.col("__d")) & F.col("__a").isNotNull() & F.col("__b").isNotNull()
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("n_equal"), F.sum((F.col("__a").isNull() | F.col("__b").isNull()).cast("long")).alias("n_only"))
    return out.withColumn("replay_equal", F.col("n") == F.col("n_equal"))


def contract_extrema(rows: DataFrame, series: str, order: str, centre: tuple[str, str], pivot: tuple[str, str], at: tuple[float, float], expected: str, actual: str) -> DataFrame:
    """(series, max_center_step, max_matrix_error, max_pivot_deviation): the largest move of the centre between neighbouring rows, difference of an
    element of the expected and the actual matrix (arrays of 9), and distance of the pivot from where it should be.
    """
    w = Window.partitionBy(series).orderBy(order)
    x, y = F.col(centre[0]), F.col(centre[1])
    steps = rows.withColumn("__step", F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)))
    off = F.array_max(F.zip_with(expected, actual, lambda a, b: F.abs(a - b)))
    return steps.groupBy(series).agg(F.coalesce(F.max("__step"), F.lit(0.0)).alias("max_center_step"), F.max(off).alias("max_matrix_error"), F.max(F.hypot(F.col(pivot[0]) - at[0], F.col(pivot[1]) - at[1])).alias("max_pivot_deviation"))


def step_extrema(rows: DataFrame, series: str, order: str, *channels: str) -> DataFrame:
    """(series, the largest step of each channel between neighbouring rows)."""
    w = Window.partitionBy(series).orderBy(order)
    steps = rows.withColumns({f"__{c}": F.abs(F.col(c) - F.lag(c).over(w)) for c in channels})
    return steps.groupBy(series).agg(*[F.coalesce(F.max(f"__{c}"), F.lit(0.0)).alias(f"max_{c}_step") for c in channels])


def requirement_index(cases: DataFrame, case: str, tags: Column) -> DataFrame:
    """(tag, n, first, last): cases by tag. The list of a tag is left exploded (tag, case) upstream; here its size and ends."""
    return cases.select(F.explode(tags).alias("tag"), F.col(case).alias("c")).groupBy("tag").agg(F.count_distinct("c").alias("n"), F.min("c").alias("first"), F.max("c").alias("last"))


def requirement_postings(cases: DataFrame, case: str, tags: Column, span: int = 10_000) -> DataFrame:
    """(tag, part, ids): the sorted, distinct ids of the cases of each tag, in parts by range of id, so no list is longer than ``span``."""
    rows = cases.select(F.explode(tags).alias("tag"), F.col(case).alias("c"))
    return rows.groupBy("tag", F.floor(F.col("c") / span).alias("part")).agg(F.array_sort(F.collect_set("c")).alias("ids"))
