"""Small inputs with answers worked out by hand, and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoform.functions import scalar
from chronoform.operators import grouped as G
from chronoform.operators import intervals as I
from chronoform.operators import joins as J
from chronoform.operators import ledger as L
from chronoform.operators import sampling as P
from chronoform.operators import scorecards as K
from chronoform.operators import series as S
from chronoform.operators import text as T
from chronoform.operators import vectors as V
from chronoform.sources import evidence as E
from chronoform.sources.storage import new_path


def series(spark, values, name="signal"):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], f"series_id long, seq long, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("seq").collect()]


def test_unwrap(spark):
    assert column(S.unwrap_degrees(series(spark, [170, 178, -176, -169])), "unwrapped") == [170, 178, 184, 191]


def test_derivatives_of_a_parabola(spark):
    out = S.finite_derivatives(series(spark, [0, 0.04, 0.16, 0.36, 0.64, 1]), 5.0).orderBy("seq").collect()
    assert len(out) == 6 and max(abs(r.jerk) for r in out) < 125
    assert [round(r.velocity, 9) for r in out] == [0, 0.4, 0.8, 1.2, 1.6, 2.0]
    assert S.classify_curve(series(spark, [0, 0.04, 0.16, 0.36, 0.64, 1])).first().curve == "ease_in"
    assert [r.velocity for r in S.finite_derivatives(series(spark, [3]), 5.0).collect()] == [0]


def test_hampel(spark):
    out = S.hampel(series(spark, [0, 0.03, 0.12, 0.27, 5, 0.75, 0.91, 1])).orderBy("seq").collect()
    assert [r.seq for r in out if r.outlier] == [4] and out[4].filtered == pytest.approx(0.51)
    assert all(r.filtered == r.signal for r in out if r.seq != 4)


def test_local_polynomials(spark):
    t = np.linspace(0, 1, 333)
    noisy = t * t * (3 - 2 * t) + 0.0015 * np.sin(2.37 * np.arange(333))
    truth = 6 * t * (1 - t) * 25 / 332
    fitted = column(G.local_polynomial(series(spark, noisy), 25.0, 21), "velocity")
    raw = column(S.finite_derivatives(series(spark, noisy), 25.0), "velocity")
    error = lambda v: np.sqrt(np.mean((np.array(v) - truth) ** 2))
    assert error(fitted) < 0.25 * error(raw) and abs(int(np.argmax(fitted)) - 166) <= 3
    cubic = G.local_polynomial(series(spark, np.arange(20.0) ** 3), 1.0).orderBy("seq").collect()
    assert [round(r.velocity, 6) for r in cubic] == [3.0 * i * i for i in range(20)] and round(cubic[7].jerk, 6) == 6
    assert G.local_polynomial(series(spark, [1, 2]), 1.0).count() == 2


def test_coupling(spark):
    t = np.linspace(0, 1, 333)
    shared = t * t * (3 - 2 * t)
    late = shared**1.55
    rows = [(1, i, float(0.2 + 0.6 * c), float(0.3 + 0.4 * c + 0.05 * np.sin(np.pi * c)), float(1 + s), float(30 * s)) for i, (s, c) in enumerate(zip(shared, late, strict=True))]
    out = G.similarity_coupling(spark.createDataFrame(rows, "series_id long, seq long, cx double, cy double, sc double, ro double"), 25.0, "cx", "cy", "sc", "ro").first()
    assert out.relation == "centre lags" and out.max_offset > 0.10 and out.lag > 20 and out.rmse < 1e-9 and out.confidence >= 0.9


def test_effective_evidence_keeps_history(spark):
    from datetime import datetime

    rows = [("a", 1, "silence", "measured", datetime(2024, 1, 2), [], None), ("b", 1, "silence", "human-correction", datetime(2024, 1, 1), ["a"], None), ("c", 1, "silence", "measured", datetime(2024, 1, 3), ["zz"], None)]
    df = spark.createDataFrame(rows, "id string, asset_id long, kind string, authority string, generated_at timestamp, supersedes array<string>, failed_kind string")
    assert [r.id for r in L.effective_evidence(df).collect()] == ["b"] and df.count() == 3
    assert [(r.id, r.problem) for r in L.validate_supersession(df).collect()] == [("c", "missing")]


def test_error_rates(spark):
    df = spark.createDataFrame([("one two, three four five six seven.", "One two three four; five six seven"), ("one two three four five six seven", "one two three four nine six seven"), ("", ""), ("", "a b")], "e string, a string")
    out = df.select(T.wer(scalar.normalize_words("e"), scalar.normalize_words("a")).alias("w"), T.cer(scalar.normalize_words("e"), scalar.normalize_words("a")).alias("c")).collect()
    assert [r.w for r in out] == [0, pytest.approx(1 / 7), 0, 2] and out[0].c == 0


def test_edits_match_plain_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 9)))) for _ in "ab")
        d = np.add.outer(np.arange(len(a) + 1), np.arange(len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert T.edits(a, b) == d[-1, -1]


def test_timelines(spark):
    clips = spark.createDataFrame([(1, "v", "video", "a", 0, 60), (1, "v", "video", "b", 50, 100), (2, "v", "video", "a", 0, 60), (2, "w", "video", "b", 50, 100)], "series_id long, track_id string, track_kind string, clip_id string, start long, end long")
    out = I.validate_timeline(clips, clips.select("series_id").distinct().withColumn("duration", F.lit(100)))
    assert [(r.series_id, r.clip_id, r.problem) for r in out.collect()] == [(1, "a", "overlap")]


def test_patch_inverse_restores(spark):
    ops = spark.createDataFrame([("d", "/background", 0, "add", "#000000"), ("d", "/background", 1, "replace", "#ffffff")], "doc_id string, path string, seq long, op string, value string")
    out = I.patch_log(ops).orderBy("seq").collect()
    assert (out[1].inverse_op, out[1].inverse_value) == ("replace", "#000000") and out[0].inverse_op == "remove"


def test_binding_continuity(spark):
    rows = [("s", 1, "g", 0, 60, 1.0, 60.0), ("s", 2, "g", 61, 241, 3.0, 60.0), ("s", 3, "g", 241, 301, 1.0, 60.0)]
    df = spark.createDataFrame(rows, "spec string, ord long, grp string, start long, end long, speed double, frames double")
    assert [(r.ord, r.gap) for r in S.binding_continuity(df, "spec", "ord", "grp", "start", "end", "speed", "frames").collect()] == [(2, True)]


def test_alignment_to_script(spark):
    beats = ["open the project and look around", "run the build and read the result"]
    segments = ["open the project", "and look around", "run the build", "and read the result"]
    out = G.align_to_script(spark.createDataFrame([(1, beats, segments), (2, beats, segments[:1])], "series_id long, beats array<string>, segments array<string>")).orderBy("series_id").collect()
    assert out[0].ends == [2, 4] and out[0].cost == pytest.approx(0.15 * 2 * (0.5 - 6 / 13)) and out[1].ends is None


def test_silence_cues(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, 1.0], [28, 70, 69, 0], 90), (2, [1.0, 1.0], [], 3)], "series_id long, weights array<double>, silences array<long>, frames long")
    assert [r.bounds for r in G.silence_cues(df).orderBy("series_id").collect()] == [[0, 28, 69, 90], [0, 2, 3]]


def test_greedy_matching_is_one_to_one(spark):
    truth = spark.createDataFrame([(1, 10, 5), (1, 12, 5), (1, 13, 5), (2, 7, 1)], "series_id long, frame long, tolerance long")
    found = spark.createDataFrame([(1, 12), (1, 14), (1, 40), (2, 9)], "series_id long, frame long")
    out = {(r.series_id, r.frame): r.detected_frame for r in K.match_within_tolerance(truth, found).collect()}
    assert out == {(1, 10): 12, (1, 12): 14, (1, 13): None, (2, 7): None}


def test_greedy_dedup_compares_with_kept_rows_only(spark):
    df = spark.createDataFrame([(1, i, i == 5) for i in range(6)], "series_id long, seq long, protected boolean")
    links = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 3, 0), (1, 5, 4)], "series_id long, seq long, duplicate_of long")
    out = {r.seq: (r.kept, r.duplicate_of) for r in V.greedy_dedup(df, links, "protected").collect()}
    assert out == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (False, 0), 4: (True, None), 5: (True, None)}


def test_onsets_wait_after_the_last_kept(spark):
    rows = [(1, 0.0, 0.0), (1, 0.1, 0.5), (1, 0.15, 0.0), (1, 0.2, 0.6), (1, 0.25, 0.0), (1, 0.3, 0.9), (1, 1.0, 0.0), (1, 1.1, 0.2)]
    df = spark.createDataFrame(rows, "series_id long, t_seconds double, signal double")
    out = G.energy_onsets(df, spark.createDataFrame([(1, 0.1)], "series_id long, threshold double"))
    assert sorted(round(r.t, 2) for r in out.collect()) == [0.1, 0.3, 1.1]


def test_samples_keep_to_the_budget(spark):
    bounds = spark.createDataFrame([(1, 0, 100)], "series_id long, lo long, hi long")
    segments = spark.createDataFrame([(1, "a", 0, 50), (1, "b", 50, 100)], "series_id long, segment_id string, start long, end long")
    cuts, pins = spark.createDataFrame([(1, 50)], "series_id long, frame long"), spark.createDataFrame([(1, 77), (1, 500)], "series_id long, frame long")
    out = {r.frame: r.role for r in P.budgeted_sample(bounds, segments, cuts, pins, 4, 12).collect()}
    assert len(out) == 12 and out[0] == "first" and out[99] == "last" and out[50] == "boundary" and out[49] == "pre" and out[51] == "post" and out[77] == "pinned"
    small = P.budgeted_sample(bounds, segments, cuts, pins, 4, 7).collect()
    assert len(small) == 7 and sum(r.protected for r in small) == 6


def test_segments_partition_their_range(spark):
    bounds = spark.createDataFrame([(1, 0, 10)], "series_id long, start long, end long")
    cuts = spark.createDataFrame([(1, 0, 0.9), (1, 4, 0.9), (1, 4, 0.8), (1, 7, 0.2), (1, 10, 0.9)], "series_id long, frame long, confidence double")
    out = S.segment(bounds, cuts)
    assert [(r.segment_id, r.start, r.end) for r in out.orderBy("start").collect()] == [("shot-0001", 0, 4), ("shot-0002", 4, 10)]
    assert S.validate_partition(out, bounds).count() == 0


def test_point_in_range_covers_wide_ranges(spark):
    ranges = spark.createDataFrame([(1, 0, 1000, "w"), (1, 1000, 1001, "n")], "series_id long, start long, end long, segment_id string")
    points = spark.createDataFrame([(1, i) for i in (0, 63, 64, 999, 1000, 1001)], "series_id long, seq long")
    assert sorted((r.seq, r.segment_id) for r in J.point_in_range(points, ranges).collect()) == [(0, "w"), (63, "w"), (64, "w"), (999, "w"), (1000, "n")]


def test_report_refuses_overwrite(spark):
    path = new_path(spark, "report")
    df = spark.createDataFrame([(1,)], "a long")
    E.write_report(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        E.write_report(df, path)


def test_failures_are_rows(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x")], "k long, v string")
    out = {(r.k, r.kind): (r.ok, r.value, r.error_type) for r in G.run_analyzers(df, {"n": float, "len": len}, "k", "v").collect()}
    assert out == {(1, "n"): (True, 4.0, None), (1, "len"): (True, 1.0, None), (2, "n"): (False, None, "ValueError"), (2, "len"): (True, 1.0, None)}


def brute_warp(y, shifts):
    """(early, tail, error) over every pair of shifts."""
    last, found = len(y) - 1, []
    third, two, out = last // 3, 2 * last // 3, np.arange(len(y))
    for early in shifts:
        for tail in shifts:
            if 0 < third + early < two + tail < last:
                shown = np.interp(np.interp(out, [0, third, two, last], [0, third + early, two + tail, last]), out, y)
                error = float(np.sqrt(np.mean((shown - (y[0] + (y[-1] - y[0]) * out / last)) ** 2)))
                found.append((round(error, 9), abs(early) + abs(tail), abs(early), early, tail))
    error, _, _, early, tail = min(found)
    return early, tail, error


def test_warp_search_measures_every_pair(spark, monkeypatch):
    from chronoform.plans import grouped_queries as Q

    shifts, rng = (-6, -4, -2, 0, 2, 4, 6), np.random.default_rng(5)
    ys = {i: np.cumsum(rng.random(int(rng.integers(7, 40))) ** 4) for i in range(60)}
    rows = [(i, n, float(x)) for i, y in ys.items() for n, x in enumerate(np.diff(y, prepend=0))]
    monkeypatch.setattr(Q, "ev", lambda *_: spark.createDataFrame(rows, "series_id long, seq long, signal double"))
    got = {r.series_id: (r.early, r.tail, r.error) for r in Q.c32_search_phase_warp(spark, "").collect()}
    assert got.keys() == ys.keys()
    for i, y in ys.items():
        early, tail, error = brute_warp(y, shifts)
        assert got[i] == (early, tail, pytest.approx(error, abs=2e-6)), i


def test_probe_keeps_a_duration_of_zero(spark):
    rows = [(1, '{"format": {"duration": "0.0"}}'), (2, '{"format": {"duration": "-1.5"}}'), (3, '{"format": {"duration": "N/A"}}'), (4, '{"format": {"duration": "2.5"}}'), (5, '{"format": {}}')]
    found = E.parse_probe(spark.createDataFrame(rows, "id long, payload string"), "payload", "id")
    assert {r.id: r.duration for r in found.collect()} == {1: 0.0, 2: -1.5, 3: None, 4: 2.5, 5: None}


def test_coverage_on_its_limit_is_not_below_it(spark):
    from chronoform.operators import scorecards as K

    sums = [0.09999999999999999, 0.1, 0.09]  # the first is ten times 0.1 added up, over ten
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(sums)], "series_id long, visual double, open long")
    assert sums[0] < 0.1
    assert {r.series_id: r.status for r in K.completeness_status(df, "series_id", {"visual": 0.1}, "open").collect()} == {0: "complete", 1: "complete", 2: "partial"}


def warp_errors(y, shifts):
    """{(early, tail): error} of a series {frame: value}, frames without a value shown by none."""
    last, found = max(y), {}
    third, two = last // 3, 2 * last // 3
    for early in shifts:
        for tail in shifts:
            if 0 < third + early < two + tail < last:
                squares = []
                for out in range(last + 1):
                    at = float(np.interp(out, [0, third, two, last], [0, third + early, two + tail, last]))
                    lo, hi = y.get(int(np.floor(round(at, 9)))), y.get(int(np.ceil(round(at, 9))))
                    if lo is not None and hi is not None:
                        squares.append((lo + (hi - lo) * (at - np.floor(round(at, 9))) - (y[min(y)] + (y[last] - y[min(y)]) * out / last)) ** 2)
                found[early, tail] = float(np.sqrt(np.mean(squares)))
    return found


def least_warp(errors):
    return min((round(e, 9), abs(early) + abs(tail), abs(early), early, tail) for (early, tail), e in errors.items())[3:]


def test_warp_search_of_blocks_gaps_and_many_shifts(spark):
    rng, shifts = np.random.default_rng(9), (-3, -2, -1, 0, 1, 2, 3)
    ys = {i: dict(enumerate(np.cumsum(rng.random(int(rng.integers(7, 90))) ** 4).tolist())) for i in range(12)}
    df = spark.createDataFrame([(i, n, x) for i, y in ys.items() for n, x in y.items()], "series_id long, seq long, signal double")
    found = lambda df, **k: {r.series_id: (r.early, r.tail) for r in G.search_phase_warp(df, shifts, **k).collect()}
    want = {i: least_warp(warp_errors(y, shifts)) for i, y in ys.items()}
    assert found(df) == found(df, block_rows=16) == want
    gaps = {i: {n: x for n, x in y.items() if n % 5 != 3 or n == max(y)} for i, y in ys.items()}
    holes = df.join(spark.createDataFrame([(i, n) for i, y in gaps.items() for n in y], "series_id long, seq long"), ["series_id", "seq"])
    assert found(holes) == {i: least_warp(warp_errors(y, shifts)) for i, y in gaps.items()}
    # of more shifts than ``best``, those of either anchor that are best with the other at rest
    few = {}
    for i, y in ys.items():
        errors = warp_errors(y, shifts)
        top = lambda k: sorted((round(e, 9), abs(p[k]), p[k]) for p, e in errors.items() if p[1 - k] == 0)[:2]
        few[i] = {p: e for p, e in errors.items() if p[0] in [t[2] for t in top(0)] and p[1] in [t[2] for t in top(1)]}
    assert found(df, best=2) == {i: least_warp(e) for i, e in few.items() if e}


def test_warp_search_joins_no_frames(spark):
    df = spark.createDataFrame([(s, i, float(i * i % 7)) for s in range(3) for i in range(20)], "series_id long, seq long, signal double")
    assert "Join" not in G.search_phase_warp(df, (-2, 0, 2))._jdf.queryExecution().executedPlan().toString()


def test_means_are_taken_in_the_order_of_the_table(spark, monkeypatch):
    from chronoform.plans import scorecard_queries as Q

    rng, rows, want = np.random.default_rng(3), [], {}
    for i in range(200):  # of each series the mean is 0.5, but for the rounding of its sum
        half = rng.integers(0, 101, 30)
        edge = rng.permutation(np.concatenate([half, 100 - half])) / 100.0
        rows += [(i, n, n // 2, "view", 0.5, float(v)) for n, v in enumerate(edge)]
        want[i] = "partial" if np.cumsum(edge)[-1] / 60 < 0.5 else "complete"
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "series_id long, event_id long, ts long, kind string, signal double, edge double")
    monkeypatch.setattr(Q, "ev", lambda *_: df.repartition(7))
    assert {r.series_id: r.status for r in Q.f11_completeness_status(spark, "").collect()} == want
    assert set(want.values()) == {"partial", "complete"}
