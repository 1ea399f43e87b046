"""Known answers and refusals of what the operators do beside their queries."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoform.functions import scalar
from chronoform.operators import grouped as G
from chronoform.operators import intervals as I
from chronoform.operators import joins as J
from chronoform.operators import ledger as L
from chronoform.operators import scorecards as K
from chronoform.operators import series as S
from chronoform.operators import surface
from chronoform.operators import text as T
from chronoform.operators import vectors as V
from chronoform.sources import evidence as E


def test_unknown_fields_fail_a_strict_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "at": {"x": 1}, "list": [{"k": "v"}]}')
    schema = "id long, at struct<x: long>, list array<struct<k: string>>"
    assert E.read_evidence(spark, f"file://{tmp_path}", schema).count() == 1
    (tmp_path / "b.json").write_text('{"id": 2, "at": {"x": 1, "y": 2}, "list": [{"k": "v", "z": 1}], "extra": 0}')
    with pytest.raises(ValueError, match=r"at\.y, extra, list\[\]\.z"):
        E.read_evidence(spark, f"file://{tmp_path}", schema)
    assert E.read_evidence(spark, f"file://{tmp_path}", schema, strict=False).count() == 2


def test_append_only_refuses_other_content(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert {r.status for r in E.append_only(spark, df, path, "k").collect()} == {"new"}
    assert {r.status for r in E.append_only(spark, df, path, "k").collect()} == {"same"}
    with pytest.raises(ValueError, match="1 keys"):
        E.append_only(spark, spark.createDataFrame([(2, "x"), (3, "c")], "k long, v string"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_hashes_tell_fields_apart(spark):
    df = spark.createDataFrame([("a\x1f=b", "c"), ("a", "b\x1f=c"), (None, "c"), ("", "c"), ("~", "c")], "x string, y string")
    assert df.select(scalar.canonical_hash("x", "y").alias("h")).distinct().count() == 5
    assert df.select((scalar.canonical_hash("x", "y") == scalar.canonical_hash("y", "x")).alias("same")).where("not same").count() == 0


def test_fingerprints_are_recursive(spark):
    row = lambda i, at, ref, k: (i, {"at": at, "deep": {"ref": ref, "k": k}}, [{"at": at, "k": k}])
    schema = "id long, head struct<at: long, deep: struct<ref: string, k: long>>, rows array<struct<at: long, k: long>>"
    df = spark.createDataFrame([row(1, 5, "a", 7), row(2, 6, "b", 7), row(3, 5, "a", 8)], schema)
    a, b, c = (r.fingerprint for r in L.semantic_fingerprint(df, ("id", "at"), {"ref": "asset"}).orderBy("id").collect())
    assert a == b != c


def test_a_point_without_a_range_fails(spark):
    points, ranges = spark.createDataFrame([("a", 1), ("a", 9)], "series_id string, seq long"), spark.createDataFrame([("a", "s", 0, 5)], "series_id string, segment_id string, start long, end long")
    assert J.required_range(points.where("seq < 5"), ranges).count() == 1
    with pytest.raises(Exception, match="no range holds 9 of series a"):
        J.required_range(points, ranges).collect()


def test_chains_of_any_depth_and_cycles(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)] + [("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r.id, r.ancestor): r.steps for r in J.version_chain(edges, spark.createDataFrame([("n0",), ("x",)], "id string")).collect()}
    assert got[("n0", "n25")] == 25 and got[("x", "y")] == 1 and got[("x", "x")] == 0 and len(got) == 28
    assert max(r.steps for r in J.version_chain(edges, spark.createDataFrame([("n0",)], "id string"), depth=3).collect()) == 3


def test_singular_matrices_and_keys_out_of_range_fail(spark):
    eye, flip = np.eye(3).ravel().tolist(), np.diag([-1.0, 1, 1]).ravel().tolist()
    keys, times = spark.createDataFrame([("a", 0, eye), ("a", 4, flip)], "series_id string, seq long, m array<double>"), spark.createDataFrame([("a", 1), ("a", 2)], "series_id string, t long")
    assert I.densify_matrix(keys, times.where("t = 1")).first().m[0] == 0.5
    with pytest.raises(Exception, match="singular"):
        I.densify_matrix(keys, times).collect()
    with pytest.raises(Exception, match="outside the source range"):
        I.retime_curve(keys, (0, 3), (0, 6)).collect()
    moved = {r.seq: (r.num, r.den) for r in I.retime_curve(keys, (0, 6), (1, 2)).collect()}
    assert moved == {0: (1, 1), 4: (5, 3)}


def test_bezier_with_straight_handles_is_a_line(spark):
    keys = spark.createDataFrame([("a", 0, 1.0, 3.0, 2.0, 0.0, 0.0), ("a", 9, 7.0, 0.0, 0.0, -3.0, -2.0)], "series_id string, seq long, value double, out_t double, value_out double, in_t double, value_in double")
    got = {r.t: r.value for r in I.densify_bezier(keys, spark.createDataFrame([("a", t) for t in range(-1, 11)], "series_id string, t long")).collect()}
    assert got == pytest.approx({t: 1 + 6 * min(9, max(0, t)) / 9 for t in range(-1, 11)}, abs=1e-9)


def test_matrix_tangents_follow_the_cubic(spark):
    eye = np.eye(3).ravel().tolist()
    end, zero, one = np.diag([3.0, 1, 1]).ravel().tolist(), [0.0] * 9, [0.5] + [0.0] * 8
    keys = spark.createDataFrame([("a", 0, eye, zero, one), ("a", 4, end, one, zero)], "series_id string, seq long, m array<double>, m_in array<double>, m_out array<double>")
    got = I.densify_matrix(keys, spark.createDataFrame([("a", 2)], "series_id string, t long"), "tangents").first().m
    assert got[0] == pytest.approx(2.0) and got[4] == 1.0


def brute_coupling(cx, cy, sc, ro, fps):
    """Straight from the formulas, on series of 15 rows or more, whose window is never cut."""
    weights = G.polynomial_weights(15, 3)

    def fit(xs):
        out = np.zeros((len(xs), 2))
        for i in range(len(xs)):
            a = min(max(0, i - 7), len(xs) - 15)
            out[i] = (weights[i - a] @ xs[a : a + 15])[:2]
        out[0, 0], out[-1, 0] = xs[0], xs[-1]
        return out[:, 0], out[:, 1] * fps

    cx, cy, sc, ro = (fit(np.asarray(x, float))[0] for x in (cx, cy, sc, ro))
    shared = np.mean([(x - x[0]) / (x[-1] - x[0]) for x in (sc, ro)], axis=0)
    rmse = np.sqrt(np.mean(((sc - sc[0]) / (sc[-1] - sc[0]) - (ro - ro[0]) / (ro[-1] - ro[0])) ** 2))
    path = np.stack([cx, cy], 1)
    along = path[-1] - path[0]
    centre = (path - path[0]) @ along / (along @ along)
    offset = shared - centre
    top = int(np.abs(offset).argmax())
    strong = np.flatnonzero(np.abs(offset) >= max(0.02, 0.75 * abs(offset[top])))
    strong = strong if len(strong) else np.array([top])
    lag = int(np.abs(fit(centre)[1]).argmax()) - int(np.abs(fit(shared)[1]).argmax())
    v = np.stack([fit(cx)[1], fit(cy)[1]], 1)
    speed = np.linalg.norm(v, axis=1)
    active = np.flatnonzero(speed >= 0.15 * speed.max())
    heading = np.unwrap(np.arctan2(v[:, 1], v[:, 0]))
    deviation = np.linalg.norm(path - path[0] - np.outer(centre, along), axis=1).max()
    return {"start": strong[0], "peak": top, "end": strong[-1], "max_offset": offset[top], "lag": lag, "rmse": rmse, "centre_rmse": np.sqrt(np.mean(offset**2)), "deviation": deviation, "heading_change": np.degrees(heading[active[-1]] - heading[active[0]])}


def test_coupling_matches_brute_force(spark):
    rows, want = [], {}
    for s in range(4):
        rng, t = np.random.default_rng(s), np.linspace(0, 1, 30 + s)
        cx, cy, sc, ro = t**2 + 0.01 * rng.normal(size=len(t)), 0.3 * np.sin(2 * t) + 0.2 * s * t, 1 + t + 0.01 * rng.normal(size=len(t)), 40 * t ** (1 + s / 4)
        want[s] = brute_coupling(cx, cy, sc, ro, 25.0)
        rows += [(s, i, *map(float, x)) for i, x in enumerate(zip(cx, cy, sc, ro, strict=True))]
    rows += [(9, i, 1.0, 1.0, float(i), float(i)) for i in range(20)] + [(8, i, float(i), 0.0, float(i), 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "series_id long, seq long, cx double, cy double, sc double, ro double")
    got = {r.series_id: r for r in G.similarity_coupling(df, 25.0, "cx", "cy", "sc", "ro").collect()}
    assert set(got) == set(want)
    for s, w in want.items():
        assert {k: getattr(got[s], k) for k in w} == pytest.approx(w, rel=1e-6, abs=1e-8)


def test_russian_commands(spark):
    df = spark.createDataFrame([("скорость до 2x",), ("ДЛИТЕЛЬНОСТЬ = 3,5 и чёрный фон #00ff00",), ("фон зелёный",), ("   ",), ("привет",), ("включи и отключи",)], "c string")
    got = [(r.intents, r.error) for r in T.tag_commands(df, "c").collect()]
    assert got == [(["speed:2.00"], None), (["background:#00ff00", "duration:88"], None), ([], "background needs a colour"), ([], "empty"), ([], "no rule matched"), (["enabled:false"], None)]


def test_functions_of_sql(spark):
    surface.register(spark)
    got = [(r.ordinal, r.beat) for r in spark.sql("SELECT * FROM split_beats('# head\n\nOne here. Two  there!\n\nthree')").collect()]
    assert got == [(0, "One here."), (1, "Two there!"), (2, "three")]
    assert [r.frame for r in spark.sql("SELECT * FROM even_frames(10, 20, 4)").collect()] == [10, 13, 16, 19]
    assert spark.sql("SELECT median_deviation(collect_list(x)) d FROM VALUES (1.0D), (2.0D), (9.0D), (null) t(x)").first().d == 1.0
    assert spark.sql("SELECT median_deviation(array()) d").first().d is None
    assert spark.sql("SELECT classify_curve(array(0D, 0.0625D, 0.25D, 0.5625D, 1D)).curve c").first().c == "ease_in"


def test_table_functions_over_parted_tables(spark):
    surface.register(spark)
    spark.createDataFrame([("a", 4, 8.0), ("a", 0, 0.0), ("b", 7, 1.0)], "s string, t long, y double").createOrReplaceTempView("some_keys")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM densify_curve(TABLE(some_keys) PARTITION BY s ORDER BY t)").collect())
    assert got == [("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 6.0), ("a", 4, 8.0), ("b", 7, 1.0)]
    spark.createDataFrame([("a", 3, 0.9, 9), ("a", 5, 0.1, 9), ("a", 9, 0.0, 9)], "s string, frame long, confidence double, end long").createOrReplaceTempView("some_marks")
    got = [tuple(r) for r in spark.sql("SELECT * FROM split_segments(0.5D, TABLE(some_marks) PARTITION BY s ORDER BY frame)").collect()]
    assert sorted(got) == [("a", "shot-0001", 0, 3), ("a", "shot-0002", 3, 9)]


def test_patches_roll_back_alone(spark):
    """A patch whose test fails changes nothing, whatever it wrote before the test; later patches see the state before it."""
    ops = [("d", 1, "p1", "/a", "add", "1"), ("d", 2, "p2", "/a", "replace", "2"), ("d", 3, "p2", "/a", "test", "9"), ("d", 4, "p2", "/b", "add", "x"), ("d", 5, "p3", "/a", "test", "1"), ("d", 6, "p3", "/a", "replace", "3"), ("d", 7, "p4", "/b", "test", None), ("d", 8, "p4", "/a", "remove", None), ("e", 1, "p1", "/a", "add", "5")]
    got = {(r.doc_id, r.seq): (r.aborted, r.inverse_op, r.inverse_value) for r in I.patch_log(spark.createDataFrame(ops, "doc_id string, seq long, patch_id string, path string, op string, value string"), patch="patch_id").collect()}
    gone = (True, None, None)
    assert got == {("d", 1): (False, "remove", None), ("d", 2): gone, ("d", 3): gone, ("d", 4): gone, ("d", 5): (False, "test", "1"), ("d", 6): (False, "replace", "1"), ("d", 7): (False, "test", None), ("d", 8): (False, "add", "3"), ("e", 1): (False, "remove", None)}


def test_a_dense_run_of_detections_is_matched_in_no_time(spark):
    import time

    rng = np.random.default_rng(1)
    frames = rng.integers(0, 150_000, 200_000).tolist()
    began = time.process_time()
    got = K.nearest_free([(f, 40) for f in rng.integers(0, 150_000, 100_000).tolist()], frames)
    assert time.process_time() - began < 8 and len(got) == 100_000  # some 1 s; quadratic work would take hours
    for _ in range(200):
        wanted, found = [(int(f), int(t)) for f, t in zip(rng.integers(0, 30, 12), rng.integers(0, 9, 12), strict=True)], rng.integers(0, 30, 10).tolist()
        free, want = sorted(found), []
        for f, t in sorted(wanted):
            near = [x for x in free if abs(x - f) <= t]
            best = min(near, key=lambda x: (abs(x - f), x)) if near else None
            free = [x for i, x in enumerate(free) if i != free.index(best)] if best is not None else free
            want.append({"frame": f, "detected_frame": best})
        assert K.nearest_free(wanted, found) == want


def test_cues_of_fewer_frames_than_turns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1], 2), (2, [1.0, 1.0], [], 2)], "series_id long, weights array<double>, silences array<long>, frames long")
    assert {r.series_id: r.bounds for r in G.silence_cues(df).collect()} == {1: None, 2: [0, 1, 2]}


def test_scorecard_of_empty_sides(spark):
    totals = spark.createDataFrame([("a", 100)], "series_id string, total long")
    empty = {
        "truth": "series_id string, frame long, tolerance long, type string, splits boolean, label string", "detected": "series_id string, frame long, type string, confidence double", "short": "series_id string, start long, end long", "samples": "series_id string, frame long, kept boolean",
        "unresolved": "series_id string, start long, end long", "labels": "series_id string, label string", "observed": "series_id string, label string", "audio_truth": "series_id string, kind string", "audio": "series_id string, kind string, frame long",
    }
    parts = {k: spark.createDataFrame([], s) for k, s in empty.items()}
    r = K.full_scorecard(totals, **parts).first()
    assert (r.precision, r.recall, r.type_accuracy, r.short_recall, r.audio_coverage) == (1, 1, 1, 1, 1) and (r.mean_error, r.duplicate_reduction, r.unresolved_ratio, r.label_error, r.accent_error) == (0, 0, 0, 0, 0)
    marked = parts | {"truth": spark.createDataFrame([("a", 50, 2, "hard-cut", True, "x boundary")], empty["truth"])}
    r = K.full_scorecard(totals, **marked).first()
    assert (r.precision, r.recall, r.type_accuracy, r.accent_error) == (0, 0, 0, 100)


def test_a_path_may_pass_its_ends(spark):
    rows = [("a", i, x, 0.0, 1.0, 0.0) for i, x in enumerate([0.0, 0.5, 1.2, 1.0])] + [("b", i, x, 0.0, 1.0, 0.0) for i, x in enumerate([0.0, 0.5, 1.0])] + [("c", i, 1.0, 1.0, s, 0.0) for i, s in enumerate([1.0, 2.0, 1.5])]
    df = spark.createDataFrame(rows, "series_id string, seq long, x double, y double, s double, r double")
    got = {r.series_id: (r.by_scale, r.by_rotation, r.by_centre) for r in S.path_overshoot(df, "x", "y", "s", "r", 0.1, 0.1, 0.1).collect()}
    assert got == {"a": (False, False, True), "b": (False, False, False), "c": (True, False, False)}


def test_windows_of_short_series(spark):
    df = spark.createDataFrame([(n, i, float(i * i)) for n in (1, 2, 3, 6, 14) for i in range(n)], "series_id long, seq long, signal double")
    got = {(r.series_id, r.seq): r for r in G.local_polynomial(df, 1.0).collect()}
    assert all(got[n, i].smooth == pytest.approx(i * i, abs=1e-9) for n in (3, 6, 14) for i in range(n))
    assert got[14, 5].velocity == pytest.approx(10) and got[1, 0].velocity == 0
    odd = {(r.series_id, r.seq): r.f for r in G.local_polynomials(df, 1.0, {"f": "signal"}, odd=True).collect()}
    assert odd[14, 13].velocity == pytest.approx(26) and odd[6, 2].acceleration == pytest.approx(2)


def test_equal_rows_are_not_paired_but_dropped(spark):
    rng = np.random.default_rng(4)
    looks = [np.abs(rng.normal(size=64)) / 10 + 0.2 for _ in range(4)]
    looks += [x + 1e-4 * rng.normal(size=64) for x in looks]
    rows = [("s", i, looks[int(rng.integers(0, 8))].tolist(), bool(rng.random() < 0.15)) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, seq long, x array<double>, protected boolean")
    minima = {"pixel": 0.02, "histogram": 0.2, "hash": 20.0, "luminance": 0.01, "structure": 0.2, "edge": 0.01}
    pairs = {(r.seq, r.duplicate_of) for r in V.near_duplicates(df, minima).collect()}
    assert pairs == {(r.seq, r.duplicate_of) for r in V.near_duplicates(df, minima, chunk=7).collect()} and len(pairs) > 200
    kept, want = [], {}
    for _, i, _, safe in rows:
        first = next((k for k in kept if (i, k) in pairs), None)
        want[i] = (True, None) if safe or first is None else (False, first)
        kept += [i] if want[i][0] else []
    assert {r.seq: (r.kept, r.duplicate_of) for r in V.dedup(df, "protected", minima).collect()} == want
    for most in (0, 5, 500_000):
        assert {r.seq: (r.kept, r.duplicate_of) for r in V.greedy_dedup(df, V.near_duplicates(df, minima), "protected", fold_links=most).collect()} == want


def test_pairs_of_chunks_are_compared_in_tasks_of_their_own(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64)) / 200 + rng.normal(size=64) / 10 + 0.3
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(1, 900, None), (None, 901, x[0].tolist()), (2, 902, x[0].tolist())], "series_id long, seq long, x array<double>")
    minima = {"pixel": 0.0057, "histogram": 0.2, "hash": 9.0, "luminance": 0.001, "structure": 0.2, "edge": 0.01}
    found = V.near_duplicates(df, minima, chunk=50)
    assert found.rdd.getNumPartitions() > 1
    near = {(j, i) for i in range(400) for j in range(i + 1, 400) if np.abs(x[i] - x[j]).mean() < 0.0057 and abs(x[i].mean() - x[j].mean()) < 0.001}
    bits = [(v.reshape(8, 8)[:, 1:] > v.reshape(8, 8)[:, :-1]) for v in x]
    near = {(j, i) for j, i in near if (bits[i] != bits[j]).sum() < 9 and abs(np.abs(np.diff(x[i])).sum() - np.abs(np.diff(x[j])).sum()) / 64 < 0.01}
    got = [(r.seq, r.duplicate_of) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == near and len(got) > 50


def test_links_beyond_a_protected_partner_are_dropped_before_runs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    safe = {i for i in range(300) if i % 10 == 0}
    pairs = {(j, i) for j in range(300) for i in range(j) if rng.random() < 0.2}
    df = spark.createDataFrame([(1, i, i in safe) for i in range(300)], "series_id long, seq long, protected boolean")
    links, seen, runs = spark.createDataFrame([(1, j, i) for j, i in pairs], "series_id long, seq long, duplicate_of long"), [], V.linked_runs
    monkeypatch.setattr(V, "linked_runs", lambda found, *names: (seen.append(found.count()), runs(found, *names))[1])
    kept, want = [], {}
    for i in range(300):
        first = next((k for k in kept if (i, k) in pairs), None)
        want[i] = (True, None) if i in safe or first is None else (False, first)
        kept += [i] if want[i][0] else []
    for most in (50, 2_000_000):
        assert {r.seq: (r.kept, r.duplicate_of) for r in V.greedy_dedup(df, links, "protected", fold_links=most).collect()} == want
    assert all(n < len(pairs) / 2 for n in seen) and len(seen) == 2


@pytest.mark.parametrize(("share", "sizes"), [(0.0, {}), (0.1, {}), (0.1, {"chunk": 7}), (0.0, {"chunk": 50, "row_links": 3})])
def test_dedup_makes_few_links_a_row(spark, monkeypatch, share, sizes):
    rng = np.random.default_rng(9)
    x = 0.3 + rng.normal(size=64) / 50 + rng.normal(size=(4, 64))[rng.integers(0, 4, 400)] / 400 + rng.normal(size=(400, 64)) / 400
    rows = [(1, i, v.tolist(), bool(rng.random() < share)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id long, seq long, x array<double>, protected boolean")
    minima = {"pixel": 0.1, "histogram": 0.2, "hash": 60.0, "luminance": 0.0008, "structure": 1.0, "edge": 0.01}
    pairs = {(r.seq, r.duplicate_of) for r in V.near_duplicates(df, minima).collect()}
    kept, want, seen, settle = [], {}, [], V.greedy_dedup
    for _, i, _, safe in rows:
        first = next((k for k in kept if (i, k) in pairs), None)
        want[i] = (True, None) if safe or first is None else (False, first)
        kept += [i] if want[i][0] else []
    monkeypatch.setattr(V, "greedy_dedup", lambda df, links, *names: (seen.append(links.count()), settle(df, links, *names))[1])
    assert {r.seq: (r.kept, r.duplicate_of) for r in V.dedup(df, "protected", minima, **sizes).collect()} == want
    assert len(pairs) > 70 * len(rows) and max(seen) <= sizes.get("row_links", 64) * len(rows)
    assert len(seen) > 1 or not sizes.get("row_links")


def test_black_and_missing_rows_are_near_none(spark):
    looks = [[0.3 + i / 1000 for i in range(64)], [0.0] * 64, [float("nan")] + [0.3] * 63, [float("inf")] + [0.3] * 63, None]
    df = spark.createDataFrame([(1, i, looks[i % 5], False) for i in range(15)], "series_id long, seq long, x array<double>, protected boolean")
    got = {r.seq: (r.kept, r.duplicate_of) for r in V.dedup(df, "protected").collect()}
    assert got == {i: (False, 0) if i in (5, 10) else (True, None) for i in range(15)}


def test_runs_of_links_are_settled_apart(spark):
    rng = np.random.default_rng(11)
    pairs = sorted({(s, i, i - int(d)) for s in "ab" for i in range(4, 400) for d in rng.integers(1, 4, 2) if rng.random() < 0.4})
    safe = {(s, i) for s in "ab" for i in range(400) if rng.random() < 0.1}
    df = spark.createDataFrame([(s, i, (s, i) in safe) for s in "ab" for i in range(400)], "series_id string, seq long, protected boolean")
    links, want = spark.createDataFrame(pairs, "series_id string, seq long, duplicate_of long"), {}
    for s in "ab":
        for i in range(400):
            first = None if (s, i) in safe else next((p for t, j, p in pairs if (t, j) == (s, i) and want[s, p][0]), None)
            want[s, i] = (first is None, first)
    for most in (3, 10**6):
        got = V.greedy_dedup(df, links, "protected", fold_links=most)
        assert {(r.series_id, r.seq): (r.kept, r.duplicate_of) for r in got.collect()} == want
    runs = V.linked_runs(links, "series_id", "seq").collect()
    where = {(r.series_id, r.seq): r["__run"] for r in runs}
    assert len(set(where.values())) > 10 and all(where[r.series_id, r.duplicate_of] == r["__run"] for r in runs if (r.series_id, r.duplicate_of) in where)
    empty = V.greedy_dedup(df, links.where("false"), "protected").collect()
    assert len(empty) == 800 and all(r.kept for r in empty)


def test_manifests_of_any_depth(spark):
    files = [("g", i, f"text {i % 7}") for i in range(60)] + [("h", 1, None)]
    df = spark.createDataFrame(files, "source string, path long, content string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def tree(lines, length, digits):
        if length == digits:
            return sha("\n".join(sorted(line for _, line in lines)))
        parts = sorted({m[: length + 2] for m, _ in lines})
        return sha("\n".join(f"{p}:{tree([x for x in lines if x[0].startswith(p)], length + 2, digits)}" for p in parts))

    for digits in (2, 4):
        got = {r.source: r for r in E.manifest_of(df, "source", "path", "content", digits).collect()}
        for group in "gh":
            rows = [(p, c or "") for g, p, c in files if g == group]
            lines = [(hashlib.md5(str(p).encode()).hexdigest(), f"{p} {sha(c)} {len(c)}") for p, c in rows]
            assert got[group].tree_sha256 == tree(lines, 0, digits) and got[group].n_files == len(rows) and got[group].n_bytes == sum(len(c) for _, c in rows)
    assert E.manifest_of(df, "source", "path", "content").exceptAll(E.manifest_of(df, "source", "path", "content", 2)).count() == 0
    assert E.manifest_of(df.where("false"), "source", "path", "content").count() == 0


def test_bucket_widths_do_not_change_joins(spark):
    spans = spark.createDataFrame([("a", 0, 5), ("a", 3, 100_000), ("a", 99_990, 100_020), ("b", 7, 8)], "series_id string, start long, end long")
    other = spans.selectExpr("series_id", "start + 2 as start2", "end + 2 as end2")
    want = sorted((a.series_id, a.start, a.end, b.start2, b.end2) for a in spans.collect() for b in other.collect() if a.series_id == b.series_id and a.start < b.end2 and b.start2 < a.end)
    for width in (None, 7, 10**6):
        got = J.interval_overlap(spans, other, width=width).select("series_id", "start", "end", "start2", "end2")
        assert sorted(tuple(r) for r in got.collect()) == want
    for width in (7, 10**6):
        got = J.interval_overlap(spans, other, width=width, chunk=1)
        assert got.columns == J.interval_overlap(spans, other).columns and sorted((r.series_id, r.start, r.end, r.start2, r.end2) for r in got.collect()) == want
    points = spark.createDataFrame([("a", 4), ("a", 99_995), ("b", 8), ("c", 0)], "series_id string, seq long")
    dense = points.unionByName(points).unionByName(points)
    assert sorted(map(tuple, J.point_in_range(dense, spans, chunk=2).collect())) == sorted(map(tuple, J.point_in_range(dense, spans).collect()))
    assert {J.point_in_range(points, spans, width=w).count() for w in (None, 3, 64)} == {4}


def test_secrets_leave_nested_payloads(spark):
    rows = {
        '{"a": {"token": 1, "b": [{"secret_x": 2, "path": "p", "n": 1.5}]}}': '{"a":{"_redacted_field_count":1,"b":[{"_redacted_field_count":1,"n":1.5,"path":"<local-media>"}]}}',
        '["/abs", "rel", "x sk-proj-1", null, true, []]': '["<local-path>","rel","<redacted>",null,true,[]]',
        '{"_redacted_field_count": 7, "password": 1}': '{"_redacted_field_count":1}', '{"_redacted_field_count": 7}': '{"_redacted_field_count":7}',
        '{"file": 3, "My-File_Path": "x", "": "BEARER y"}': '{"":"<redacted>","My-File_Path":"<local-media>","file":3}', '"file://x"': '"<local-path>"', "12": "12", "null": "null", "{}": "{}", "not json": None, None: None,
        '{"a":{"a":{"a":{"a":{"token":1}}}}}': '{"a":{"a":{"a":{"a":"<too deep>"}}}}',
    }
    df = spark.createDataFrame([(k,) for k in rows], "p string")
    depth = {r.p: r.c for r in df.select("p", L.redact_json(F.col("p"), 4).alias("c")).collect()}
    assert depth == rows


def test_redaction_walks_a_text_once(spark):
    rows = {'{"b": "\\u000b\\u0001é\\ud83d\\ude00", "a": [1.50, 1e5, 123456789012345678901234567890, -0]}': '{"a":[1.5,100000.0,123456789012345678901234567890,0],"b":"\\u000B\\u0001é😀"}', '{"Z": 1, "é": 2, "token": 3}': '{"Z":1,"_redacted_field_count":1,"é":2}', '{"a": 1, "a": 2}': None, "[" * 300 + "]" * 300: "[" * 8 + '"<too deep>"' + "]" * 8}
    found = spark.createDataFrame([(k,) for k in rows], "p string").select("p", L.redact_json(F.col("p")).alias("c"))
    assert {r.p: r.c for r in found.collect()} == rows
    # nested lambdas over VARIANT have no generated code: 0.2 to 0.5 ms a text
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_runs_are_matched_some_at_a_time(spark, monkeypatch):
    truth = spark.createDataFrame([(s, 100 * k, 5) for s in range(40) for k in range(7)], "series_id long, frame long, tolerance long")
    found = spark.createDataFrame([(s, 100 * k + 3) for s in range(40) for k in range(7) if (s + k) % 3], "series_id long, frame long")
    rows = lambda: sorted((r.series_id, r.frame, r.detected_frame) for r in K.match_within_tolerance(truth.coalesce(1), found.coalesce(1)).collect())
    want = [(s, 100 * k, 100 * k + 3 if (s + k) % 3 else None) for s in range(40) for k in range(7)]
    for size in (1, 3, K.RUNS_AT_ONCE):
        monkeypatch.setattr(K, "RUNS_AT_ONCE", size)
        assert rows() == want
    none = K.match_within_tolerance(truth.where("false"), found)
    assert none.collect() == [] and none.columns == ["series_id", "frame", "detected_frame"]


def test_documents_are_walked_some_at_a_time(spark, monkeypatch):
    ops = [(d, n, str(n // 2), "p", op, v) for d in range(50) for n, (op, v) in enumerate([("add", "1"), ("test", "1"), ("replace", "2"), ("test", "2" if d % 3 else "x")])]
    df = spark.createDataFrame(ops, "doc_id long, seq long, patch_id string, path string, op string, value string").coalesce(1)
    for size in (1, 7, I.DOCUMENTS_AT_ONCE):
        monkeypatch.setattr(I, "DOCUMENTS_AT_ONCE", size)
        aborted = {(r.doc_id, r.seq) for r in I.patch_log(df, patch="patch_id").where("aborted").collect()}
        assert aborted == {(d, n) for d in range(0, 50, 3) for n in (2, 3)}


def test_motifs_are_counted_within_longer_words(spark):
    rng = np.random.default_rng(3)
    parts = ["there", "fore", "therefore", "house", "houses", "greenhouse", "aaaaaa", "aaaaaaaa", "a", "über", "überall", "THERE"]
    docs = [(g, k, " ".join(str(rng.choice(parts)) + (str(rng.choice(parts)) if rng.random() < 0.4 else "") for _ in range(6))) for g in range(5) for k in range(6)]
    docs += [(None, 0, "there there"), (None, 1, "there"), (0, None, "there"), (1, 0, docs[6][2])]
    df = spark.createDataFrame(docs, "g long, k long, text string")
    want = {}
    for g, k, text in docs:
        for _, _, other in [d for d in docs if d[0] == g and g is not None]:
            for term in other.lower().split():
                if len(term) >= 5 and k is not None and any(term in w for w in text.lower().split()):
                    want.setdefault((g, "recurring visual term: " + term), set()).add(k)
    found = T.recurring_motifs(df, df.select("g", F.lit("x").alias("kind")), "g", "k", first=10_000)
    assert {(r.g, r.motif): r.n for r in found.collect()} == {m: len(ks) for m, ks in want.items() if len(ks) >= 2}
    assert "startswith" not in found._jdf.queryExecution().optimizedPlan().toString().lower()  # no rest of a word is shuffled for every letter of it
