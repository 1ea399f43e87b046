"""Long series in blocks against windows over whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoform.operators import blocks as B
from chronoform.operators import grouped as G
from chronoform.operators import intervals as I
from chronoform.operators import quantiles as Q
from chronoform.operators import series as S


@pytest.fixture(scope="module")
def samples(spark):
    """A long series with gaps in its order, one of a few rows, one of a single row, and rows without a series."""
    rng = np.random.default_rng(5)
    parts = [("long", 3 * np.arange(900) + rng.integers(0, 3, 900)), ("short", np.arange(7)), ("one", np.arange(1)), (None, np.arange(150))]
    rows = [(s, int(o), float(v), float(e)) for s, order in parts for o, v, e in zip(order, np.round(rng.random(len(order)), 3), rng.random(len(order)), strict=True)]
    return spark.createDataFrame(rows, "series_id string, seq long, signal double, edge double").cache()


def same(got, want, *keys):
    a, b = (x.toPandas().sort_values(list(keys or ["series_id", "seq"])).reset_index(drop=True) for x in (got, want))
    assert sorted(a.columns) == sorted(b.columns)
    pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False, rtol=1e-9, atol=1e-9)


OPERATORS = {
    "deltas": lambda d, n: S.adjacent_deltas(d.withColumn("x", F.array("signal", "edge", "signal", "edge")), width=2, block_rows=n),
    "peaks": lambda d, n: S.local_peaks(d, d.select("series_id", F.lit(0.5).alias("threshold")).distinct(), block_rows=n),
    "impulses": lambda d, n: S.isolated_impulses(d, peak=0.6, share=0.9, block_rows=n),
    "derivatives": lambda d, n: S.finite_derivatives(d, 25.0, block_rows=n),
    "polynomials": lambda d, n: G.local_polynomial(d, 25.0, 7, 2, block_rows=n).drop(B.BLOCK),
    "hampel": lambda d, n: S.hampel(d, sigma=1.0, block_rows=n),
    "numbers": lambda d, n: B.numbered(d, "series_id", "seq", block_rows=n).drop(B.BLOCK),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("rows", [30])
def test_blocks_give_what_windows_give(samples, name, rows):
    same(OPERATORS[name](samples, rows), OPERATORS[name](samples, None))


@pytest.mark.parametrize("rows", [5])
def test_runs_and_ranges_cross_block_borders(spark, samples, rows):
    """Runs of thousands of rows, ranges that reach over many blocks, and gaps between them."""
    on = samples.withColumn("on", (F.col("seq") < 700) | (F.col("signal") > 0.9))
    for f in (lambda n: S.level_intervals(on, F.col("on"), 1, block_rows=n), lambda n: S.sustained_runs(on.withColumn("signal", F.col("on").cast("double")), block_rows=n)):
        same(f(rows), f(None), "series_id", "start")
    spans = samples.select("series_id", F.col("seq").alias("start"), (F.col("seq") + F.when(F.col("signal") > 0.97, 300).otherwise(F.floor(F.col("edge") * 4))).alias("end"))
    same(I.merge_ranges(spans, block_rows=rows), I.merge_ranges(spans), "series_id", "start")
    totals = spans.groupBy("series_id").agg((F.max("end") + 5).alias("total")).where("series_id is not null")
    known = spans.where("series_id is not null")
    same(I.gaps(known, totals, block_rows=rows), I.gaps(known, totals), "series_id", "start")
    same(I.pack_timeline(spans.withColumn("seq", F.col("start")), 0.4, block_rows=rows), I.pack_timeline(spans.withColumn("seq", F.col("start")), 0.4), "series_id", "start")
    peaks = samples.where("signal > 0.5")
    same(S.group_candidates(peaks, peaks.where("edge > 0.9"), block_rows=rows), S.group_candidates(peaks, peaks.where("edge > 0.9")), "series_id", "start", "end")
    ends = samples.groupBy("series_id").agg(F.lit(-1).cast("long").alias("start"), (F.max("seq") + 1).alias("end"))
    marks = peaks.select("series_id", F.col("seq").alias("frame"), F.col("signal").alias("confidence"))
    same(S.segment(ends, marks, block_rows=rows), S.segment(ends, marks), "series_id", "start")


def test_running_values(samples):
    values = {"total": ("sum", F.col("signal"), True), "top": ("max", F.col("edge"), False), "known": ("last", F.when(F.col("signal") > 0.995, F.col("edge")), False)}
    same(B.scan(samples, values, "series_id", "seq", block_rows=50).drop(B.BLOCK), B.scan(samples, values, "series_id", "seq"))


def test_a_series_of_two_million_rows_is_many_tasks(spark):
    n = 2_000_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(n).select(F.lit(1).alias("series_id"), F.col("id").alias("seq"), F.sin(F.col("id") / 1000).alias("signal"))
        found = S.finite_derivatives(rows, 1.0, block_rows=100_000)
        keys = [w for w in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in w]
        assert all("__even" in w or "__block" in w for w in keys) and keys
        got = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("velocity") - F.cos(F.col("seq") / 1000) / 1000)).alias("off")).collect()
        assert sum(r.n for r in got) == n and len(got) >= 8 and max(r.n for r in got) < n / 3 and max(r.off for r in got) < 1e-6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_an_empty_table_and_windows_wider_than_a_block(spark, samples):
    none = samples.where("false")
    assert S.finite_derivatives(none, 1.0, block_rows=10).count() == 0 and I.merge_ranges(none.select("series_id", F.col("seq").alias("start"), F.col("seq").alias("end")), block_rows=5).count() == 0
    with pytest.raises(ValueError, match="fewer rows"):
        S.finite_derivatives(samples, 1.0, block_rows=3)


def test_clamped_steps_compose(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for series, n in (("a", 3000), ("b", 5), ("c", 1)):
        x = y = 0.5
        scale, places = 1.0, {round(i * (n - 1) / 4) for i in range(5)}
        for i in range(n):
            dx, dy, f = float(rng.normal(0, 0.2)), float(rng.normal(0.01, 0.1)), float(0 if i == 1500 else rng.uniform(0.6, 1.6))
            rows.append((series, i * 2, dx, dy, f))
            x, y, scale = min(1.0, max(0.0, x + dx)), min(1.0, max(0.0, y + dy)), min(4.0, max(0.25, scale * f))
            if i in places:
                want[series, i] = (x, y, scale)
    df = spark.createDataFrame(rows, "series_id string, seq long, dx double, dy double, f double")
    for part, block in ((64, None), (1024, 500)):
        got = {(r.series_id, r.n): (r.x, r.y, r.scale) for r in G.integrate_transform(df, "dx", "dy", "f", part_rows=part, block_rows=block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in want)


def test_quantiles_of_hot_series(spark):
    rng = np.random.default_rng(9)
    wild = np.concatenate([rng.normal(0, 1, 400) * 10.0 ** rng.integers(-300, 300, 400), [0.0, -0.0, np.inf, -np.inf, 5e-324, 1.7e308]])
    groups = {"wild": wild, "equal": np.full(500, 2.5), "two": np.repeat([1.0, np.nextafter(1.0, 2)], 150), "few": rng.random(5), "normal": np.round(rng.normal(0, 1, 1001), 2), "ints": rng.integers(0, 9, 600).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), ("none", None)], "series_id string, x double")
    names = {"lowest": 0.0, "a": 0.1, "mid": 0.5, "b": 0.95, "top": 1.0}
    got = {r.series_id: r for r in Q.exact_quantiles(df, "x", names, "series_id", hot_rows=100).collect()}
    want = {r.series_id: r for r in Q.exact_quantiles(df, "x", names, "series_id").collect()}
    assert got.keys() == want.keys()
    for k in want:
        for c in names:
            assert got[k][c] == want[k][c] or np.isclose(got[k][c], want[k][c], rtol=1e-12), (k, c)


def test_a_threshold_of_a_hot_series(spark, samples):
    known = samples.where("series_id is not null")
    same(S.robust_threshold(known, k=1.0, hot_rows=100), S.robust_threshold(known, k=1.0), "series_id")


def test_a_hot_series_of_ten_million_rows(spark):
    df = spark.range(10_000_000).select(F.lit(1).alias("series_id"), F.pmod(F.col("id") * 7_368_787, F.lit(10_000_000)).cast("double").alias("x"))
    got = Q.exact_quantiles(df, "x", {"mid": 0.5, "q": 0.9}, "series_id", hot_rows=1_000_000).first()
    assert (got.mid, got.q) == (4_999_999.5, 8_999_999.1)


def test_blocks_of_long_polynomials_are_dealt_once(spark, monkeypatch):
    from chronoform.plans import long_queries as Q

    df = spark.createDataFrame([(s, i, float(i * i % 11)) for s in "ab" for i in range(200)], "series_id string, seq long, signal double")
    dealt, deal = [], B.deal

    def counted(rows, *a):
        dealt.append(B.BLOCK in rows.columns)
        return deal(rows, *a)

    monkeypatch.setattr(B, "deal", counted)
    monkeypatch.setattr(Q, "BLOCK_ROWS", 30)
    monkeypatch.setattr(Q, "long", lambda *_: df)
    found = {(r.series_id, r.seq): r.smooth for r in Q.c15_long_polynomials(spark, "").collect()}
    weights = G.polynomial_weights(7, 2)[3][0]
    assert found.keys() == {(s, i) for s in "ab" for i in range(3, 197)}
    assert all(abs(v - sum(w * ((i + k - 3) ** 2 % 11) for k, w in enumerate(weights))) < 2e-6 for (_, i), v in found.items())
    assert dealt.count(False) == 1
