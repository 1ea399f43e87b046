"""Queries of the scalar and series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoform.functions import scalar
from chronoform.operators import series as S

from .fixtures import EMB, EV, FEAT, HOURLY, ev, feat, hourly, table, vectors
from .registry import r6, registered, rounded

W = "WINDOW w AS (PARTITION BY series_id ORDER BY seq)"
THR = """rows1 AS (SELECT * FROM (SELECT series_id, {x} AS x, lag(seq) OVER (PARTITION BY series_id ORDER BY seq) AS b FROM {t}) WHERE b IS NOT NULL),
mid AS (SELECT series_id, median(x) AS median FROM rows1 GROUP BY series_id),
thr AS (SELECT series_id, mid.median, median(abs(x - mid.median)) AS mad FROM rows1 JOIN mid USING (series_id) GROUP BY ALL),
thresholds AS (SELECT *, {clamp} AS threshold FROM thr)"""
DENSE = THR.format(x="combined", t="feat", clamp="greatest(0.16, least(0.65, median + greatest(0.08, 6.0 * mad)))")
LOOSE = THR.format(x="combined", t="feat", clamp="median + greatest(0.08, 1.0 * mad)")


@registered(f"WITH {FEAT} SELECT series_id, seq, round(combined, 6) AS combined FROM feat")
def b1_combined_change(spark: SparkSession, d: str) -> DataFrame:
    return feat(spark, d).select("series_id", "seq", r6("combined").alias("combined"))


@registered(f"""WITH {EMB}, p AS (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY seq) AS y FROM emb),
q AS (SELECT *, list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])) AS diff FROM p)
SELECT series_id, seq, round(CASE WHEN y IS NULL THEN 0 ELSE list_avg(diff) END, 6) AS pixel_change, round(CASE WHEN y IS NULL THEN 0 ELSE abs(list_avg(x) - list_avg(y)) END, 6) AS luminance_change,
 round(CASE WHEN y IS NULL THEN 0 ELSE least(1.0, 4 * abs(list_avg(list_filter(diff, lambda v, i: (i - 1) % 8 < 4)) - list_avg(list_filter(diff, lambda v, i: (i - 1) % 8 >= 4)))) END, 6) AS asymmetry FROM q""")
def b2_adjacent_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.adjacent_deltas(vectors(spark, d)).drop("edge_change"))


PAIRS = f"{EMB}, pairs AS (SELECT series_id, seq, x, lag(x) OVER (PARTITION BY series_id ORDER BY seq) AS y FROM emb QUALIFY y IS NOT NULL)"


def vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).withColumn("y", F.lag("x").over(S.along())).where("y is not null")


@registered(f"""WITH {PAIRS}, h AS (SELECT series_id, seq, list_transform(x, lambda v: abs(v)) AS x, list_transform(y, lambda v: abs(v)) AS y FROM pairs)
SELECT series_id, seq, round(sqrt(greatest(0, least(1, 1 - list_sum(list_transform(list_zip(x, y), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(x) * list_sum(y))))), 6) AS distance FROM h""")
def b3_bhattacharyya(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.transform(c, F.abs)
    return vector_pairs(spark, d).select("series_id", "seq", r6(scalar.bhattacharyya(size(F.col("x")), size(F.col("y")))).alias("distance"))


@registered(f"""WITH {EV}, c AS (SELECT series_id, kind, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT series_id, kind, n, sum(n) OVER (PARTITION BY series_id) AS total FROM c)
SELECT series_id, round(-sum(n / total * log2(n / total)), 6) AS entropy, CAST(any_value(total) AS BIGINT) AS n FROM t GROUP BY series_id""")
def b4_entropy(spark: SparkSession, d: str) -> DataFrame:
    counts = ev(spark, d).groupBy("series_id", "kind").count().groupBy("series_id").agg(F.collect_list("count").alias("c"))
    return counts.select("series_id", r6(scalar.entropy(F.col("c"))).alias("entropy"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@registered("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.55) AS t55, quantile_cont(l_extendedprice, 0.78) AS t78 FROM lineitem GROUP BY l_returnflag)
SELECT l.l_returnflag AS series_id, round(any_value(t55), 6) AS midground, round(any_value(t78), 6) AS foreground, round(avg(CASE WHEN l_extendedprice >= t55 THEN 1.0 ELSE 0 END), 6) AS midground_share,
 round(avg(CASE WHEN l_extendedprice >= t78 THEN 1.0 ELSE 0 END), 6) AS foreground_share FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag GROUP BY 1""")
def b5_quantile_mask(spark: SparkSession, d: str) -> DataFrame:
    from chronoform.operators.vectors import quantile_mask

    return rounded(quantile_mask(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "series_id"), "l_extendedprice", {"midground": 0.55, "foreground": 0.78}))


@registered(f"WITH {EV} SELECT series_id, seq, round(CASE WHEN max(signal) OVER p > min(signal) OVER p THEN (signal - min(signal) OVER p) / (max(signal) OVER p - min(signal) OVER p) ELSE 0 END, 6) AS normalized FROM ev WINDOW p AS (PARTITION BY series_id)")
def b6_minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.minmax_normalize(ev(spark, d)).select("series_id", "seq", "normalized"))


@registered(f"""WITH {PAIRS}, b AS (SELECT series_id, seq, list_transform(generate_series(0, 55), lambda i: CAST(x[(i // 7) * 8 + i % 7 + 2] > x[(i // 7) * 8 + i % 7 + 1] AS INT)) AS a,
 list_transform(generate_series(0, 55), lambda i: CAST(y[(i // 7) * 8 + i % 7 + 2] > y[(i // 7) * 8 + i % 7 + 1] AS INT)) AS c FROM pairs)
SELECT series_id, seq, array_to_string(a, '') AS bits, CAST(list_sum(list_transform(list_zip(a, c), lambda z: CAST(z[1] <> z[2] AS INT))) AS INT) AS distance FROM b""")
def b8_dhash_hamming(spark: SparkSession, d: str) -> DataFrame:
    bits = vector_pairs(spark, d).withColumns({"a": scalar.dhash_bits("x", 8, 8), "b": scalar.dhash_bits("y", 8, 8)})
    return bits.select("series_id", "seq", F.array_join(F.transform("a", lambda x: x.cast("string")), "").alias("bits"), scalar.hamming("a", "b").alias("distance"))


@registered(f"""WITH {PAIRS}, m AS (SELECT series_id, seq, x, y, list_avg(x) AS ma, list_avg(y) AS mb FROM pairs),
v AS (SELECT *, list_avg(list_transform(x, lambda v: (v - ma) * (v - ma))) AS va, list_avg(list_transform(y, lambda v: (v - mb) * (v - mb))) AS vb, list_avg(list_transform(list_zip(x, y), lambda z: (z[1] - ma) * (z[2] - mb))) AS cov FROM m),
s AS (SELECT *, (2 * ma * mb + 0.0001) * (2 * cov + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009)) AS ssim FROM v)
SELECT series_id, seq, round(ssim, 6) AS ssim, round(greatest(0, least(1, 1 - ssim)), 6) AS change FROM s""")
def b9_global_ssim(spark: SparkSession, d: str) -> DataFrame:
    pairs = vector_pairs(spark, d).withColumn("ssim", scalar.global_ssim("x", "y", span=1.0))
    return rounded(pairs.select("series_id", "seq", "ssim", scalar.clamp(1 - F.col("ssim"), 0.0, 1.0).alias("change")))


@registered(f"""WITH {EV}, m AS (SELECT series_id, seq, t_seconds AS mapped FROM ev WHERE seq % 3 = 0)
SELECT ev.series_id, ev.seq, round(coalesce(m.mapped, ev.seq * 1001 / 30000.0), 6) AS seconds FROM ev LEFT JOIN m USING (series_id, seq)""")
def b10_frame_time(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    mapped = e.where("seq % 3 = 0").select("series_id", "seq", F.col("t_seconds").alias("mapped"))
    return e.join(mapped, ["series_id", "seq"], "left").select("series_id", "seq", r6(scalar.frame_time("seq", F.lit(30000), F.lit(1001), "mapped")).alias("seconds"))


ANGLES = f"{EV}, ang AS (SELECT series_id, seq, value % 360 - 180 AS a FROM ev), st AS (SELECT *, a - lag(a) OVER (PARTITION BY series_id ORDER BY seq) AS s FROM ang)"


@registered(f"""WITH {ANGLES}, t AS (SELECT *, coalesce(((s + 180) % 360 + 360) % 360 - 180, 0) AS turn FROM st)
SELECT series_id, seq, round(first_value(a) OVER w + sum(turn) OVER w, 6) AS unwrapped FROM t {W}""")
def b17_unwrap_degrees(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.unwrap_degrees(ev(spark, d).select("series_id", "seq", (F.col("value") % 360 - 180).alias("signal"))).select("series_id", "seq", "unwrapped"))


@registered(f"WITH {ANGLES} SELECT series_id, round(degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))), 6) AS mean FROM ang GROUP BY series_id")
def b17_circular_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.circular_mean(ev(spark, d).select("series_id", (F.col("value") % 360 - 180).alias("a")), "a"))


EASE = {
    "hold": "0.0",
    "linear": "p",
    "ease_in": "p * p",
    "ease_out": "1 - (1 - p) * (1 - p)",
    "ease_in_out": "3 * p * p - 2 * p * p * p",
    "hermite": "(p * p * p - 2 * p * p + p) * 0.68 + (-2 * p * p * p + 3 * p * p) + (p * p * p - p * p) * 0.12",
    "overshoot": "1 + 2.70158 * pow(p - 1, 3) + 1.70158 * pow(p - 1, 2)",
    "settle": "(1 - exp(-6.0 * p) * (cos(3 * pi() * p) + 0.2 * sin(3 * pi() * p))) / (1 - exp(-6.0) * (cos(3 * pi()) + 0.2 * sin(3 * pi())))",
}


@registered(f"WITH {EV}, e AS (SELECT series_id, seq, signal * 1.2 - 0.1 AS q, greatest(0, least(1, signal * 1.2 - 0.1)) AS p FROM ev) SELECT series_id, seq, {', '.join(f'round({x}, 6) AS {n}' for n, x in EASE.items())} FROM e")
def b18_easing(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("signal") * 1.2 - 0.1
    return rounded(ev(spark, d).select("series_id", "seq", *[scalar.easing(n, p).alias(n) for n in EASE]))


def bezier_sql() -> str:
    x, slope = "3 * pow(1 - t, 2) * t * 0.18 + 3 * (1 - t) * t * t * 0.38 + t * t * t", "3 * pow(1 - t, 2) * 0.18 + 6 * (1 - t) * t * 0.2 + 3 * t * t * 0.62"
    steps = [f"n{i + 1} AS (SELECT series_id, seq, p, greatest(0, least(1, t - ({x} - p) / CASE WHEN abs({slope}) < 1e-9 THEN 1 ELSE {slope} END)) AS t FROM n{i})" for i in range(8)]
    return f"WITH {EV}, n0 AS (SELECT series_id, seq, greatest(0, least(1, signal * 0.983)) AS p, greatest(0, least(1, signal * 0.983)) AS t FROM ev), {', '.join(steps)} SELECT series_id, seq, round(3 * pow(1 - t, 2) * t * 0.82 + 3 * (1 - t) * t * t + t * t * t, 6) AS eased FROM n8"


@registered(bezier_sql())
def b18_bezier_easing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev(spark, d).select("series_id", "seq", scalar.bezier_easing(0.18, 0.82, 0.38, 1.0)(F.col("signal") * 0.983).alias("eased")))


@registered("""WITH m AS (SELECT p_partkey, 1 + p_size / 100.0 AS a, p_size / 500.0 AS b, p_partkey % 7 * 3.0 AS tx, -p_size / 400.0 AS c, 0.9 + p_partkey % 11 / 50.0 AS e, p_partkey % 5 * 2.0 AS ty, p_partkey % 3 / 100000.0 AS g, p_size / 1000000.0 AS h FROM part),
n AS (SELECT *, a * 320 + b * 180 + tx AS nx, c * 320 + e * 180 + ty AS ny, g * 320 + h * 180 + 1 AS d FROM m),
j AS (SELECT *, (a * d - nx * g) / (d * d) AS j11, (b * d - nx * h) / (d * d) AS j12, (c * d - ny * g) / (d * d) AS j21, (e * d - ny * h) / (d * d) AS j22 FROM n),
s AS (SELECT *, sqrt(pow(j11 + j22, 2) + pow(j21 - j12, 2)) / 2 AS q, sqrt(pow(j11 - j22, 2) + pow(j21 + j12, 2)) / 2 AS r FROM j)
SELECT p_partkey, round(nx / d / 1280, 6) AS center_x, round(ny / d / 720, 6) AS center_y, round(sqrt(abs(j11 * j22 - j12 * j21)) / 2, 6) AS scale, round(degrees(atan2(j21 - j12, j11 + j22)), 6) AS rotation,
 round(abs((q + r) - abs(q - r)) / (((q + r) + abs(q - r)) / 2), 6) AS anisotropy, round(abs(j11 * j12 + j21 * j22) / (sqrt(j11 * j11 + j21 * j21) * sqrt(j12 * j12 + j22 * j22)), 6) AS shear, round(sqrt(pow(g * 640, 2) + pow(h * 360, 2)), 6) AS perspective FROM s""")
def b19_matrix_parameters(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    m = F.array(1 + s / 100.0, s / 500.0, k % 7 * 3.0, -s / 400.0, 0.9 + k % 11 / 50.0, k % 5 * 2.0, k % 3 / 100000.0, s / 1000000.0, F.lit(1.0))
    found = table(spark, d, "part").select("p_partkey", scalar.matrix_parameters(m, F.lit(640), F.lit(360), F.lit(1280), F.lit(720)).alias("x"))
    return rounded(found.select("p_partkey", "x.*"))


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, round(greatest(0, least(1, 0.42 * l_discount * 10 + 0.28 * least(1, l_quantity / 120) + 0.30 * exp(-l_tax * 20 / 2.5))), 6) AS confidence FROM lineitem")
def b20_recovery_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = scalar.recovery_confidence(F.col("l_discount") * 10, "l_quantity", F.col("l_tax") * 20)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", r6(c).alias("confidence"))


@registered("""WITH m AS (SELECT *, l_tax * 40 AS rmse, l_discount * 20 AS med, l_quantity / 50 AS inl, l_discount / 5 AS persp, l_tax * 2 AS pg, l_discount / 3 AS an, l_tax / 2 AS sh, l_discount AS ag FROM lineitem)
SELECT CASE WHEN rmse > 2.35 OR med > 1.75 OR inl < 0.38 THEN 'unknown' WHEN persp >= 0.012 AND pg >= 0.08 THEN 'homography' WHEN (an >= 0.025 OR sh >= 0.025) AND ag >= 0.08 THEN 'affine'
 WHEN rmse > 2.35 OR inl < 0.38 THEN 'unknown' ELSE 'similarity' END AS model, count(*) AS n FROM m GROUP BY 1""")
def b21_select_model(spark: SparkSession, d: str) -> DataFrame:
    x, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    model = scalar.select_model(t * 40, x * 20, q / 50, x / 5, t * 2, x / 3, t / 2, x, t * 40, q / 50)
    return table(spark, d, "lineitem").groupBy(model.alias("model")).agg(F.count("*").alias("n"))


@registered(f"WITH {FEAT}, {DENSE} SELECT series_id, round(median, 6) AS median, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM thresholds")
def c1_robust_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.robust_threshold(feat(spark, d), "combined"))


PEAKS = f"""{FEAT}, {LOOSE}, nb AS (SELECT *, lag(combined) OVER w AS p, coalesce(lead(combined) OVER w, 0) AS n FROM feat {W}),
peaks AS (SELECT nb.*, threshold FROM nb JOIN thresholds USING (series_id) WHERE (p IS NOT NULL AND combined >= threshold AND combined >= p AND combined >= n) OR (kind = 'error' AND seq % 10 = 0))"""


def peaks(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d)
    return S.local_peaks(f, S.robust_threshold(f, "combined", 1.0, 0.08, None, None), "combined", f.where("kind = 'error' and seq % 10 = 0"))


@registered(f"WITH {PEAKS} SELECT series_id, seq, round(combined, 6) AS combined, round(threshold, 6) AS threshold FROM peaks")
def c2_local_peaks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(peaks(spark, d).select("series_id", "seq", "combined", "threshold"))


@registered(f"""WITH {FEAT}, r AS (SELECT *, sum(CASE WHEN combined >= 0.2 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM feat)
SELECT series_id, min(seq) AS "start", max(seq) + 1 AS "end", count(*) AS n, round(sum(combined), 6) AS total FROM r WHERE combined >= 0.2 GROUP BY series_id, g HAVING count(*) >= 4 AND sum(combined) >= 0.25""")
def c3_sustained_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.sustained_runs(feat(spark, d), "combined", threshold=0.2))


ISOLATED = f"""iso AS (SELECT *, greatest(coalesce(lag(combined) OVER w, 0), coalesce(lead(combined) OVER w, 0)) AS beside, lag(combined) OVER w IS NULL AS f FROM feat {W}),
isolated AS (SELECT * FROM iso WHERE NOT f AND combined >= 0.35 AND beside <= greatest(0.12, 0.55 * combined))"""


@registered(f"WITH {FEAT}, {ISOLATED} SELECT series_id, seq, round(combined, 6) AS combined, round(beside, 6) AS beside FROM isolated")
def c4_isolated_impulses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.isolated_impulses(feat(spark, d), "combined").select("series_id", "seq", "combined", "beside"))


GROUPS = f"""{PEAKS}, {ISOLATED}, rest AS (SELECT series_id, seq FROM peaks WHERE (series_id, seq) NOT IN (SELECT (series_id, seq) FROM isolated)),
isl AS (SELECT *, seq - row_number() OVER (PARTITION BY series_id ORDER BY seq) AS g FROM rest),
grouped AS (SELECT series_id, min(seq) AS "start", max(seq) + 1 AS "end", count(*) AS n FROM isl GROUP BY series_id, g UNION ALL SELECT series_id, seq, seq + 1, 1 FROM isolated)"""


@registered(f'WITH {GROUPS} SELECT series_id, "start", "end", n FROM grouped')
def c5_group_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.group_candidates(peaks(spark, d), S.isolated_impulses(feat(spark, d), "combined"))


SPARSE = f"""{EV}, base AS (SELECT * FROM ev WHERE seq % 3 = 0), sp AS (SELECT *, abs(signal - lag(signal) OVER w) AS ds, abs(edge - lag(edge) OVER w) AS hist, lag(seq) OVER w AS before FROM base {W}),
feat AS (SELECT *, coalesce(0.6 * ds + 0.4 * hist, 0) AS combined FROM sp)"""


def sparse(spark: SparkSession, d: str) -> DataFrame:
    w = S.along()
    rows = ev(spark, d).where("seq % 3 = 0")
    rows = rows.withColumns({"ds": F.abs(F.col("signal") - F.lag("signal").over(w)), "hist": F.abs(F.col("edge") - F.lag("edge").over(w))})
    return rows.withColumn("combined", F.coalesce(0.6 * F.col("ds") + 0.4 * F.col("hist"), F.lit(0.0)))


@registered(f"""WITH {SPARSE}, {THR.format(x="combined", t="feat", clamp="greatest(0.2, least(0.72, median + greatest(0.10, 1.0 * mad)))")}
SELECT series_id, greatest(before + 1, least(seq, CAST(round_even((before + seq) / 2.0, 0) AS BIGINT))) AS frame, 'unknown' AS type, round(least(0.5, greatest(0.3, combined)), 6) AS confidence
FROM feat JOIN thresholds USING (series_id) WHERE before IS NOT NULL AND combined >= threshold AND hist >= 0.12""")
def c7_sparse_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = sparse(spark, d)
    return rounded(S.sparse_transitions(rows, S.robust_threshold(rows, "combined", 1.0, 0.10, 0.2, 0.72)))


SEGMENTS = f"""{PEAKS}, bounds AS (SELECT series_id, CAST(0 AS BIGINT) AS "start", max(seq) + 1 AS "end" FROM ev GROUP BY series_id),
marks AS (SELECT DISTINCT * FROM (SELECT p.series_id, seq AS frame FROM peaks p JOIN bounds b ON p.series_id = b.series_id WHERE combined >= 0.55 AND seq > b."start" AND seq < b."end" UNION ALL SELECT series_id, "start" FROM bounds UNION ALL SELECT series_id, "end" FROM bounds)),
segments AS (SELECT series_id, format('shot-{{:04d}}', row_number() OVER m) AS segment_id, frame AS "start", lead(frame) OVER m AS "end" FROM marks WINDOW m AS (PARTITION BY series_id ORDER BY frame) QUALIFY "end" IS NOT NULL)"""


def bounds(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).groupBy("series_id").agg(F.lit(0).cast("long").alias("start"), (F.max("seq") + 1).alias("end"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return S.segment(bounds(spark, d), peaks(spark, d).select("series_id", F.col("seq").alias("frame"), F.col("combined").alias("confidence")))


@registered(f'WITH {SEGMENTS} SELECT s.series_id, s.segment_id, s."start", s."end", count(*) AS n, round(avg(signal), 6) AS mean FROM segments s JOIN ev e ON s.series_id = e.series_id AND e.seq >= s."start" AND e.seq < s."end" GROUP BY ALL')
def c8_segment(spark: SparkSession, d: str) -> DataFrame:
    from chronoform.operators.joins import point_in_range

    joined = point_in_range(ev(spark, d).select("series_id", "seq", "signal"), segments(spark, d))
    return joined.groupBy("series_id", "segment_id", "start", "end").agg(F.count("*").alias("n"), r6(F.avg("signal")).alias("mean"))


RUNS = """r AS (SELECT *, sum(CASE WHEN {c} THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM {t})
SELECT series_id, min(seq) AS "start", max(seq) + 1 AS "end" FROM r WHERE {c} GROUP BY series_id, g HAVING count(*) >= {n}"""


@registered(f"WITH {HOURLY}, " + RUNS.format(c="level < 0.35", t="hourly", n=2))
def c9_silence_intervals(spark: SparkSession, d: str) -> DataFrame:
    return S.level_intervals(hourly(spark, d), F.col("level") < 0.35, 2)


@registered(f"WITH {HOURLY}, r AS (SELECT *, sum(CASE WHEN level <= 0.05 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM hourly), i AS (SELECT series_id, count(*) AS len FROM r WHERE level <= 0.05 GROUP BY series_id, g) SELECT s.series_id, count(len) AS n_black, CASE WHEN count(len) > 0 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT DISTINCT series_id FROM hourly) s LEFT JOIN i ON s.series_id = i.series_id GROUP BY s.series_id")
def c10_black_intervals(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d)
    found = S.level_intervals(h, F.col("level") <= 0.05, 1)
    out = h.select("series_id").distinct().join(found.groupBy("series_id").count(), "series_id", "left").select("series_id", F.coalesce("count", F.lit(0)).alias("n_black"))
    return out.withColumn("status", F.when(F.col("n_black") > 0, "warn").otherwise("pass"))


@registered(f'WITH {EV} SELECT series_id, CAST(seq // 4 AS BIGINT) AS "window", round(sqrt(avg(signal * signal)), 6) AS rms FROM ev GROUP BY 1, 2 HAVING count(*) = 4')
def c11_rms_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.rms_windows(ev(spark, d), 4))


@registered(f"""WITH {EV}, on1 AS (SELECT series_id, seq * 0.5 + edge * 0.01 AS t_seconds, 0.7 + signal * 0.3 AS strength FROM ev WHERE series_id % 2 = 0 UNION ALL SELECT series_id, t_seconds, signal FROM ev WHERE series_id % 2 = 1),
s AS (SELECT *, t_seconds - lag(t_seconds) OVER (PARTITION BY series_id ORDER BY t_seconds) AS gap FROM on1 WHERE strength >= 0.65), m AS (SELECT series_id, median(gap) AS med, count(*) AS n, min(t_seconds) AS a, max(t_seconds) AS b FROM s GROUP BY series_id),
k AS (SELECT s.series_id, median(abs(gap - med)) AS mad FROM s JOIN m USING (series_id) GROUP BY s.series_id), ok AS (SELECT * FROM m JOIN k USING (series_id) WHERE n >= 3 AND med BETWEEN 0.2 AND 2.0 AND mad / med <= 0.15)
SELECT series_id, 'music' AS kind, round(a, 6) AS "start", round(b, 6) AS "end" FROM ok UNION ALL SELECT s.series_id, 'beat', round(t_seconds, 6), round(t_seconds, 6) FROM s JOIN ok USING (series_id)""")
def c13_periodic_rhythm(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    even = e.where("series_id % 2 = 0").select("series_id", (F.col("seq") * 0.5 + F.col("edge") * 0.01).alias("t_seconds"), (0.7 + F.col("signal") * 0.3).alias("strength"))
    return rounded(S.periodic_rhythm(even.unionByName(e.where("series_id % 2 = 1").select("series_id", "t_seconds", F.col("signal").alias("strength")))))


def grad(x: str, rate: str) -> str:
    lag, lead = (lambda n: f"lag({x}, {n}) OVER w"), (lambda n: f"lead({x}, {n}) OVER w")
    return f"""CASE WHEN {lag(1)} IS NULL AND {lead(1)} IS NULL THEN 0 WHEN {lag(1)} IS NULL THEN CASE WHEN {lead(2)} IS NOT NULL THEN (-3 * {x} + 4 * {lead(1)} - {lead(2)}) / 2 ELSE {lead(1)} - {x} END
 WHEN {lead(1)} IS NULL THEN CASE WHEN {lag(2)} IS NOT NULL THEN (3 * {x} - 4 * {lag(1)} + {lag(2)}) / 2 ELSE {x} - {lag(1)} END ELSE ({lead(1)} - {lag(1)}) / 2 END * {rate}"""


def grad1(x: str) -> str:
    return f"CASE WHEN lag({x}) OVER w IS NULL AND lead({x}) OVER w IS NULL THEN 0 WHEN lag({x}) OVER w IS NULL THEN lead({x}) OVER w - {x} WHEN lead({x}) OVER w IS NULL THEN {x} - lag({x}) OVER w ELSE (lead({x}) OVER w - lag({x}) OVER w) / 2 END"


DAILY = """daily AS (SELECT l_returnflag AS series_id, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY day) - 1 AS BIGINT) AS seq, total / 1000000 AS signal FROM (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) * 1000 AS total FROM lineitem GROUP BY ALL))"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """One long channel a return flag: the quantity shipped each day."""
    sums = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("day")).agg((F.sum("l_quantity") * 1000).alias("total"))
    return sums.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("day")) - 1).cast("long").alias("seq"), (F.col("total") / 1000000).alias("signal"))


@registered(f"""WITH {DAILY}, v AS (SELECT *, {grad("signal", "25")} AS velocity FROM daily {W}), a AS (SELECT *, {grad("velocity", "25")} AS acceleration FROM v {W}), j AS (SELECT *, {grad("acceleration", "25")} AS jerk FROM a {W})
SELECT series_id, seq, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(jerk, 6) AS jerk FROM j""")
def c14_finite_derivatives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.finite_derivatives(daily(spark, d), 25.0).select("series_id", "seq", "velocity", "acceleration", "jerk"))


@registered(f"""WITH {EV}, a AS (SELECT series_id, seq, signal, row_number() OVER w AS n, max(signal) OVER (PARTITION BY series_id) - min(signal) OVER (PARTITION BY series_id) AS rng,
 list(signal) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ev {W}),
b AS (SELECT *, list_aggregate(near, 'median') AS med FROM a), c AS (SELECT *, abs(signal - med) > greatest(greatest(1e-9, 0.02 * rng), 3.5 * 1.4826 * list_aggregate(list_transform(near, lambda x: abs(x - med)), 'median')) AS outlier FROM b),
e AS (SELECT *, last_value(CASE WHEN NOT outlier THEN {{'n': n, 'x': signal}} END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
 first_value(CASE WHEN NOT outlier THEN {{'n': n, 'x': signal}} END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM c)
SELECT series_id, seq, outlier, round(CASE WHEN NOT outlier THEN signal ELSE coalesce(p.x + (q.x - p.x) * (n - p.n) / (q.n - p.n), p.x, q.x, signal) END, 6) AS filtered FROM e""")
def c17_hampel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.hampel(ev(spark, d)).select("series_id", "seq", "outlier", "filtered"))


CURVE_SQL = ", ".join(f"sqrt(avg(pow(y - ({EASE.get(c, 'bz')}), 2))) AS e{i}" for i, c in enumerate(S.CURVES))
BEZIER_X, BEZIER_SLOPE = "3 * pow(1 - t, 2) * t * 0.18 + 3 * (1 - t) * t * t * 0.38 + t * t * t", "3 * pow(1 - t, 2) * 0.18 + 6 * (1 - t) * t * 0.2 + 3 * t * t * 0.62"
BEZIER_STEPS = ", ".join(["bz0 AS (SELECT *, p AS t FROM n)", *[f"bz{i + 1} AS (SELECT * EXCLUDE (t), greatest(0, least(1, t - ({BEZIER_X} - p) / CASE WHEN abs({BEZIER_SLOPE}) < 1e-9 THEN 1 ELSE {BEZIER_SLOPE} END)) AS t FROM bz{i})" for i in range(8)], "bzd AS (SELECT *, 3 * pow(1 - t, 2) * t * 0.82 + 3 * (1 - t) * t * t + t * t * t AS bz FROM bz8)"])
CURVE_LIST = ", ".join(f"{{'error': e{i}, 'i': {i}, 'curve': '{c}'}}" for i, c in enumerate(S.CURVES))


@registered(f"""WITH {EV}, f AS (SELECT *, first_value(signal) OVER u AS a, last_value(signal) OVER u AS b, (row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1) / (count(*) OVER (PARTITION BY series_id) - 1) AS p FROM ev WINDOW u AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n AS (SELECT *, CASE WHEN abs(b - a) >= 1e-8 THEN (signal - a) / (b - a) END AS y FROM f), {BEZIER_STEPS}, g AS (SELECT series_id, count(*) AS n, max(abs(b - a)) AS delta, {CURVE_SQL} FROM bzd GROUP BY series_id),
l AS (SELECT *, list_sort([{CURVE_LIST}]) AS r FROM g)
SELECT series_id, CASE WHEN n < 4 THEN 'underdetermined' WHEN delta < 1e-8 THEN 'hold' ELSE r[1].curve END AS curve, round(CASE WHEN n >= 4 AND delta >= 1e-8 THEN r[1].error ELSE 0 END, 6) AS error,
 round(CASE WHEN n < 4 THEN 0 WHEN delta < 1e-8 THEN 1 ELSE greatest(0, least(1, 0.55 * greatest(0, least(1, (r[2].error - r[1].error) / greatest(r[2].error, 1e-12))) + 0.45 * exp(-12 * r[1].error))) END, 6) AS confidence FROM l""")
def c18_classify_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.classify_curve(ev(spark, d)))


RANKS = {"scale": 0, "rotation": 1, "center_x": 2, "center_y": 3}
CHANNELS = f"{EV}, ch AS (SELECT series_id, seq, signal AS value, CASE kind WHEN 'click' THEN 'scale' WHEN 'view' THEN 'rotation' WHEN 'error' THEN 'center_x' ELSE 'center_y' END AS channel FROM ev)"


@registered(f"""WITH {CHANNELS}, a AS (SELECT series_id, channel, arg_min(value, seq) AS a, arg_max(value, seq) AS b, max(value) - min(value) AS rng, CASE channel WHEN 'scale' THEN 0 WHEN 'rotation' THEN 1 WHEN 'center_x' THEN 2 ELSE 3 END AS k FROM ch GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rng DESC, k) AS n FROM a WHERE abs(b - a) > 1e-6)
SELECT s.series_id, coalesce(channel, 'none') AS driver, round(coalesce(rng, 0), 6) AS "range" FROM (SELECT DISTINCT series_id FROM ch) s LEFT JOIN (SELECT * FROM r WHERE n = 1) r USING (series_id)""")
def c19_curve_driver(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "click", "scale").when(F.col("kind") == "view", "rotation").when(F.col("kind") == "error", "center_x").otherwise("center_y")
    return rounded(S.curve_driver(ev(spark, d).select("series_id", "seq", F.col("signal").alias("value"), kind.alias("channel")), RANKS))


@registered(f"""WITH {EV}, v AS (SELECT series_id, seq, abs({grad1("signal")}) AS speed FROM ev {W}), t AS (SELECT *, max(speed) OVER (PARTITION BY series_id) AS top FROM v)
SELECT series_id, min(CASE WHEN speed >= greatest(1e-9, 0.08 * top) THEN seq END) AS onset, min(CASE WHEN speed = top THEN seq END) AS peak, max(CASE WHEN speed >= greatest(1e-9, 0.08 * top) THEN seq END) AS settle FROM t GROUP BY series_id""")
def c20_phase_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return S.phase_boundaries(ev(spark, d))


@registered(f"""WITH {EV}, a AS (SELECT series_id, seq, {grad1("signal")} AS x1, {grad1("edge")} AS y1 FROM ev {W}), b AS (SELECT *, {grad1("x1")} AS x2, {grad1("y1")} AS y2 FROM a {W}),
c AS (SELECT series_id, seq, CASE WHEN pow(x1 * x1 + y1 * y1, 1.5) > 1e-12 THEN abs(x1 * y2 - y1 * x2) / pow(x1 * x1 + y1 * y1, 1.5) ELSE 0 END AS c FROM b)
SELECT series_id, seq, CASE WHEN c > 0 THEN CAST(floor(log10(c)) AS BIGINT) ELSE 0 END AS exponent, CASE WHEN c > 0 THEN round(c / pow(10, floor(log10(c))), 6) ELSE 0 END AS digits FROM c""")
def c22_path_curvature(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("curvature")  # as digits and a power of ten, so that small and very large ones are compared alike
    power = F.when(c > 0, F.floor(F.log10(c))).otherwise(0).cast("long")
    found = S.path_curvature(ev(spark, d), "signal", "edge").select("series_id", "seq", "curvature", power.alias("exponent"))
    return found.select("series_id", "seq", "exponent", r6(F.when(c > 0, c / F.pow(F.lit(10.0), F.col("exponent"))).otherwise(0.0)).alias("digits"))


@registered(f"""WITH {EV}, a AS (SELECT series_id, arg_min(signal, seq) AS a, arg_max(signal, seq) AS b, min(signal) AS lo, max(signal) AS hi FROM ev GROUP BY series_id),
t AS (SELECT *, greatest(0, least(a, b) - greatest(1e-6, 0.02 * abs(b - a)) - lo) AS below, greatest(0, hi - greatest(a, b) - greatest(1e-6, 0.02 * abs(b - a))) AS above FROM a)
SELECT series_id, below > 0 OR above > 0 AS overshoot, round(below, 6) AS below, round(above, 6) AS above FROM t""")
def c23_overshoot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.overshoot(ev(spark, d)))


@registered(f"""WITH {EV}, s AS (SELECT series_id, signal - lag(signal) OVER w AS dx FROM ev {W})
SELECT series_id, CASE WHEN min(dx) >= 0 THEN 'increasing' WHEN max(dx) <= 0 THEN 'decreasing' ELSE 'none' END AS direction,
 round(coalesce(greatest(avg(CASE WHEN dx >= -0.005 THEN 1.0 WHEN dx IS NOT NULL THEN 0 END), avg(CASE WHEN dx <= 0.005 THEN 1.0 WHEN dx IS NOT NULL THEN 0 END)), 0), 6) AS ratio FROM s GROUP BY series_id""")
def c24_monotonicity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.monotonicity(ev(spark, d)))


@registered(f"""WITH {EV}, m AS (SELECT series_id, seq // 12 AS segment, signal / 1000 AS mean, signal AS p95, edge AS residual, edge < 0.7 AS found FROM ev),
a AS (SELECT series_id, CAST(segment AS BIGINT) AS segment, avg(mean) AS mean, max(p95) AS p95, avg(residual) AS residual, avg(CASE WHEN found THEN 1.0 ELSE 0 END) AS found, count(*) AS n FROM m GROUP BY ALL)
SELECT series_id, segment, round(mean, 6) AS mean, round(p95, 6) AS p95, round(residual, 6) AS residual, round(found, 6) AS found, n, CASE WHEN n <= 1 THEN 'unknown' WHEN mean < 0.00015 THEN 'static' WHEN found >= 0.5 AND residual < 0.45 THEN 'global'
 WHEN found < 0.35 AND residual >= 0.55 THEN 'independent' ELSE 'mixed' END AS motion_class, round(greatest(0.25, least(0.98, 0.55 + 0.35 * found)), 6) AS confidence FROM a""")
def c25_motion_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = ev(spark, d).select("series_id", F.floor(F.col("seq") / 12).alias("segment"), (F.col("signal") / 1000).alias("mean"), F.col("signal").alias("p95"), F.col("edge").alias("residual"), (F.col("edge") < 0.7).alias("found"))
    return rounded(S.motion_summary(rows, "mean", "p95", "residual", "found"))


@registered(f"""WITH {EV}, c AS (SELECT series_id, kind, count(*) AS n, min(seq) AS seen FROM (SELECT series_id, seq, CASE WHEN kind = 'error' THEN 'unknown' ELSE kind END AS kind FROM ev) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY series_id) AS total FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, seen) AS r, sum(n) OVER (PARTITION BY series_id) AS known FROM t WHERE kind <> 'unknown'), u AS (SELECT series_id, n / total AS share FROM t WHERE kind = 'unknown')
SELECT s.series_id, CASE WHEN coalesce(share, 0) >= 0.25 OR k.kind IS NULL THEN 'unknown' ELSE k.kind END AS model, coalesce((known - k.n) / total >= 0.30, false) AS mismatch FROM (SELECT DISTINCT series_id FROM c) s LEFT JOIN (SELECT * FROM k WHERE r = 1) k USING (series_id) LEFT JOIN u USING (series_id)""")
def c27_dominant_model(spark: SparkSession, d: str) -> DataFrame:
    return S.dominant_model(ev(spark, d).withColumn("kind", F.when(F.col("kind") == "error", "unknown").otherwise(F.col("kind"))))


@registered(f"""WITH {EV}, s AS (SELECT series_id, abs(signal - lag(signal) OVER w) AS dx FROM ev {W})
SELECT series_id, round(coalesce(avg(dx), 0), 6) AS mean, round(coalesce(quantile_cont(dx, 0.9), 0), 6) AS p90, round(coalesce(avg(CASE WHEN dx < 0.008 THEN 1.0 WHEN dx IS NOT NULL THEN 0 END), 1), 6) AS static_share FROM s GROUP BY series_id""")
def c28_activity_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.activity_stats(ev(spark, d)))


@registered(f"""WITH {FEAT}, {THR.format(x="edge", t="feat", clamp="median + greatest(0.15, 1.0 * 1.4826 * mad)")}
SELECT series_id, seq FROM feat JOIN thresholds USING (series_id) WHERE signal < 0.6 AND kind = 'click' OR kind = 'error' OR asym > 0.9 OR edge > threshold""")
def c29_ambiguous_rows(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d)
    limits = S.robust_threshold(f, "edge", 1.4826, 0.15, None, None)
    rows = f.withColumns({"conf": F.when(F.col("kind") == "click", F.col("signal")).otherwise(1.0), "model": F.when(F.col("kind") == "error", "unknown").otherwise("similarity"), "out": F.col("asym") > 0.9})
    return S.ambiguous_rows(rows, limits, "conf", "model", "out", "edge").select("series_id", "seq")


@registered(f"WITH {EV} SELECT series_id, round(avg(signal), 6) AS mean, round(quantile_cont(edge, 0.95), 6) AS p95, round(max(signal), 6) AS max FROM ev GROUP BY series_id")
def c30_residual_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ev(spark, d).groupBy("series_id").agg(F.avg("signal").alias("mean"), F.percentile("edge", F.lit(0.95)).alias("p95"), F.max("signal").alias("max")))


ANCHORS = """lens AS (SELECT series_id, max(seq) AS last FROM ev GROUP BY series_id),
anchors AS (SELECT series_id, unnest([0, last * 0.37, CAST(last AS DOUBLE)]) AS output, unnest([0, last * 0.53, CAST(last AS DOUBLE)]) AS source FROM lens)"""


def anchors(spark: SparkSession, d: str) -> DataFrame:
    last = ev(spark, d).groupBy("series_id").agg(F.max("seq").cast("double").alias("last")).where("last >= 0")
    pair = lambda a, b: F.struct((F.col("last") * a).alias("output"), (F.col("last") * b).alias("source"))
    return last.select("series_id", F.inline(F.array(pair(0.0, 0.0), pair(0.37, 0.53), pair(1.0, 1.0))))


@registered(f"""WITH {EV}, {ANCHORS}, seg AS (SELECT *, lead(output) OVER a AS output2, lead(source) OVER a AS source2, row_number() OVER (PARTITION BY series_id ORDER BY output DESC) = 2 AS last FROM anchors WINDOW a AS (PARTITION BY series_id ORDER BY output) QUALIFY output2 IS NOT NULL),
o AS (SELECT *, unnest(generate_series(CAST(ceil(output) AS BIGINT), CAST(CASE WHEN last THEN floor(output2) ELSE ceil(output2) - 1 END AS BIGINT))) AS seq FROM seg),
p AS (SELECT series_id, seq, source + (source2 - source) * (seq - output) / (output2 - output) AS shown FROM o)
SELECT p.series_id, p.seq, round(shown, 6) AS shown, round(l.signal + (h.signal - l.signal) * (shown - floor(shown)), 6) AS signal FROM p JOIN ev l ON p.series_id = l.series_id AND l.seq = floor(shown) JOIN ev h ON p.series_id = h.series_id AND h.seq = ceil(shown)""")
def c31_time_warp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.time_warp(ev(spark, d).select("series_id", "seq", "signal"), anchors(spark, d)))


@registered(f"""WITH {EV}, {ANCHORS}, s AS (SELECT *, (source - lag(source) OVER a) / (output - lag(output) OVER a) AS slope FROM anchors WINDOW a AS (PARTITION BY series_id ORDER BY output))
SELECT series_id, round(sum(pow(slope - 1, 2)) + 2 * avg(abs(source - output)), 6) AS bend, round(max(abs(slope - 1)), 6) AS largest, count(slope) AS n FROM s GROUP BY series_id""")
def c33_warp_slopes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.warp_slopes(anchors(spark, d)))


BIND = """b AS (SELECT l_orderkey AS spec, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS ord, l_returnflag AS grp, l_partkey % 10 AS "start", l_partkey % 10 + CAST(l_quantity AS BIGINT) AS "end", 1 + l_tax * 50 AS speed, l_quantity AS frames FROM lineitem)"""


def bindings(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    start = F.col("l_partkey") % 10
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spec"), F.row_number().over(w).cast("long").alias("ord"), F.col("l_returnflag").alias("grp"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), (1 + F.col("l_tax") * 50).alias("speed"), F.col("l_quantity").alias("frames"))


@registered(f"""WITH {BIND}, c AS (SELECT *, coalesce(lag("end") OVER g <> "start", false) AS gap, coalesce(greatest(speed / lag(speed) OVER g, lag(speed) OVER g / speed) > 4, false) AS speed_jump, "end" - "start" <> greatest(1, CAST(round_even(frames * speed, 0) AS BIGINT)) AS wrong_duration FROM b WINDOW g AS (PARTITION BY spec, grp ORDER BY ord))
SELECT spec, ord, gap, speed_jump, wrong_duration FROM c WHERE gap OR speed_jump OR wrong_duration""")
def c34_binding_continuity(spark: SparkSession, d: str) -> DataFrame:
    return S.binding_continuity(bindings(spark, d), "spec", "ord", "grp", "start", "end", "speed", "frames").select("spec", "ord", "gap", "speed_jump", "wrong_duration")


@registered(f"WITH {BIND}, s AS (SELECT *, grp IS DISTINCT FROM lag(grp) OVER (PARTITION BY spec ORDER BY ord) AS fresh FROM b) SELECT spec, grp, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM s GROUP BY ALL HAVING sum(CASE WHEN fresh THEN 1 ELSE 0 END) > 1")
def c34_group_reappears(spark: SparkSession, d: str) -> DataFrame:
    return S.group_reappears(bindings(spark, d), "spec", "ord", "grp")


@registered("SELECT l_orderkey AS series_id, count(*) AS n, max(l_quantity) AS max_speed, CAST(sum(CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END) AS BIGINT) AS n_fast, CASE WHEN max(l_quantity) > 24 THEN 'warn' ELSE 'pass' END AS status FROM lineitem GROUP BY l_orderkey")
def c35_temporal_risk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("series_id")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("max_speed"), F.sum((F.col("l_quantity") > 24).cast("long")).alias("n_fast"), F.when(F.max("l_quantity") > 24, "warn").otherwise("pass").alias("status"))


PASSES = """ps AS (SELECT o_custkey AS study, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS pass, o_totalprice, o_orderkey % 1000 / 10.0 AS k, o_orderstatus FROM orders), lng AS (SELECT study, pass, 'price' AS metric, o_totalprice AS value FROM ps UNION ALL SELECT study, pass, 'key', k FROM ps)"""


def passes(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("study"), F.row_number().over(w).cast("long").alias("pass"), "o_totalprice", (F.col("o_orderkey") % 1000 / 10.0).alias("k"), "o_orderstatus")


@registered(f"WITH {PASSES} SELECT study, pass, metric, round(value - lag(value) OVER (PARTITION BY study, metric ORDER BY pass), 6) AS delta FROM lng")
def c36_study_deltas(spark: SparkSession, d: str) -> DataFrame:
    long = passes(spark, d).select("study", "pass", F.inline(F.array(F.struct(F.lit("price").alias("metric"), F.col("o_totalprice").alias("value")), F.struct(F.lit("key").alias("metric"), F.col("k").alias("value")))))
    return rounded(S.study_deltas(long, "study", "pass", "metric", "value").select("study", "pass", "metric", "delta"))


@registered(f"WITH {PASSES} SELECT study, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_selected, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AND sum(CASE WHEN o_orderstatus = 'F' AND k > 20 THEN 1 ELSE 0 END) = 1 AS ok FROM ps GROUP BY study")
def c36_selection_gate(spark: SparkSession, d: str) -> DataFrame:
    return S.selection_gate(passes(spark, d), "study", F.col("o_orderstatus") == "F", F.col("k") > 20)


@registered(f"""WITH {EV}, r AS (SELECT series_id, seq, least(CASE WHEN seq BETWEEN 10 AND 30 THEN 10 + 20 * pow((seq - 10) / 20.0, 1.5) ELSE seq END, CAST(max(seq) OVER (PARTITION BY series_id) AS DOUBLE)) AS shown FROM ev)
SELECT r.series_id, r.seq, round(l.signal + (h.signal - l.signal) * (shown - floor(shown)), 6) AS retimed FROM r JOIN ev l ON r.series_id = l.series_id AND l.seq = floor(shown) JOIN ev h ON r.series_id = h.series_id AND h.seq = ceil(shown)""")
def c37_bounded_retime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.bounded_retime(ev(spark, d).select("series_id", "seq", "signal"), 10, 30, 1.5).select("series_id", "seq", "retimed"))


@registered(f"""WITH {SEGMENTS}, n AS (SELECT *, lead("start") OVER (PARTITION BY series_id ORDER BY "start") AS nx FROM segments WHERE CAST(substr(segment_id, 6) AS INT) % 5 <> 3),
e AS (SELECT n.series_id, min(n."start") AS a, max(n."end") AS b, any_value(bounds."start") AS lo, any_value(bounds."end") AS hi FROM n JOIN bounds ON n.series_id = bounds.series_id GROUP BY n.series_id)
SELECT series_id, 'gap' AS problem FROM n WHERE nx IS NOT NULL AND nx <> "end" UNION ALL SELECT series_id, 'start' FROM e WHERE a <> lo UNION ALL SELECT series_id, 'end' FROM e WHERE b <> hi""")
def g8_validate_partition(spark: SparkSession, d: str) -> DataFrame:
    return S.validate_partition(segments(spark, d).where("cast(substring(segment_id, 6) as int) % 5 <> 3"), bounds(spark, d))
