"""Queries over few long series, dealt to blocks: the events of each type in order of their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoform.operators import blocks as B
from chronoform.operators import grouped as G
from chronoform.operators import intervals as I
from chronoform.operators import series as S
from chronoform.operators.quantiles import exact_quantiles

from .fixtures import table
from .registry import registered, rounded
from .series_queries import grad

BLOCK_ROWS = 1_000
LONG = "lng AS (SELECT event_type AS series_id, event_id AS seq, value / 500.0 AS signal, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS edge FROM events)"
W = "WINDOW w AS (PARTITION BY series_id ORDER BY seq)"


def long(spark: SparkSession, d: str) -> DataFrame:
    edge = F.get_json_object("props", "$.k").cast("double") / 100.0
    return table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("event_id").alias("seq"), (F.col("value") / 500.0).alias("signal"), edge.alias("edge"))


@registered(f"""WITH {LONG}, f AS (SELECT *, min(seq) OVER (PARTITION BY series_id) AS first FROM lng), r AS (SELECT * FROM f WHERE seq > first), m AS (SELECT series_id, median(signal) AS median FROM r GROUP BY series_id),
k AS (SELECT r.series_id, m.median, median(abs(signal - m.median)) AS mad FROM r JOIN m USING (series_id) GROUP BY ALL), t AS (SELECT series_id, median + greatest(0.08, mad) AS threshold FROM k),
nb AS (SELECT *, lag(signal) OVER w AS p, coalesce(lead(signal) OVER w, 0) AS n FROM lng {W}) SELECT series_id, seq, round(signal, 6) AS signal, round(threshold, 6) AS threshold FROM nb JOIN t USING (series_id) WHERE p IS NOT NULL AND signal >= threshold AND signal >= p AND signal >= n""")
def c2_long_peaks(spark: SparkSession, d: str) -> DataFrame:
    rows = long(spark, d)
    limits = S.robust_threshold(rows, k=1.0, lo=None, hi=None, hot_rows=BLOCK_ROWS)
    return rounded(S.local_peaks(rows, limits, block_rows=BLOCK_ROWS).select("series_id", "seq", "signal", "threshold"))


@registered(f"""WITH {LONG}, v AS (SELECT *, {grad("signal", "25")} AS velocity FROM lng {W}), a AS (SELECT *, {grad("velocity", "25")} AS acceleration FROM v {W}), j AS (SELECT *, {grad("acceleration", "25")} AS jerk FROM a {W})
SELECT series_id, seq, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(jerk, 6) AS jerk FROM j""")
def c14_long_derivatives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.finite_derivatives(long(spark, d), 25.0, block_rows=BLOCK_ROWS).select("series_id", "seq", "velocity", "acceleration", "jerk"))


@registered(f"""WITH {LONG}, a AS (SELECT series_id, seq, signal, row_number() OVER w AS n, max(signal) OVER (PARTITION BY series_id) - min(signal) OVER (PARTITION BY series_id) AS rng,
 list(signal) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lng {W}),
b AS (SELECT *, list_aggregate(near, 'median') AS med FROM a), c AS (SELECT *, abs(signal - med) > greatest(greatest(1e-9, 0.02 * rng), 3.5 * 1.4826 * list_aggregate(list_transform(near, lambda x: abs(x - med)), 'median')) AS outlier FROM b),
e AS (SELECT *, last_value(CASE WHEN NOT outlier THEN {{'n': n, 'x': signal}} END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
 first_value(CASE WHEN NOT outlier THEN {{'n': n, 'x': signal}} END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM c)
SELECT series_id, seq, outlier, round(CASE WHEN NOT outlier THEN signal ELSE coalesce(p.x + (q.x - p.x) * (n - p.n) / (q.n - p.n), p.x, q.x, signal) END, 6) AS filtered FROM e""")
def c17_long_hampel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.hampel(long(spark, d), block_rows=BLOCK_ROWS).select("series_id", "seq", "outlier", "filtered"))


def fit_sql(window: int, degree: int) -> str:
    """The smoothed value of a window of full length in the middle of a series, as a weighting of its rows."""
    weights = G.polynomial_weights(window, degree)[window // 2][0]
    half = window // 2
    return " + ".join(f"{w!r} * {'lag' if i < half else 'lead'}(signal, {abs(i - half)}) OVER w" for i, w in enumerate(weights.tolist()))


@registered(f"WITH {LONG}, s AS (SELECT series_id, seq, {fit_sql(7, 2)} AS smooth FROM lng {W}) SELECT series_id, seq, round(smooth, 6) AS smooth FROM s WHERE smooth IS NOT NULL")
def c15_long_polynomials(spark: SparkSession, d: str) -> DataFrame:
    rows = B.numbered(long(spark, d), "series_id", "seq", block_rows=BLOCK_ROWS)
    rows = B.whole(rows, {"last": F.max(B.NUMBER)}, "series_id", BLOCK_ROWS, "seq").withColumn("i", F.col(B.NUMBER))
    rows = G.local_polynomial(rows, 1.0, 7, 2, block_rows=BLOCK_ROWS)
    return rounded(rows.where((F.col("i") >= 3) & (F.col("i") <= F.col("last") - 3)).select("series_id", "seq", "smooth"))


@registered(f"""WITH {LONG}, r AS (SELECT *, sum(CASE WHEN signal < 0.8 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM lng)
SELECT series_id, min(seq) AS "start", max(seq) + 1 AS "end", count(*) AS n, round(sum(signal), 6) AS total FROM r WHERE signal < 0.8 GROUP BY series_id, g HAVING count(*) >= 4""")
def c3_long_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = S.islands(long(spark, d), F.col("signal") < 0.8, block_rows=BLOCK_ROWS).groupBy("series_id", "island")
    return rounded(runs.agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), F.count("*").alias("n"), F.sum("signal").alias("total")).where("n >= 4").drop("island"))


SPANS = f"""{LONG}, spans AS (SELECT series_id, seq AS "start", seq + CAST(round(edge * 12) AS BIGINT) + CASE WHEN seq % 97 = 0 THEN 900 ELSE 0 END AS "end" FROM lng)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    far = F.when(F.col("seq") % 97 == 0, 900).otherwise(0)
    return long(spark, d).select("series_id", F.col("seq").alias("start"), (F.col("seq") + F.round(F.col("edge") * 12).cast("long") + far).alias("end"))


@registered(f"""WITH {SPANS}, m1 AS (SELECT *, max("end") OVER (PARTITION BY series_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans),
m2 AS (SELECT *, sum(CASE WHEN far IS NULL OR "start" > far THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m1)
SELECT series_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM m2 GROUP BY series_id, g""")
def g1_long_merge(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_ranges(spans(spark, d), block_rows=BLOCK_ROWS)


@registered(f"""WITH {SPANS}, t AS (SELECT series_id, max("end") + 7 AS total FROM spans GROUP BY series_id), a AS (SELECT series_id, "start", "end" FROM spans UNION ALL SELECT series_id, total, total FROM t),
f AS (SELECT *, coalesce(max("end") OVER (PARTITION BY series_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frm FROM a) SELECT series_id, frm AS "start", "start" AS "end" FROM f WHERE "start" - frm > 0.05""")
def g2_long_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = spans(spark, d)
    return I.gaps(rows, rows.groupBy("series_id").agg((F.max("end") + 7).alias("total")), block_rows=BLOCK_ROWS)


@registered(f"WITH {LONG} SELECT series_id, round(quantile_cont(edge, 0.5), 6) AS median, round(quantile_cont(signal, 0.95), 6) AS p95, round(max(signal), 6) AS max FROM lng GROUP BY series_id")
def c30_long_residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = long(spark, d)
    mid, top = exact_quantiles(rows, "edge", {"median": 0.5}, "series_id", BLOCK_ROWS), exact_quantiles(rows, "signal", {"p95": 0.95, "max": 1.0}, "series_id", BLOCK_ROWS)
    return rounded(mid.join(top, "series_id"))
