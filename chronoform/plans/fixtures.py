"""Views of the driver tables that stand in for signals, intervals, ledgers and transcripts; each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoform.functions import scalar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one series a user: seq from 0 in order of (ts, event_id), signal and edge in [0, 1]."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6).alias("t_seconds"),
        (F.col("value") / 500.0).alias("signal"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("edge"),
        F.col("event_type").alias("kind"),
        "event_id",
        "ts",
        "value",
    )


EV = """ev AS (SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
  (epoch_us(ts) - 1704067200000000) / 1e6 AS t_seconds, value / 500.0 AS signal, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS edge,
  event_type AS kind, event_id, ts, value FROM events)"""


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev with the change of each row against the row before."""
    w = Window.partitionBy("series_id").orderBy("seq")
    step = lambda c: F.coalesce(F.abs(c - F.lag(c).over(w)), F.lit(0.0))
    df = ev(spark, sf_dir).withColumns({"pixel": step(F.col("signal")), "hist": step(F.col("edge")), "luma": step((F.col("signal") + F.col("edge")) / 2), "edges": step((F.col("signal") - F.col("edge")) / 2)})
    return df.withColumns({"asym": F.least(F.lit(1.0), 4 * F.abs(F.col("pixel") - F.col("hist"))), "combined": scalar.combined_change("pixel", "hist", "luma", "edges")})


FEAT = f"""{EV}, feat0 AS (SELECT *, coalesce(abs(signal - lag(signal) OVER w), 0) AS pixel, coalesce(abs(edge - lag(edge) OVER w), 0) AS hist,
  coalesce(abs((signal + edge) / 2 - lag((signal + edge) / 2) OVER w), 0) AS luma, coalesce(abs((signal - edge) / 2 - lag((signal - edge) / 2) OVER w), 0) AS edges
  FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
feat AS (SELECT *, least(1.0, 4 * abs(pixel - hist)) AS asym, least(1.0, 0.45 * pixel + 0.35 * hist + 0.12 * luma + 0.08 * edges) AS combined FROM feat0)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 rasters (x[8 r + c]) of doubles: one series a label, in order of vec_id."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("series_id"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("x"))


EMB = "emb AS (SELECT CAST(label AS BIGINT) AS series_id, vec_id AS seq, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as transcripts: a turn lasts as many seconds as it has words over 2.5."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    df = table(spark, sf_dir, "conversations").withColumn("n", words)
    return df.select(F.col("conv_id").alias("series_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text", ((F.sum("n").over(w) - F.col("n")) / 2.5).alias("start"), (F.sum("n").over(w) / 2.5).alias("end"))


CONV = r"""conv AS (SELECT conv_id AS series_id, turn AS seq, role AS speaker, text, (sum(n) OVER w - n) / 2.5 AS "start", sum(n) OVER w / 2.5 AS "end"
  FROM (SELECT *, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open frame ranges: each event of a series covers 1 to 100 frames from its position times 40."""
    return ev(spark, sf_dir).select("series_id", "seq", "kind", (F.col("seq") * 40).alias("start"), (F.col("seq") * 40 + F.greatest(F.lit(1), F.round(F.col("edge") * 100).cast("long"))).alias("end"), "signal")


SPANS = f"""{EV}, spans AS (SELECT series_id, seq, kind, seq * 40 AS "start", seq * 40 + greatest(1, CAST(round(edge * 100) AS BIGINT)) AS "end", signal FROM ev)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed-rate level per event type: the sum of values of each hour over 1000, zero where an hour has none."""
    e = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"), "value")
    sums = e.groupBy("event_type", "hour").agg(F.sum("value").alias("total"))
    ends = e.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = e.select("event_type").distinct().join(F.broadcast(ends)).select("event_type", F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("hour"))
    w = Window.partitionBy("event_type").orderBy("hour")
    return spine.join(sums, ["event_type", "hour"], "left").select(F.col("event_type").alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), (F.coalesce("total", F.lit(0.0)) / 1000).alias("level"))


HOURLY = """hours AS (SELECT event_type, date_trunc('hour', ts) AS hour, value FROM events),
hourly AS (SELECT s.event_type AS series_id, CAST(row_number() OVER (PARTITION BY s.event_type ORDER BY s.hour) - 1 AS BIGINT) AS seq, coalesce(total, 0) / 1000 AS level
  FROM (SELECT event_type, unnest(generate_series((SELECT CAST(min(hour) AS TIMESTAMP) FROM hours), (SELECT CAST(max(hour) AS TIMESTAMP) FROM hours), INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT event_type FROM hours)) s
  LEFT JOIN (SELECT event_type, hour, sum(value) AS total FROM hours GROUP BY ALL) t ON s.event_type = t.event_type AND s.hour = t.hour)"""
