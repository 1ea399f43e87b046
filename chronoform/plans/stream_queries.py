"""Streaming queries over events, run to the end of what is there; a last row far ahead closes every window.

The SQL of each states the batch result that the stream must come to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoform.sources.storage import new_path
from chronoform.streaming import operators as X

from .registry import registered, rounded

FLUSH = "2100-01-01 00:00:00"


def events(spark: SparkSession, sf_dir: str, closing: bool = True) -> DataFrame:
    """The events as a stream of two batches: the table, then a row that moves the watermark past all of it."""
    folder = new_path(spark, "events")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{folder}/rows")
    written = spark.read.parquet(f"{folder}/rows")
    schema, n = written.schema, len(written.inputFiles())  # with files of no row, which a first task leaves that finds none
    if closing:
        # written later, so it is read last
        spark.createDataFrame([(-1,)], "event_id long").select("event_id", F.lit(FLUSH).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("close").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props")).select(*schema.names).write.mode("append").parquet(f"{folder}/rows")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", n if closing else 10_000).parquet(f"{folder}/rows")


def parts(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The events as a stream of some n batches, each with every n-th row; of large tables a part is as many files as tasks read it."""
    folder = new_path(spark, "events")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(n):
        rows.where(F.col("event_id") % n == k).write.mode("append").parquet(f"{folder}/rows")
    files = len(spark.read.parquet(f"{folder}/rows").inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // n)).parquet(f"{folder}/rows")


@registered("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def s1_stream_append_new(spark: SparkSession, d: str) -> DataFrame:
    folder, stream = new_path(spark, "s1"), parts(spark, d, 2)
    X.append_new(stream.unionByName(parts(spark, d, 3)), f"{folder}/table", f"{folder}/checkpoint", "event_id").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/table").select("event_id", "user_id", "event_type", "value"))


@registered("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def s1_stream_evidence(spark: SparkSession, d: str) -> DataFrame:
    stream = events(spark, d, closing=False)
    twice = stream.unionByName(stream)
    return rounded(X.run_to_table(X.unique_evidence(twice, delay="4000 days"), new_path(spark, "s1")).select("event_id", "user_id", "event_type", "value"))


def evidence_of(rows: DataFrame) -> DataFrame:
    """Events as evidence: every 13th is a correction by hand, and every 9th supersedes the two events before it and the one after, whatever their keys."""
    i = F.col("event_id")
    supersedes = F.when(i % 9 == 0, F.array(i - 2, i - 1, i + 1)).otherwise(F.array().cast("array<long>"))
    return rows.select(F.col("user_id").alias("asset_id"), F.col("event_type").alias("kind"), i.alias("id"), F.when(i % 13 == 0, "human-correction").otherwise("measured").alias("authority"), F.col("ts").alias("generated_at"), supersedes.alias("supersedes"))


@registered("""WITH e AS (SELECT user_id AS asset_id, event_type AS kind, event_id AS id, ts, CASE WHEN event_id % 13 = 0 THEN 'human-correction' ELSE 'measured' END AS authority FROM events),
gone AS (SELECT unnest([id - 2, id - 1, id + 1]) AS id FROM e WHERE id % 9 = 0)
SELECT asset_id, kind, id, authority FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, kind ORDER BY authority = 'human-correction' DESC, ts DESC, id DESC) AS n FROM e WHERE id NOT IN (SELECT id FROM gone)) WHERE n = 1""")
def s2_stream_effective(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "s2")
    X.merge_effective(evidence_of(parts(spark, d, 3)), f"{folder}/ledger", f"{folder}/effective", f"{folder}/checkpoint", ("asset_id", "kind")).awaitTermination()
    return X.effective_now(spark, f"{folder}/effective").select("asset_id", "kind", "id", "authority")


@registered("""SELECT CAST(epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) // 1000000 AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total, round(sqrt(avg(value * value)), 4) AS rms FROM events GROUP BY ALL""")
def s3_stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = X.run_to_table(X.tumbling(events(spark, d), "6 hours", "event_type"), new_path(spark, "s3")).where("event_type <> 'close'")
    return out.select(F.col("start").cast("long").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"), F.round("rms", 4).alias("rms"))


@registered("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) AS BIGINT) + 10800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def s4_stream_quiet(spark: SparkSession, d: str) -> DataFrame:
    out = X.run_to_table(X.sessions(events(spark, d), "3 hours", "user_id"), new_path(spark, "s4")).where("user_id >= 0")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@registered("""WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nt FROM events)
SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS start_us, CAST(coalesce(epoch_us(nt), -1) AS BIGINT) AS end_us, nt IS NULL AS open FROM g WHERE nt IS NULL OR nt - ts >= INTERVAL 3 HOUR""")
def s4_stream_gaps(spark: SparkSession, d: str) -> DataFrame:
    out = X.run_to_table(X.quiet_spans(events(spark, d), "3 hours", "1 day"), new_path(spark, "s4")).where("user_id >= 0")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.coalesce(F.unix_micros("end"), F.lit(-1)).cast("long").alias("end_us"), "open")


@registered("""WITH RECURSIVE r AS (SELECT user_id, ts, value FROM events WHERE value >= 50), n AS (SELECT a.user_id, a.ts, a.value, min(b.ts) AS nt FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.ts - a.ts >= INTERVAL 12 HOUR GROUP BY ALL),
kept AS (SELECT user_id, ts, value, nt FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM n) WHERE k = 1 UNION ALL SELECT n.user_id, n.ts, n.value, n.nt FROM kept JOIN n ON kept.user_id = n.user_id AND kept.nt = n.ts)
SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS us, round(value, 6) AS value FROM kept""")
def s5_stream_onsets(spark: SparkSession, d: str) -> DataFrame:
    out = X.run_to_table(X.onsets(events(spark, d), 50.0, 43200.0), new_path(spark, "s5")).where("user_id >= 0")
    return rounded(out.select("user_id", F.unix_micros("ts").alias("us"), "value"))


@registered("SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS us, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)), 0), 6) AS delta FROM events")
def s6_stream_changes(spark: SparkSession, d: str) -> DataFrame:
    out = X.run_to_table(X.changes(events(spark, d)), new_path(spark, "s6")).where("user_id >= 0")
    return rounded(out.select("user_id", F.unix_micros("ts").alias("us"), "delta"))


@registered("""SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS phase, count(*) AS n, true AS stalled FROM events GROUP BY user_id""")
def s7_stream_phase_progress(spark: SparkSession, d: str) -> DataFrame:
    out = X.run_to_table(X.phase_progress(events(spark, d), 3_600_000), new_path(spark, "s7"))
    return out.where("stalled and user_id >= 0").select("user_id", "phase", "n", "stalled")
