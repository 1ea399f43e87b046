"""Streams whose rows come in batches and out of order must come to what the rows give in order."""

from __future__ import annotations

import time
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronoform.operators.ledger import effective_evidence
from chronoform.streaming import operators as X

SCHEMA = "user_id long, ts timestamp, value double"


def batches(spark, folder, parts):
    """A stream of one file a batch, in the order given, and a last row that closes it."""
    far = pd.DataFrame({"user_id": [-1], "ts": [pd.Timestamp("2100-01-01")], "value": [0.0]})
    for n, part in enumerate([*parts, far]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/rows")
        time.sleep(1.1)  # files are read by their time of change
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/rows")


def test_rows_out_of_order_across_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    start = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"user_id": rng.integers(0, 3, 90), "minute": np.arange(90), "value": rng.integers(0, 100, 90).astype(float)})
    rows["ts"] = start + pd.to_timedelta(rows.minute, unit="min")
    rows["arrival"] = rows.minute + rng.integers(0, 30, 90)  # up to half an hour late, within the delay
    rows = rows.sort_values("arrival")
    parts = [rows.iloc[k : k + 30][["user_id", "ts", "value"]] for k in (0, 30, 60)]
    stream = batches(spark, tmp_path, parts)
    want = rows.sort_values(["user_id", "ts"])
    deltas = want.assign(delta=want.groupby("user_id").value.diff().abs().fillna(0.0))
    got = X.run_to_table(X.changes(stream, delay="60 minutes"), f"file://{tmp_path}/changes").where("user_id >= 0").orderBy("user_id", "ts").toPandas()
    assert got.delta.tolist() == deltas.delta.tolist() and got.ts.tolist() == deltas.ts.tolist()
    kept = []
    for user, own in want.groupby("user_id"):
        last = None
        for r in own.itertuples():
            if r.value >= 40 and (last is None or (r.ts - last).total_seconds() >= 600):
                kept.append((user, r.ts))
                last = r.ts
    got = X.run_to_table(X.onsets(stream, 40.0, 600.0, delay="60 minutes"), f"file://{tmp_path}/onsets").where("user_id >= 0").orderBy("user_id", "ts").toPandas()
    assert list(zip(got.user_id, got.ts, strict=True)) == kept


def test_late_corrections_and_untouched_buckets(spark, tmp_path):
    schema = "asset_id long, kind string, id long, authority string, generated_at timestamp"
    row = lambda a, i, authority, day: (a, "k", i, authority, datetime(2024, 1, day))
    for part in ([row(a, a, "measured", 5) for a in range(20)], [row(3, 100, "measured", 9), row(4, 101, "measured", 1)], [row(3, 102, "human-correction", 2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    X.merge_effective(stream, f"file://{tmp_path}/ledger", f"file://{tmp_path}/now", f"file://{tmp_path}/c", ("asset_id", "kind")).awaitTermination()
    got = {r.asset_id: r.id for r in X.effective_now(spark, f"file://{tmp_path}/now").collect()}
    assert got == {a: a for a in range(20)} | {3: 102}
    sizes = {r.version: r.n for r in spark.read.option("basePath", f"file://{tmp_path}/now").parquet(f"file://{tmp_path}/now").groupBy("version").agg(F.count_distinct("bucket").alias("n")).collect()}
    assert sizes[2] == 1 and sizes[1] <= 2 < sizes[0]


def test_keys_are_never_forgotten(spark, tmp_path):
    for day, ids in ((1, [1, 2, 2]), (20, [2, 3]), (28, [1, 4])):
        spark.createDataFrame([(i, datetime(2024, 1, day), float(day)) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    X.append_new(stream, f"file://{tmp_path}/table", f"file://{tmp_path}/c", "user_id").awaitTermination()
    assert sorted((r.user_id, r.value) for r in spark.read.parquet(f"file://{tmp_path}/table").collect()) == [(1, 1.0), (2, 1.0), (3, 20.0), (4, 28.0)]


def test_supersession_in_any_order(spark, tmp_path):
    """A row is dead whether it comes before, with or after what supersedes it; its key falls back to the next best, or to nothing."""
    schema = "asset_id long, kind string, id long, authority string, generated_at timestamp, supersedes array<long>"
    rng = np.random.default_rng(4)
    rows = [(int(a), "k", i, "human-correction" if i % 5 == 0 else "measured", datetime(2024, 1, 1 + int(day)), [int(x) for x in rng.integers(0, 60, k)]) for i, (a, day, k) in enumerate(zip(rng.integers(0, 6, 60), rng.integers(0, 20, 60), rng.choice([0, 0, 0, 1, 2], 60), strict=True))]
    rows.append((99, "k", 100, "measured", datetime(2024, 1, 1), []))
    order = rng.permutation(61).tolist()
    batches_ = [order[:20], order[20:40], order[40:]]
    lone = [(98, "k", 200, "measured", datetime(2024, 1, 1), [100])]  # 99 loses its only row
    for part in batches_:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)
    spark.createDataFrame(lone, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    X.merge_effective(stream, f"file://{tmp_path}/ledger", f"file://{tmp_path}/now", f"file://{tmp_path}/c", ("asset_id", "kind"), buckets=8).awaitTermination()
    whole = effective_evidence(spark.createDataFrame([*rows, *lone], schema).withColumn("failed_kind", F.lit(None).cast("string")))
    want = {(r.asset_id, r.id) for r in whole.collect()}
    assert {(r.asset_id, r.id) for r in X.effective_now(spark, f"file://{tmp_path}/now").collect()} == want and 99 not in {a for a, _ in want}
    assert X.drop_old_versions(spark, f"file://{tmp_path}/now", keep=1) > 0
    assert {(r.asset_id, r.id) for r in X.effective_now(spark, f"file://{tmp_path}/now").collect()} == want


def test_quiet_spans_are_the_gaps_of_a_batch(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    minutes = [0, 5, 9, 60, 61, 300, 330, 332]
    parts = [pd.DataFrame({"user_id": 1, "ts": [start + pd.Timedelta(minutes=m) for m in part], "value": 1.0}) for part in (minutes[:3], minutes[3:5], minutes[5:])]
    stream = batches(spark, tmp_path, parts)
    got = X.run_to_table(X.quiet_spans(stream, "20 minutes", "1 day", delay="10 minutes"), f"file://{tmp_path}/quiet").where("user_id = 1 and not open").orderBy("start").toPandas()
    assert [((a - start).total_seconds() / 60, (b - start).total_seconds() / 60) for a, b in zip(got.start, got.end, strict=True)] == [(9, 60), (61, 300), (300, 330)]
    tail = spark.read.parquet(f"file://{tmp_path}/quiet/rows").where("user_id = 1 and open").collect()
    assert [(r.start - start).total_seconds() / 60 for r in tail] == [332] and tail[0].end is None


def test_streams_read_whole_tables_whose_first_split_is_empty(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from chronoform.plans import stream_queries as Q

    n = 4000
    events = pd.DataFrame({"event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) % (n // 2), unit="h"), "user_id": np.arange(n) // (n // 2), "event_type": "view", "value": np.arange(n) % 97 * 1.0, "props": '{"k": 1}'})
    events["ts"] = events.ts.astype("datetime64[us]")
    pq.write_table(pa.Table.from_pandas(events, preserve_index=False), tmp_path / "events.parquet", row_group_size=n // 2)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, (tmp_path / "events.parquet").stat().st_size // 16)))
    try:
        changed, onsets, gaps = (q(spark, f"file://{tmp_path}").groupBy("user_id").count().toPandas() for q in (Q.s6_stream_changes, Q.s5_stream_onsets, Q.s4_stream_gaps))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert dict(zip(changed.user_id, changed["count"], strict=True)) == {0: n // 2, 1: n // 2}
    assert sorted(onsets.user_id) == [0, 1] and sorted(gaps.user_id) == [0, 1]


def test_parts_of_a_stream_are_written_by_as_many_tasks_as_read_them(spark, tmp_path, monkeypatch):
    from chronoform.plans import stream_queries as Q

    made, new_path = [], Q.new_path
    monkeypatch.setattr(Q, "new_path", lambda *a: (made.append(new_path(*a)), made[-1])[1])

    spark.range(4000).selectExpr("id as event_id", "timestamp'2024-01-01' as ts").repartition(6).write.parquet(f"file://{tmp_path}/events.parquet")
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(2**27))  # a file a task
    try:
        folder = f"file://{tmp_path}"
        stream = Q.parts(spark, folder, 2)
        X.append_new(stream, f"{folder}/table", f"{folder}/checkpoint", "event_id").awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    assert spark.read.parquet(f"{folder}/table").select("event_id").distinct().count() == 4000
    assert len(spark.read.parquet(made[-1] + "/rows").inputFiles()) > 2
    assert len(list((tmp_path / "checkpoint" / "offsets").glob("[0-9]*"))) == 2


def test_phases_of_many_keys_share_a_group(spark, tmp_path):
    """Keys of one bucket stall on their own: one that gets no more rows while its neighbour does, and begins anew after that."""
    batches = [[(1, 2, "a"), (1, 5, "b"), (2, 3, "x"), (None, 1, "n")], [(2, 4000, "y")], [(2, 8000, "z")], [(1, 9000, "c")], [(3, 20_000, "q")], [(3, 40_000, "r")]]
    for rows in batches:
        df = spark.createDataFrame(rows, "user_id long, s long, event_type string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_type")
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)  # files are read by their time of change
    stream = X.read_rows(spark, f"file://{tmp_path}/in")
    found = {}
    for buckets in (1, 64):
        out = X.run_to_table(X.phase_progress(stream, 3_600_000, delay="0 seconds", buckets=buckets), f"file://{tmp_path}/out{buckets}")
        found[buckets] = sorted(((r.user_id, r.phase, r.at, r.n, r.stalled) for r in out.collect()), key=str)
    stalled = {r[:4] for r in found[1] if r[4]}
    assert stalled == {(1, "b", 5000, 2), (None, "n", 1000, 1), (1, "c", 9_000_000, 1), (2, "z", 8_000_000, 3)} | {r for r in stalled if r[0] == 3}
    assert found[1] == found[64]
