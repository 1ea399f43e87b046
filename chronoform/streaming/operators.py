"""Structured Streaming forms of the incremental operators. Each takes and returns a streaming (or batch) DataFrame.

Late rows: windows, sessions and stateful operators drop what comes after the watermark. Corrections are never dropped:
:func:`merge_effective` keeps the best of each key, whenever it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def read_rows(spark: SparkSession, path: str, time: str = "ts", files_per_batch: int = 1, name_glob: str | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, with the time column as a timestamp that can carry a watermark."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def unique_evidence(rows: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Append-only intake: a row whose key came before, within the delay, is dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(rows: DataFrame, width: str, *groups: str, value: str = "value", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Count, sum and root mean square of each window and group."""
    agg = rows.withWatermark(time, delay).groupBy(F.window(time, width), *groups)
    out = agg.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *groups, "n", "total", "rms")


def sessions(rows: DataFrame, gap: str, *groups: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Spans of activity of each group; what lies between two is a quiet span of at least the gap (see :func:`quiet_spans`)."""
    out = rows.withWatermark(time, delay).groupBy(F.session_window(time, gap), *groups).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *groups, "n")


def quiet_spans(rows: DataFrame, gap: str, tail: str, key: str = "user_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(key, start, end, open): the spans of at least ``gap`` between one row of a key and the next, once the watermark has passed both.

    What follows the last row of a key is a span that is still open (its end null), reported once the watermark is ``gap`` and ``tail`` beyond it; if rows come
    after all, the closed span follows. The state holds a key's rows of the delay, its last row before them, and whether its open span was told.
    """
    kind = dict(rows.dtypes)[key]
    width, wait = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (gap, tail))

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, waiting = state.get if state.exists else (None, False, [])
        waiting, mark, out = list(waiting), state.getCurrentWatermarkMs() * 1000, []
        if not state.hasTimedOut:
            for part in parts:
                waiting += [t for t in part["at"].tolist() if t > mark]
        waiting.sort()
        done = [t for t in waiting if t <= mark]
        for t in done:
            if last is not None and t - last >= width:
                out.append((group[0], last, t, False))
            last, told = t, False
        waiting = waiting[len(done) :]
        if last is not None and not waiting and not told and mark >= last + width + wait:
            out.append((group[0], last, None, True))
            told = True
        state.update((last, told, waiting))
        if waiting or not told:
            state.setTimeoutTimestamp(max((waiting[0] if waiting else last + width + wait) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: pd.Series([r[0] for r in out], dtype=None if out else "object"), "start": pd.array([r[1] for r in out], "Int64"), "end": pd.array([r[2] for r in out], "Int64"), "open": pd.array([r[3] for r in out], "boolean")})

    slim = rows.withWatermark(time, delay).select(key, F.col(time), F.unix_micros(time).alias("at"))
    found = slim.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start long, end long, open boolean", "last long, told boolean, at array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "open")


def settled(rows: DataFrame, settle: Callable[[tuple, list[tuple[int, float]], float | None], tuple[list[tuple], float | None]], name: str, key: str, value: str, time: str, delay: str) -> DataFrame:
    """Rows of each key handed to settle(key, [(microseconds, value)], last) in order of time, once the watermark has passed them; it returns what comes out and the new last.

    Rows wait in the state until then, so rows that come in any order within the delay, whatever their batches, give what they would give in order.
    Later ones are dropped. The state holds a key's rows of the delay and one number.
    """

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, values = state.get if state.exists else (None, [], [])
        waiting = list(zip(at, values, strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for part in parts:
                stamps = part["ts"].astype("datetime64[us]").astype("int64")
                waiting += [(int(t), float(v)) for t, v in zip(stamps, part["value"], strict=True) if t > mark]
        waiting.sort()
        done = [w for w in waiting if w[0] <= mark]
        found, last = settle(group, done, last) if done else ([], last)
        waiting = waiting[len(done) :]
        state.update((last, [t for t, _ in waiting], [v for _, v in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(found, columns=[key, "ts", "out"])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        yield out

    slim = rows.withWatermark(time, delay).select(key, F.col(time).alias("ts"), F.col(value).alias("value"))
    kind = dict(rows.dtypes)[key]
    out = slim.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, out double", "last double, at array<long>, value array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("out", name)


def onsets(rows: DataFrame, threshold: float, gap: float, key: str = "user_id", value: str = "value", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(key, ts, value): rows at or above the threshold, at least ``gap`` seconds after the last kept one of the key, as of :func:`settled`."""

    def settle(group: tuple, done: list[tuple[int, float]], last: float | None) -> tuple[list[tuple], float | None]:
        out = []
        for at, v in done:
            if v >= threshold and (last is None or at / 1e6 - last >= gap):
                out.append((group[0], at, v))
                last = at / 1e6
        return out, last

    return settled(rows, settle, "value", key, value, time, delay)


def changes(rows: DataFrame, key: str = "user_id", value: str = "value", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(key, ts, delta): each row's change against the row before of its key in order of time, 0 for the first, as of :func:`settled`."""

    def settle(group: tuple, done: list[tuple[int, float]], last: float | None) -> tuple[list[tuple], float | None]:
        out = []
        for at, v in done:
            out.append((group[0], at, abs(v - (v if last is None else last))))
            last = v
        return out, last

    return settled(rows, settle, "delta", key, value, time, delay)


def phase_progress(rows: DataFrame, stalled_after_ms: int, key: str = "user_id", phase: str = "event_type", time: str = "ts", delay: str = "1 minute", buckets: int = 1024) -> DataFrame:
    """(key, phase, at, n, stalled): the latest phase of each key as it changes; one more row when none came for so long in event time.

    Spark hands groups to Python one by one, some milliseconds each, so a group is a bucket of keys by their hash: its state is a row of each of its keys, and its timeout that of the key
    that is due first.
    """
    kind = dict(rows.dtypes)[key]

    def follow(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {k: (name, at, n, due) for k, name, at, n, due in zip(*state.get, strict=True)} if state.exists else {}
        newest: dict = {}
        if not state.hasTimedOut:
            for part in parts:
                for k, at, name in zip(part["key"].tolist(), part["at"].tolist(), part["phase"].tolist(), strict=True):
                    seen = newest.get(k)
                    if seen is None:
                        newest[k] = [at, name, 1]
                    else:
                        seen[2] += 1
                        if at >= seen[0]:
                            seen[0], seen[1] = at, name
        out = []
        for k, (micros, phase_name, more) in newest.items():
            name, at, n, _ = held.get(k, ("", 0, 0, 0))
            if micros // 1000 >= at:
                name, at = str(phase_name), micros // 1000
            held[k] = (name, at, n + more, max(at + stalled_after_ms, mark + 1))
            out.append((k, name, at, n + more, False))
        for k in [k for k, row in held.items() if row[3] < mark and k not in newest]:
            out.append((k, *held.pop(k)[:3], True))
        if held:
            state.update(tuple(list(c) for c in zip(*[(k, *row) for k, row in held.items()], strict=True)))
            state.setTimeoutTimestamp(max(min(row[3] for row in held.values()), mark + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "phase", "at", "n", "stalled"])

    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    slim = rows.withWatermark(time, delay).select(bucket, F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(time).alias("at"), F.col(phase).alias("phase"))
    schema = "keys array<string>, phases array<string>, ats array<long>, ns array<long>, dues array<long>"
    found = slim.groupBy("bucket").applyInPandasWithState(follow, "key string, phase string, at long, n long, stalled boolean", schema, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").cast(kind).alias(key), "phase", "at", "n", "stalled")


def earlier(spark: SparkSession, path: str, schema: StructType, batch_id: int, split: str | None = None, parts: list[int] | None = None) -> DataFrame:
    """The rows that batches up to this one left in a table by batch (and by ``split``, of which only some parts are read); none if there is no table yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = StructType([*schema.fields, StructField("batch", LongType()), *([StructField(split, IntegerType())] if split else [])])
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema).drop("batch")
    rows = spark.read.schema(schema).parquet(path).where(F.col("batch") <= batch_id)
    return (rows.where(F.col(split).isin(parts)) if split and parts is not None else rows).drop("batch")


def parts_of(rows: DataFrame, split: str) -> list[int]:
    """Which parts the rows are in: at most as many as there are parts."""
    return [r[0] for r in rows.select(split).distinct().collect()]


def append_new(rows: DataFrame, table: str, checkpoint: str, key: str, parts: int = 256):
    """Starts a query that appends to the table, by batch, the rows whose key no earlier batch brought, however long ago; the first of a batch stays.

    Keys are kept beside the rows, in parts by their hash, and a batch reads the parts of its own keys and no row of the table. A replayed batch replaces itself.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
        fresh = batch.dropDuplicates([key]).select("*", part).persist()
        known = earlier(spark, f"{table}/_keys", fresh.select(key).schema, batch_id - 1, "part", parts_of(fresh, "part"))
        new = fresh.join(known.select(key), key, "left_anti").select(*batch.columns, "part")
        new.drop("part").write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        written = spark.read.schema(batch.schema).parquet(f"{table}/batch={batch_id}")
        written.select(key, part).write.mode("overwrite").partitionBy("part").parquet(f"{table}/_keys/batch={batch_id}")
        fresh.unpersist()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_effective(rows: DataFrame, ledger: str, effective: str, checkpoint: str, key: tuple[str, ...], buckets: int = 64):
    """Starts a query that appends each batch to the ledger (by batch, so a replay replaces itself) and brings what holds now up to date.

    What holds is the best row of a key by (human correction, time, id) among those that no row supersedes (``supersedes``, a list of ids, if there is such a column).
    A correction counts however late it comes. A superseded row is dead whether it came before what supersedes it, with it or after it: the ids met are
    indexed by their hash with the bucket of their key, and so are the ids superseded, so either finds the other in the parts it is in. A key whose row dies falls back to the
    best one left in its bucket of the ledger. A batch reads and writes only the buckets of the keys it touches. :func:`effective_now` reads the result.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")
        part = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("part")

        def put(df: DataFrame, name: str, split: str) -> DataFrame:
            df.write.mode("overwrite").partitionBy(split).parquet(f"{ledger}/{name}/batch={batch_id}")
            return spark.read.schema(StructType([*[f for f in df.schema.fields if f.name != split], StructField(split, IntegerType())])).parquet(f"{ledger}/{name}/batch={batch_id}")

        fresh = put(batch.select("*", bucket), "rows", "bucket")
        ids = put(fresh.select("id", "bucket", part), "ids", "part")
        superseded = F.explode("supersedes") if "supersedes" in columns else F.explode(F.array().cast(f"array<{dict(batch.dtypes)['id']}>"))
        gone = put(fresh.select(superseded.alias("id")).distinct().select("id", part), "superseded", "part")
        known = earlier(spark, f"{ledger}/ids", ids.drop("part").schema, batch_id, "part", parts_of(gone, "part"))
        known_gone = earlier(spark, f"{ledger}/superseded", gone.drop("part").schema, batch_id, "part", parts_of(ids, "part"))
        dying = known.join(gone, "id", "left_semi").unionByName(ids.join(known_gone, "id", "left_semi")).select("id", "bucket").distinct()
        dying = put(dying, "dead", "bucket")
        touched = sorted({*parts_of(fresh, "bucket"), *parts_of(dying, "bucket")})
        dead = earlier(spark, f"{ledger}/dead", dying.drop("bucket").schema, batch_id, "bucket", touched).select("id")
        held = effective_now(spark, effective, batch_id, StructType([*batch.schema.fields])).where(F.col("bucket").isin(touched)).select(*columns, "bucket")
        lost = held.join(dying.select("id"), "id", "left_semi").select(*key, "bucket").distinct().persist()
        same = F.expr(" and ".join(f"l.`{k}` <=> k.`{k}`" for k in ("bucket", *key)))
        others = earlier(spark, f"{ledger}/rows", batch.schema, batch_id, "bucket", parts_of(lost, "bucket")).alias("l").join(lost.alias("k"), same, "left_semi")
        alive = fresh.unionByName(held).unionByName(others.select(*columns, "bucket")).join(dead, "id", "left_anti")
        rest = [c for c in columns if c not in key]
        rank = F.struct((F.col("authority") == "human-correction").alias("h"), "generated_at", "id")
        best = alive.groupBy("bucket", *key).agg(F.max_by(F.struct(*rest), rank).alias("r"))
        best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest], "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{effective}/version={batch_id}")
        # a bucket that lost its last row leaves no file, so which buckets a version has is written too
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{effective}/_touched/batch={batch_id}")
        lost.unpersist()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_versions(spark: SparkSession, effective: str, before: int | None = None) -> dict[int, int]:
    """Of each bucket the last batch that wrote it (before a batch)."""
    touched = earlier_batches(spark, f"{effective}/_touched").where(F.col("batch") < before if before is not None else F.lit(True))
    return {r["bucket"]: r["batch"] for r in touched.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}  # a row a bucket


def earlier_batches(spark: SparkSession, path: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema("bucket int, batch long").parquet(path) if there else spark.createDataFrame([], "bucket int, batch long")


def effective_now(spark: SparkSession, effective: str, before: int | None = None, schema: StructType | None = None) -> DataFrame:
    """What holds now, or held before a batch: of each bucket its latest version; older versions are neither listed nor read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    places = [f"{effective}/version={version}/bucket={bucket}" for bucket, version in sorted(latest_versions(spark, effective, before).items())]
    found = [p for p in places if hadoop.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(p))]
    if not found:
        if schema is None:
            raise ValueError("nothing holds: pass the schema of the rows")
        return spark.createDataFrame([], StructType([*schema.fields, StructField("bucket", IntegerType())]))
    reader = spark.read.option("basePath", effective)
    return (reader.schema(StructType([*schema.fields, StructField("version", LongType()), StructField("bucket", IntegerType())])) if schema else reader).parquet(*found).drop("version")


def drop_old_versions(spark: SparkSession, effective: str, keep: int = 2) -> int:
    """Deletes what :func:`effective_now` does not read any more, but for the last ``keep`` batches, which a restart may replay; returns how many versions of a bucket went."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    rows = [(r["bucket"], r["batch"]) for r in earlier_batches(spark, f"{effective}/_touched").collect()]  # a row a bucket and batch
    last = max((v for _, v in rows), default=0)
    held = set(latest_versions(spark, effective, max(0, last - keep + 1)).items())
    old = [(b, v) for b, v in rows if v <= last - keep and (b, v) not in held]
    for b, v in old:
        place = hadoop.Path(f"{effective}/version={v}/bucket={b}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(old)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet under a folder, and reads the result."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
