"""Queries of the sources, sinks and ledger operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoform.functions import scalar
from chronoform.operators import ledger as L
from chronoform.sources import evidence as E
from chronoform.sources.storage import new_path

from .fixtures import EV, ev, table
from .registry import r6, registered, rounded


@registered("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, true AS has_file FROM orders")
def a1_read_evidence(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "evidence")
    table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.json(path)
    read = E.read_evidence(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    return rounded(read.withColumn("has_file", F.col("file_path").isNotNull()).drop("file_path"))


@registered("SELECT 'projects' AS name, count(*) AS rows FROM region UNION ALL SELECT 'assets', count(*) FROM nation UNION ALL SELECT 'versions', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'jobs', count(*) FROM orders")
def a2_build_catalog(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return E.build_catalog({"projects": (table(spark, d, "region"), "r_regionkey", ("r_name",)), "assets": (table(spark, d, "nation"), "n_nationkey", ("n_name",)), "versions": (orders, "o_custkey", ("o_orderdate", "o_orderkey")), "jobs": (orders, "o_orderkey", ("o_orderdate",))})[1]


@registered("SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def a2_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.keep_latest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice"))


@registered("""WITH r AS (SELECT source AS project, doc_id AS file_id, sha256(coalesce(text, '')) AS sha256 FROM documents), s AS (SELECT DISTINCT sha256(text) AS sha256 FROM benchmark UNION SELECT sha256(text) FROM documents WHERE doc_id % 10 = 3), f AS (SELECT project, sha256, min(file_id) AS asset_id FROM r GROUP BY ALL)
SELECT r.project, file_id, r.sha256, CASE WHEN s.sha256 IS NOT NULL THEN 'refused' WHEN file_id = asset_id THEN 'new' ELSE 'existing' END AS status, coalesce(CASE WHEN s.sha256 IS NULL THEN asset_id END, -1) AS asset_id FROM r JOIN f USING (project, sha256) LEFT JOIN s ON r.sha256 = s.sha256""")
def a3_ingest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sealed = table(spark, d, "benchmark").select("text").unionByName(docs.where("doc_id % 10 = 3").select("text"))
    return E.ingest(docs, sealed, "source", "doc_id", "text").withColumn("asset_id", F.coalesce("asset_id", F.lit(-1)))


@registered("SELECT event_id, 2 AS n_streams, coalesce(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END, -1) AS rate_num, event_type = 'click' AS has_audio, round(value, 6) AS duration FROM events")
def a4_parse_probe(spark: SparkSession, d: str) -> DataFrame:
    rate = F.concat(F.get_json_object("props", "$.k"), F.lit("/25"))
    stream = lambda kind, r: F.struct(kind.alias("codec_type"), r.alias("r_frame_rate"))
    second = F.when(F.col("event_type") == "click", "audio").otherwise("data")
    payload = F.to_json(F.struct(F.struct(F.col("value").cast("string").alias("duration")).alias("format"), F.array(stream(F.lit("video"), rate), stream(second, F.lit("0/0"))).alias("streams")))
    found = E.parse_probe(table(spark, d, "events").withColumn("payload", payload), "payload", "event_id")
    return found.select("event_id", "n_streams", F.coalesce("rate.num", F.lit(-1)).alias("rate_num"), "has_audio", r6("duration").alias("duration"))


@registered("""SELECT page_id, CAST(n - 1 AS INT) AS n, found FROM (SELECT page_id, unnest(m) AS found, generate_subscripts(m, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS m FROM pages))""")
def a5_scrape_log(spark: SparkSession, d: str) -> DataFrame:
    return E.scrape_log(table(spark, d, "pages"), "html", r'href="([^"]*)"', "page_id")


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 11 = 5 THEN 'kept' WHEN o_orderkey % 7 = 1 THEN 'conflict' ELSE 'same' END AS status FROM orders")
def a6_merge_append_only(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 = 0 or o_orderkey % 11 <> 5").withColumn("o_orderstatus", F.when(F.expr("o_orderkey % 7 = 1"), "X").otherwise(F.col("o_orderstatus")))
    return E.merge_append_only(new, o.where("o_orderkey % 3 <> 0"), "o_orderkey")


@registered("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a7_write_report(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "report")
    report = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    E.write_report(report, path, "parquet")
    return spark.read.parquet(path)


@registered(r"""WITH r AS (SELECT source, substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) AS part, concat_ws(' ', doc_id, sha256(coalesce(text, '')), strlen(coalesce(text, ''))) AS line, strlen(coalesce(text, '')) AS size FROM documents),
p AS (SELECT source, part, count(*) AS n, sum(size) AS bytes, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha FROM r GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(bytes) AS BIGINT) AS n_bytes, sha256(string_agg(part || ':' || sha, chr(10) ORDER BY part)) AS tree_sha256 FROM p GROUP BY source""")
def a8_manifest_of(spark: SparkSession, d: str) -> DataFrame:
    return E.manifest_of(table(spark, d, "documents"), "source", "doc_id", "text")


@registered("SELECT DISTINCT p_brand AS document, p_type AS effect, CASE p_type WHEN 'ECONOMY' THEN 'approximated' WHEN 'SMALL' THEN 'full' ELSE 'omitted' END AS support FROM part")
def a9_compatibility_report(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_brand").alias("document"), F.col("p_type").alias("effect"))
    support = parts.select("effect").distinct().where("effect in ('ECONOMY', 'SMALL')").withColumn("support", F.when(F.col("effect") == "ECONOMY", "approximated").otherwise("full"))
    return E.compatibility_report(parts, support, "document", "effect").select("document", "effect", "support")


def hash_sql(*fields: str) -> str:
    """SHA-256 of the fields as canonical JSON."""
    return f"sha256(CAST(json_object({', '.join(f"'{f}', CAST({f} AS VARCHAR)" for f in sorted(fields))}) AS VARCHAR))"


@registered(f"SELECT o_orderkey, {hash_sql('o_custkey', 'o_orderkey', 'o_orderpriority', 'o_orderstatus')} AS digest FROM orders")
def b11_canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", scalar.canonical_hash("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus").alias("digest"))


@registered("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'second only' WHEN o_orderkey % 7 = 0 THEN 'first only' WHEN o_orderkey % 9 = 4 AND o_orderstatus <> 'F' THEN 'changed' ELSE 'same' END AS status FROM orders WHERE o_orderkey % 35 <> 0""")
def b12_replay_equivalence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    changed = o.withColumns({"o_orderdate": F.current_timestamp(), "o_custkey": F.col("o_custkey") + 1, "o_orderstatus": F.when(F.expr("o_orderkey % 9 = 4"), "F").otherwise(F.col("o_orderstatus"))})
    mark = lambda df: L.semantic_fingerprint(df, ("o_orderdate",), {"o_custkey": "asset"})
    return L.replay_equivalence(mark(o.where("o_orderkey % 5 <> 0")), mark(changed.where("o_orderkey % 7 <> 0")), "o_orderkey")


@registered("""SELECT o_orderkey, '{"_redacted_field_count":1,"items":[{"n":' || o_custkey || ',"video-clip":"kept","video_path":"<local-media>"},{"_redacted_field_count":2,"deep":[["<local-path>",' || o_orderkey || ',null]]}],"note":"<redacted>","source":["<local-media>",1],"user":{"files":["<local-path>","' || o_orderstatus || '"],"name":"' || o_orderpriority || '"}}' AS clean FROM orders""")
def b15_redact_nested(spark: SparkSession, d: str) -> DataFrame:
    parts = ['{"user": {"name": "', F.col("o_orderpriority"), '", "files": ["file:///x", "', F.col("o_orderstatus"), '"]}, "API-Key": {"a": 1}, "items": [{"video_path": "x/', F.col("o_orderkey"), '", "n": ', F.col("o_custkey"), ', "video-clip": "kept"}, {"my_Tokens": [1, 2], "Authorization": null, "deep": [["/etc/x", ', F.col("o_orderkey"), ', null]]}], "note": "has a Bearer abc", "source": ["in/a", 1]}']
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return table(spark, d, "orders").select("o_orderkey", L.redact_json(text).alias("clean"))


@registered("SELECT o_orderkey, 'kind=' || o_orderstatus || ';note=<bearer>;file_path=<path>;place=<path>' AS payload, 2 AS n_dropped FROM orders")
def b15_redact(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("kind"), F.col("o_orderstatus"), F.lit("api_key"), F.col("o_orderpriority"), F.lit("note"), F.concat(F.lit("Bearer "), F.col("o_orderkey").cast("string")), F.lit("file_path"), F.lit("x"), F.lit("user_token"), F.lit("y"), F.lit("place"), F.concat(F.lit("/home/"), F.col("o_custkey").cast("string")))
    found = table(spark, d, "orders").select("o_orderkey", L.redact(m).alias("r")).select("o_orderkey", "r.*")
    return found.select("o_orderkey", F.array_join(F.transform(F.map_entries("payload"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("payload"), "n_dropped")


@registered(f"SELECT o_custkey, count(*) AS n, sha256(string_agg({hash_sql('o_orderkey', 'o_orderstatus')}, ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY o_custkey")
def b16_public_projection(spark: SparkSession, d: str) -> DataFrame:
    from chronoform.operators.text import public_projection

    return public_projection(table(spark, d, "orders"), "o_custkey", "o_orderkey", ("o_orderkey", "o_orderstatus"))


LEDGER = """ledger AS (SELECT o_orderkey AS id, o_custkey % 500 AS asset_id, CASE WHEN o_orderkey % 9 = 0 THEN 'analysis.failure' ELSE 'kind' || o_custkey % 3 END AS kind, CASE WHEN o_orderkey % 13 = 0 THEN 'human-correction' ELSE 'measured' END AS authority,
 'f' || o_orderkey % 2 AS failed_kind, o_orderdate AS generated_at, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 10 = 7 THEN o_orderkey + 100000000 END AS sup FROM orders)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 500).alias("asset_id"), F.when(k % 9 == 0, "analysis.failure").otherwise(F.concat(F.lit("kind"), (F.col("o_custkey") % 3).cast("string"))).alias("kind"),
        F.when(k % 13 == 0, "human-correction").otherwise("measured").alias("authority"), F.concat(F.lit("f"), (k % 2).cast("string")).alias("failed_kind"), F.col("o_orderdate").alias("generated_at"),
        F.when(k % 4 == 0, F.array(k + 1)).when(k % 10 == 7, F.array(k + 100000000)).otherwise(F.array().cast("array<bigint>")).alias("supersedes"),
    )


@registered(f"""WITH {LEDGER}, alive AS (SELECT * FROM ledger WHERE id NOT IN (SELECT sup FROM ledger WHERE sup IS NOT NULL))
SELECT asset_id, kind, id, authority FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, kind, CASE WHEN kind = 'analysis.failure' THEN failed_kind END ORDER BY authority = 'human-correction' DESC, generated_at DESC, id DESC) AS n FROM alive) WHERE n = 1""")
def e1_effective_evidence(spark: SparkSession, d: str) -> DataFrame:
    return L.effective_evidence(ledger(spark, d)).select("asset_id", "kind", "id", "authority")


@registered(f"""WITH {LEDGER} SELECT a.id, a.sup AS superseded, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'mismatch' END AS problem FROM ledger a LEFT JOIN ledger b ON a.sup = b.id WHERE a.sup IS NOT NULL AND (b.id IS NULL OR a.asset_id <> b.asset_id OR a.kind <> b.kind)""")
def e2_validate_supersession(spark: SparkSession, d: str) -> DataFrame:
    return L.validate_supersession(ledger(spark, d))


@registered("""WITH i AS (SELECT source, sha256(text) AS digest FROM documents), f AS (SELECT DISTINCT sha256(text) AS digest FROM documents WHERE doc_id % 97 = 5 UNION SELECT sha256(text) FROM benchmark), a AS (SELECT DISTINCT sha256(text) AS digest FROM documents WHERE lang <> 'es')
SELECT source, count(*) AS n, count(f.digest) AS n_forbidden, CAST(sum(CASE WHEN a.digest IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown, count(f.digest) = 0 AND sum(CASE WHEN a.digest IS NULL THEN 1 ELSE 0 END) = 0 AS ok FROM i LEFT JOIN f ON i.digest = f.digest LEFT JOIN a ON i.digest = a.digest GROUP BY source""")
def e13_lineage_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("digest", F.sha2("text", 256))
    sealed = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("digest")).unionByName(docs.where("doc_id % 97 = 5").select("digest"))
    return L.lineage_gate(docs, sealed, docs.where("lang <> 'es'"), "source", "digest")


@registered("""WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS asset_id, o_orderpriority AS cache_key, o_orderdate AS finished_at FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey AS asset_id, p.o_orderpriority AS cache_key, coalesce((SELECT job_id FROM j WHERE j.asset_id = c_custkey AND j.cache_key = p.o_orderpriority ORDER BY finished_at DESC, job_id DESC LIMIT 1), -1) AS cached_job FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) p""")
def e16_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("asset_id"), F.col("o_orderpriority").alias("cache_key"), F.col("o_orderdate").alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"))
    keys = jobs.select("cache_key", F.lit(1).alias("one")).distinct()  # the priorities, five
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.lit(1).alias("one")).join(F.broadcast(keys), "one").drop("one")
    return L.cache_lookup(requests, jobs, ("asset_id", "cache_key")).withColumn("cached_job", F.coalesce("cached_job", F.lit(-1)))


@registered("SELECT doc_id // 10 AS job_id, doc_id AS path, CASE WHEN doc_id % 17 = 3 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 17 = 3 OR doc_id % 19 = 4")
def e17_checkpoint_verify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    recorded = docs.groupBy(F.floor(F.col("path") / 10).alias("job_id")).agg(F.collect_list(F.struct("path", "sha256")).alias("artifacts"))
    current = docs.where("path % 17 <> 3").withColumn("sha256", F.when(F.expr("path % 19 = 4"), "x").otherwise(F.col("sha256")))
    return L.checkpoint_verify(recorded, current, "job_id")


@registered("""WITH r AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), q AS (SELECT o_custkey AS k, max(CASE WHEN o_orderpriority < '4' THEN 'pass' ELSE 'fail' END) AS s FROM orders GROUP BY 1)
SELECT c_custkey AS k, coalesce(r.s, 'missing') AS render, coalesce(q.s, 'missing') AS quality, coalesce(r.s, '') = 'pass' AND coalesce(q.s, '') = 'pass' AS covered FROM customer LEFT JOIN r ON c_custkey = r.k LEFT JOIN q ON c_custkey = q.k""")
def e18_proof_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    status = lambda c: F.when(c, "pass").otherwise("fail").alias("status")
    receipts = {"render": o.where("o_orderkey % 2 = 0").select("k", status(F.col("o_orderstatus") == "F")), "quality": o.select("k", status(F.col("o_orderpriority") < "4"))}
    return L.proof_join(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), receipts, "k")


@registered("""WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate - INTERVAL 1 DAY * (o_orderkey % 2) END AS b, o_orderkey % 4 / 3.0 AS progress, CASE WHEN o_orderkey % 6 <> 0 THEN 'e' END AS error FROM orders)
SELECT job_id, unnest([x FOR x IN [CASE WHEN status IN ('running', 'succeeded', 'failed') AND a IS NULL THEN 'started without start' END, CASE WHEN status = 'queued' AND a IS NOT NULL THEN 'queued with start' END, CASE WHEN status IN ('succeeded', 'failed') AND b IS NULL THEN 'finished without end' END,
 CASE WHEN b < a THEN 'end before start' END, CASE WHEN status = 'succeeded' AND progress < 1 THEN 'succeeded below 1' END, CASE WHEN status = 'failed' AND error IS NULL THEN 'failed without error' END] IF x IS NOT NULL]) AS problem FROM j""")
def f20_job_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    jobs = table(spark, d, "orders").select(
        k.alias("job_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued").alias("status"), F.when(k % 3 != 0, day).alias("started_at"),
        F.when(k % 5 != 0, F.when(k % 2 == 1, day - F.expr("interval 1 day")).otherwise(day)).alias("finished_at"), (k % 4 / 3.0).alias("progress"), F.when(k % 6 != 0, "e").alias("error"),
    )
    return L.job_lifecycle(jobs)


@registered(f"WITH {EV} SELECT series_id, arg_max(kind, {{'t': ts, 'e': event_id}}) AS state, count(*) AS n, string_agg(kind, '>' ORDER BY ts, event_id) AS history FROM ev GROUP BY series_id")
def f21_state_rollup(spark: SparkSession, d: str) -> DataFrame:
    return L.state_rollup(ev(spark, d), "series_id", "kind", "ts", "event_id")


@registered("""WITH b AS (SELECT o_orderpriority AS technique, o_custkey AS case_id, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL), h AS (SELECT DISTINCT o_orderpriority AS technique, o_custkey AS case_id FROM orders WHERE o_orderkey % 4 = 1), v AS (SELECT o_orderpriority AS technique, max(o_custkey % 12) AS rev FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1),
c AS (SELECT b.technique, h.case_id IS NULL AND n = 1 AS fresh FROM b LEFT JOIN h USING (technique, case_id)), s AS (SELECT technique, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) AS BIGINT) AS n_new, CAST(sum(CASE WHEN fresh THEN 0 ELSE 1 END) AS BIGINT) AS n_repeated FROM c GROUP BY 1)
SELECT s.technique, n_new, n_repeated, CAST(coalesce(rev, 0) + CASE WHEN n_new > 0 THEN 1 ELSE 0 END AS BIGINT) AS revision FROM s LEFT JOIN v USING (technique)""")
def f22_transfer_history(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("technique"), F.col("o_custkey").alias("case_id"), "o_orderkey")
    return L.transfer_history(o.where("o_orderkey % 4 = 0"), o.where("o_orderkey % 4 = 1").withColumn("revision", F.col("case_id") % 12), "case_id", "technique")


@registered("""WITH p AS (SELECT p_partkey, p_size / 10.0 AS mx, p_size / 20.0 AS mn, p_retailprice / 2000 AS fit FROM part), u AS (SELECT *, fit * (mx + (mx - mn) * 0.1) AS upscale FROM p)
SELECT p_partkey, CAST((CASE WHEN upscale <= 2 THEN 0 ELSE 1 END) + (CASE WHEN mx < 4.5 THEN 0 ELSE 1 END) + (CASE WHEN fit >= 0.5 THEN 0 ELSE 1 END) AS INT) AS n_failed, coalesce(CASE WHEN upscale > 2 THEN 'upscale' WHEN mx >= 4.5 THEN 'zoom' WHEN fit < 0.5 THEN 'fit' END, '') AS refusal FROM u""")
def b25_applicability(spark: SparkSession, d: str) -> DataFrame:
    mx, mn, fit = F.col("p_size") / 10.0, F.col("p_size") / 20.0, F.col("p_retailprice") / 2000
    found = L.applicability(table(spark, d, "part"), {"upscale": fit * (mx + (mx - mn) * 0.1) <= 2, "zoom": mx < 4.5, "fit": fit >= 0.5}, "p_partkey")
    return found.withColumn("refusal", F.coalesce("refusal", F.lit("")))


@registered("""WITH a AS (SELECT o_orderkey AS asset_id, CAST(floor(o_totalprice / 20) AS BIGINT) AS frames, 25.0 AS fps, (o_custkey % 20 + 1) * 100000 AS frame_bytes, o_orderkey % 5 AS pins FROM orders), p(profile, speed, cap, retained, dense, quick) AS (VALUES ('quick', 160.0, 64, 24, false, true), ('structural', 90.0, 256, 96, false, false), ('semantic', 45.0, 384, 128, false, false), ('motion', 16.0, 512, 192, true, false), ('reconstruct', 12.0, 768, 256, true, false)),
x AS (SELECT *, CASE WHEN quick THEN least(frames, 48 + pins) ELSE frames END AS decoded FROM a, p), y AS (SELECT *, least(cap * 1048576, greatest(8388608, decoded * 98304)) AS artifact_bytes, greatest(536870912, CAST(round_even((402653184 + frame_bytes * 8 + frame_bytes * least(frames, retained + pins) + CASE WHEN dense THEN floor(frame_bytes * frames / 3) ELSE 0 END) * 1.25, 0) AS BIGINT)) AS peak_bytes FROM x)
SELECT asset_id, profile, decoded, round(greatest(0.05, decoded / speed), 6) AS seconds, artifact_bytes, peak_bytes, artifact_bytes + peak_bytes + 536870912 AS required_bytes, artifact_bytes + peak_bytes + 536870912 <= 4000000000 AS admitted, concat_ws(',', CASE WHEN frames / fps >= 300 THEN 'long source' END, CASE WHEN dense THEN 'decodes every frame' END, CASE WHEN quick THEN 'approximate' END) AS warnings FROM y""")
def b24_capacity_report(spark: SparkSession, d: str) -> DataFrame:
    assets = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.floor(F.col("o_totalprice") / 20).alias("frames"), F.lit(25.0).alias("fps"), ((F.col("o_custkey") % 20 + 1) * 100000).alias("frame_bytes"), (F.col("o_orderkey") % 5).alias("pins"))
    return rounded(L.capacity_report(assets, 4_000_000_000))
