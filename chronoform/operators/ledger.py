"""The append-only ledger: supersession, authority, lineage, caches, lifecycles and gates."""

from __future__ import annotations

import json
import re
from functools import reduce
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoform.functions.scalar import stripped


def effective_evidence(evidence: DataFrame) -> DataFrame:
    """What holds now: rows that no other supersedes, and of each (asset, kind) the human correction first, then the latest, then the largest id.

    Rows of kind analysis.failure are told apart by the kind that failed. Nothing is deleted from the ledger.
    """
    gone = evidence.select(F.explode("supersedes").alias("id")).distinct()
    rows = evidence.join(gone, "id", "left_anti").withColumn("__failed", F.when(F.col("kind") == "analysis.failure", F.col("failed_kind")))
    rank = F.struct((F.col("authority") == "human-correction").alias("h"), "generated_at", "id")
    rest = [c for c in evidence.columns if c not in ("asset_id", "kind")]
    best = rows.groupBy("asset_id", "kind", "__failed").agg(F.max_by(F.struct(*rest), rank).alias("__r"))
    return best.select("asset_id", "kind", *[F.col(f"__r.{c}").alias(c) for c in rest])


def validate_supersession(evidence: DataFrame) -> DataFrame:
    """(id, superseded, problem): references that do not exist, or are of another asset or kind."""
    refs = evidence.select("id", "asset_id", "kind", F.explode("supersedes").alias("superseded"))
    known = evidence.select(F.col("id").alias("superseded"), F.col("asset_id").alias("__a"), F.col("kind").alias("__k"), F.lit(True).alias("__there"))
    problem = F.when(F.col("__there").isNull(), "missing").when((F.col("asset_id") != F.col("__a")) | (F.col("kind") != F.col("__k")), "mismatch")
    return refs.join(known, "superseded", "left").select("id", "superseded", problem.alias("problem")).where("problem is not null")


def lineage_gate(inputs: DataFrame, forbidden: DataFrame, allowed: DataFrame, group: str, digest: str) -> DataFrame:
    """(group, n, n_forbidden, n_unknown, ok): inputs of a group must be of the allowed hashes, and none forbidden."""
    f, a = forbidden.select(digest).distinct().withColumn("__f", F.lit(1)), allowed.select(digest).distinct().withColumn("__a", F.lit(1))
    rows = inputs.join(f, digest, "left").join(a, digest, "left")
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.count("__f").alias("n_forbidden"), F.sum(F.col("__a").isNull().cast("long")).alias("n_unknown"))
    return out.withColumn("ok", (F.col("n_forbidden") == 0) & (F.col("n_unknown") == 0))


def forbidden_mentions(payloads: DataFrame, forbidden: DataFrame, key: str, text: str, digest: str, length: int = 64) -> DataFrame:
    """(key, digest): forbidden hashes that stand anywhere in a payload's text, whatever is around them.

    Hashes are hexadecimal of a fixed length, so a text is cut into its runs of such digits and each window of that length meets the hashes by an
    equi-join; no text is compared with every hash.
    """
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"([0-9a-f]{{{length},}})"), F.lit(1))
    windows = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - length + 1), lambda i: F.substr(r, i, F.lit(length)))))
    found = payloads.select(key, F.explode(F.array_distinct(windows)).alias(digest))
    return found.join(forbidden.select(F.lower(F.col(digest)).alias(digest)).distinct(), digest).select(key, digest)


def cache_lookup(requests: DataFrame, jobs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """requests with the succeeded job of the same key, the last finished (then the largest id); null: a miss."""
    hit = jobs.where("status = 'succeeded'").groupBy(*key).agg(F.max(F.struct("finished_at", "job_id"))["job_id"].alias("cached_job"))
    return requests.join(hit, list(key), "left")


def checkpoint_verify(recorded: DataFrame, current: DataFrame, key: str, artifacts: str = "artifacts") -> DataFrame:
    """(key, path, problem): recorded artifact hashes that are gone or have changed; artifacts is array<struct<path, sha256>>."""
    rows = recorded.select(key, F.inline(artifacts))
    now = current.select("path", F.col("sha256").alias("__now"))
    problem = F.when(F.col("__now").isNull(), "missing").when(F.col("__now") != F.col("sha256"), "changed")
    return rows.join(now, "path", "left").select(key, "path", problem.alias("problem")).where("problem is not null")


def proof_join(requirements: DataFrame, receipts: dict[str, DataFrame], key: str) -> DataFrame:
    """requirements with the status of every named receipt of the same hash (missing if none), and ``covered`` if all pass."""
    rows = requirements
    for name, df in receipts.items():
        rows = rows.join(df.groupBy(key).agg(F.max("status").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit("missing")))
    return rows.withColumn("covered", reduce(lambda a, b: a & b, [F.col(n) == "pass" for n in receipts]))


def semantic_fingerprint(df: DataFrame, volatile: tuple[str, ...], constants: dict[str, str] | None = None) -> DataFrame:
    """df with ``fingerprint``: SHA-256 of its columns as JSON, sorted by name, without volatile fields and with references made constant, at any depth."""
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    clean = stripped(whole, df.schema, frozenset(volatile), constants or {})
    return df.withColumn("fingerprint", F.sha2(F.to_json(clean, {"ignoreNullFields": "false"}), 256))


def replay_equivalence(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, status): same, changed, or in one run only, by fingerprint."""
    a, b = first.select(key, F.col("fingerprint").alias("__a")), second.select(key, F.col("fingerprint").alias("__b"))
    status = F.when(F.col("__a").isNull(), "second only").when(F.col("__b").isNull(), "first only").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def redact(payload: Column, secret: str = r"(?i)(secret|token|password|api_?key)", path: str = r"^(/|[A-Za-z]:\\)", bearer: str = r"(?i)^bearer\s") -> Column:
    """struct<payload, n_dropped> of a string map: secret-named keys are dropped and counted, paths and bearer strings replaced."""
    kept = F.map_filter(payload, lambda k, v: ~F.rlike(k, F.lit(secret)))
    clean = F.transform_values(kept, lambda k, v: F.when(F.rlike(v, F.lit(path)) | k.endswith("path"), "<path>").when(F.rlike(v, F.lit(bearer)), "<bearer>").otherwise(v))
    return F.struct(clean.alias("payload"), (F.size(F.map_keys(payload)) - F.size(F.map_keys(kept))).alias("n_dropped"))


# Names of fields that hold secrets, and parts of such names; names of fields that hold media, and parts of such names; marks.
SECRET_FIELDS, SECRET_PARTS = ("api_key", "apikey", "authorization", "password", "secret", "token"), ("password", "secret", "token")
MEDIA_FIELDS, MEDIA_PARTS = ("audio", "file", "image", "media", "media_path", "path", "source", "video"), ("_path", "_file", "_media")
COUNT_FIELD, MEDIA_MARK, PATH_MARK, SECRET_MARK, DEEP_MARK = "_redacted_field_count", "<local-media>", "<local-path>", "<redacted>", "<too deep>"


#: Characters that JSON escapes by number, where the writers of Spark and Python differ in the case of its digits.
UPPER_ESCAPED = re.compile("[\x0b\x0e\x0f\x1a-\x1f]")


class Plain(str):
    """A number as it is written."""


def json_string(s: str) -> str:
    if UPPER_ESCAPED.search(s):
        return '"' + "".join(f"\\u{ord(c):04X}" if UPPER_ESCAPED.match(c) else encode_basestring(c)[1:-1] for c in s) + '"'
    return encode_basestring(s)


def named(name: str, names: tuple[str, ...], parts: tuple[str, ...]) -> bool:
    return name in names or any(p in name for p in parts)


def redacted(v: object, name: str, left: int) -> str:
    """The JSON text of a value without its secrets; objects are lists of (key, value) in a tuple."""
    if isinstance(v, Plain):
        return v
    if isinstance(v, str):
        if named(name, MEDIA_FIELDS, MEDIA_PARTS):
            return f'"{MEDIA_MARK}"'
        if v.startswith(("/", "file://")):
            return f'"{PATH_MARK}"'
        low = v.lower()
        return f'"{SECRET_MARK}"' if "bearer " in low or "sk-proj-" in low else json_string(v)
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if not left:
        return f'"{DEEP_MARK}"'
    if isinstance(v, list):
        return "[" + ",".join([redacted(x, name, left - 1) for x in v]) + "]"
    lows = [(k, k.lower().replace("-", "_"), x) for k, x in v]
    kept = [(k, low, x) for k, low, x in lows if not named(low, SECRET_FIELDS, SECRET_PARTS)]
    gone = len(lows) - len(kept)
    out = [(k, f"{json_string(k)}:{redacted(x, low, left - 1)}") for k, low, x in kept if not (gone and k == COUNT_FIELD)]
    if gone:  # its place among keys in order
        out.insert(sum(k < COUNT_FIELD for k, _ in out), (COUNT_FIELD, f'"{COUNT_FIELD}":{gone}'))
    return "{" + ",".join([x for _, x in out]) + "}"


def redact_json(payload: Column, depth: int = 8) -> Column:
    """A JSON text (or null) with its secrets taken out, keys in order; null if it is no JSON.

    In objects and lists at any place: fields with a secret's name go, and their object says how many; strings in fields that hold media, and in lists there, become
    a mark, and so do absolute paths, file URIs, and strings that hold a bearer token or a key. Containers more than ``depth`` deep become a mark too, so nothing is let
    through unseen. What is JSON, how its numbers are written (one beyond a double as the string "Infinity") and the order of keys are those of VARIANT; one walk over each text takes the secrets out. Nested
    lambdas over VARIANT values are evaluated tree by tree without generated code, which takes several times as long.
    """

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        decode = json.JSONDecoder(object_pairs_hook=tuple, parse_float=Plain, parse_int=Plain, parse_constant=Plain).decode
        return pa.array([None if t is None else redacted(decode(t), "", depth) for t in texts.to_pylist()], pa.string())

    return clean(F.to_json(F.try_parse_json(payload)))


def job_lifecycle(jobs: DataFrame) -> DataFrame:
    """(job_id, problem): what a job's status does not allow."""
    s = F.col("status")
    rules = {
        "started without start": s.isin("running", "succeeded", "failed") & F.col("started_at").isNull(),
        "queued with start": (s == "queued") & F.col("started_at").isNotNull(),
        "finished without end": s.isin("succeeded", "failed") & F.col("finished_at").isNull(),
        "end before start": F.col("finished_at") < F.col("started_at"),
        "succeeded below 1": (s == "succeeded") & (F.col("progress") < 1.0),
        "failed without error": (s == "failed") & F.col("error").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return jobs.select("job_id", F.explode(found).alias("problem"))


def state_rollup(log: DataFrame, key: str, state: str, at: str, event_id: str) -> DataFrame:
    """(key, state, n, history): the latest state and all of them in order. Aggregated; a key has as many states as its log has rows."""
    moment = F.struct(F.col(at), F.col(event_id), F.col(state).alias("state"))
    out = log.groupBy(key).agg(F.max(moment)["state"].alias("state"), F.count("*").alias("n"), F.array_sort(F.collect_list(moment)).alias("__h"))
    return out.select(key, "state", "n", F.array_join(F.col("__h.state"), ">").alias("history"))


def transfer_history(batch: DataFrame, history: DataFrame, case: str, technique: str) -> DataFrame:
    """(technique, n_new, n_repeated, revision): case ids that repeat in the batch or in history are refused; a batch with new ones is one revision."""
    counts = batch.groupBy(technique, case).agg(F.count("*").alias("n"))
    old = history.select(technique, case).distinct().withColumn("__old", F.lit(True))
    rows = counts.join(old, [technique, case], "left")
    fresh = F.col("__old").isNull() & (F.col("n") == 1)
    out = rows.groupBy(technique).agg(F.sum(fresh.cast("long")).alias("n_new"), F.sum((~fresh).cast("long")).alias("n_repeated"))
    last = history.groupBy(technique).agg(F.max("revision").alias("__rev"))
    return out.join(last, technique, "left").select(technique, "n_new", "n_repeated", (F.coalesce("__rev", F.lit(0)) + F.when(F.col("n_new") > 0, 1).otherwise(0)).cast("long").alias("revision"))


def applicability(df: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, n_failed, refusal): the code of the first check that fails, null if none does."""
    failed = F.filter(F.array(*[F.struct(F.lit(code).alias("code"), F.coalesce(ok, F.lit(False)).alias("ok")) for code, ok in checks.items()]), lambda c: ~c["ok"])
    return df.select(*keys, F.size(failed).alias("n_failed"), F.get(F.transform(failed, lambda c: c["code"]), F.lit(0)).alias("refusal"))


PROFILES = "profile string, speed double, artifact_mib long, retained long, dense boolean, quick boolean"
#: Planning constants by profile.
PROFILE_ROWS = (("quick", 160.0, 64, 24, False, True), ("structural", 90.0, 256, 96, False, False), ("semantic", 45.0, 384, 128, False, False), ("motion", 16.0, 512, 192, True, False), ("reconstruct", 12.0, 768, 256, True, False))


def capacity_report(assets: DataFrame, free_bytes: int) -> DataFrame:
    """Each asset (asset_id, frames, fps, frame_bytes, pins) under each profile: decoded frames, seconds, bytes, whether it is admitted, warnings."""
    mib = 1 << 20
    profiles = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("profile", "speed", "cap", "retained", "dense", "quick"), row, strict=True)]) for row in PROFILE_ROWS])
    rows = assets.select("*", F.inline(profiles))
    rows = rows.withColumn("decoded", F.when(F.col("quick"), F.least(F.col("frames"), 48 + F.col("pins"))).otherwise(F.col("frames")).cast("long"))
    kept = F.col("frame_bytes") * F.least(F.col("frames"), F.col("retained") + F.col("pins"))
    dense = F.when(F.col("dense"), F.floor(F.col("frame_bytes") * F.col("frames") / 3)).otherwise(0)
    rows = rows.withColumns({
        "seconds": F.greatest(F.lit(0.05), F.col("decoded") / F.col("speed")),
        "artifact_bytes": F.least(F.col("cap").cast("long") * mib, F.greatest(F.lit(8 * mib), F.col("decoded") * 96 * 1024)),
        "peak_bytes": F.greatest(F.lit(512 * mib), F.bround((384 * mib + F.col("frame_bytes") * 8 + kept + dense) * 1.25).cast("long")),
    })
    rows = rows.withColumn("required_bytes", F.col("artifact_bytes") + F.col("peak_bytes") + 512 * mib)
    warnings = F.array_compact(F.array(F.when(F.col("frames") / F.col("fps") >= 300, "long source"), F.when(F.col("dense"), "decodes every frame"), F.when(F.col("quick"), "approximate")))
    return rows.withColumns({"admitted": F.col("required_bytes") <= free_bytes, "warnings": F.array_join(warnings, ",")}).select("asset_id", "profile", "decoded", "seconds", "artifact_bytes", "peak_bytes", "required_bytes", "admitted", "warnings")


def latest_per(df: DataFrame, key: tuple[str, ...], *order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order]))).where("__n = 1").drop("__n")
