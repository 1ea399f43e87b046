"""Queries of what the operators do beside their headline use: checks, defaults, variants and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoform.operators import grouped as G
from chronoform.operators import intervals as I
from chronoform.operators import joins as J
from chronoform.operators import ledger as L
from chronoform.operators import sampling as P
from chronoform.operators import scorecards as K
from chronoform.operators import series as S
from chronoform.operators import surface
from chronoform.operators import text as T
from chronoform.sources import evidence as E
from chronoform.sources.storage import new_path

from .fixtures import CONV, EMB, EV, FEAT, SPANS, conv, ev, feat, intervals, table, vectors
from .registry import ORACLE, registered, rounded
from .scorecard_queries import ALIGNED, aligned
from .series_queries import SEGMENTS, W, bounds, grad, peaks, segments


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN o_orderkey % 3 = 1 THEN 'same' ELSE 'new' END AS status, true AS stored FROM orders")
def a6_append_only(spark: SparkSession, d: str) -> DataFrame:
    o, path = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), new_path(spark, "ledger")
    E.append_only(spark, o.where("o_orderkey % 3 < 2"), path, "o_orderkey")
    status = E.append_only(spark, o.where("o_orderkey % 3 > 0"), path, "o_orderkey")
    return status.join(spark.read.parquet(path).select("o_orderkey", F.lit(True).alias("stored")), "o_orderkey", "left")


@registered(f"""WITH {EMB}, e AS (SELECT series_id, seq, [abs(x[i + 1] - x[i]) FOR i IN generate_series(1, 63) IF i % 8 <> 0] AS e FROM emb), p AS (SELECT *, lag(e) OVER (PARTITION BY series_id ORDER BY seq) AS b FROM e)
SELECT series_id, seq, round(CASE WHEN b IS NULL THEN 0 ELSE list_sum([abs(e[i] - b[i]) FOR i IN generate_series(1, 56)]) / 56 END, 6) AS edge_change FROM p""")
def b2_edge_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.adjacent_deltas(vectors(spark, d)).select("series_id", "seq", "edge_change"))


@registered("""WITH l AS (SELECT l_orderkey, to_json(list({'l_linenumber': CAST(l_linenumber AS VARCHAR), 'l_partkey': 'part'} ORDER BY l_linenumber, l_partkey, l_suppkey)) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, sha256('{"head":{"o_custkey":"' || o_custkey || '","o_orderstatus":"' || o_orderstatus || '"},"lines":' || lines || ',"o_orderkey":"' || o_orderkey || '"}') AS fingerprint FROM orders JOIN l ON o_orderkey = l_orderkey""")
def b12_nested_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    docs = table(spark, d, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_orderdate", "o_custkey").alias("head")).join(lines, "o_orderkey")
    return L.semantic_fingerprint(docs, ("l_suppkey", "l_shipdate", "o_orderdate"), {"l_partkey": "part"}).select("o_orderkey", "fingerprint")


@registered("""WITH c AS (SELECT conv_id, turn FROM conversations)
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'speed:' || (turn + 1) || '.50' WHEN 1 THEN 'background:#ffffff,duration:' || CAST(greatest(1, round_even((turn + 0.2) * 25, 0)) AS BIGINT) WHEN 2 THEN 'enabled:false,pinned:false' WHEN 3 THEN 'enabled:true,pinned:true' ELSE 'duration:100' END AS intents, '' AS error FROM c""")
def b23_tag_commands_russian(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("turn") % 5, F.col("turn")
    cmd = F.when(k == 0, F.concat(F.lit("Поставь скорость до "), (t + 1).cast("string"), F.lit(".5x"))).when(k == 1, F.concat(F.lit("белый фон, длительность "), t.cast("string"), F.lit(",2"))).when(k == 2, "отключи, открепи").when(k == 3, "Включи и закрепи").otherwise("duration = 4")
    found = T.tag_commands(table(spark, d, "conversations").withColumn("cmd", cmd), "cmd")
    return found.select("conv_id", "turn", F.array_join("intents", ",").alias("intents"), F.coalesce("error", F.lit("")).alias("error"))


@registered(f"""WITH {EV}, p AS (SELECT series_id, seq, signal + seq * 0.02 AS x, edge - seq * 0.01 AS y, signal AS s, edge * 40 AS r FROM ev),
a AS (SELECT series_id, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1, arg_min(s, seq) AS s0, arg_max(s, seq) AS s1, arg_min(r, seq) AS r0, arg_max(r, seq) AS r1, min(s) AS ls, max(s) AS hs, min(r) AS lr, max(r) AS hr FROM p GROUP BY 1),
q AS (SELECT p.series_id, CASE WHEN pow(x1 - x0, 2) + pow(y1 - y0, 2) > 1e-12 THEN ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)) ELSE 0 END AS t FROM p JOIN a USING (series_id)), m AS (SELECT series_id, min(t) AS lo, max(t) AS hi FROM q GROUP BY 1),
f AS (SELECT series_id, ls < least(s0, s1) - 0.3 OR hs > greatest(s0, s1) + 0.3 AS by_scale, lr < least(r0, r1) - 9 OR hr > greatest(r0, r1) + 9 AS by_rotation, lo < -0.35 OR hi > 1.35 AS by_centre FROM a JOIN m USING (series_id))
SELECT *, by_scale OR by_rotation OR by_centre AS overshoot FROM f""")
def c23_path_overshoot(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).select("series_id", "seq", (F.col("signal") + F.col("seq") * 0.02).alias("x"), (F.col("edge") - F.col("seq") * 0.01).alias("y"), F.col("signal").alias("s"), (F.col("edge") * 40).alias("r"))
    return S.path_overshoot(e, "x", "y", "s", "r", 0.3, 9.0, 0.35)


MOVES = f"{EV}, mv AS (SELECT series_id, seq, CAST(seq // 12 AS BIGINT) AS segment, (signal - 0.25) / 100 AS dx, (edge - 0.5) / 300 AS dy, 1 + (signal - edge / 2) / 200 AS scale, edge / 8 - 0.05 AS rotation, signal / 1000 AS magnitude, edge < 0.7 AS found FROM ev)"


def moves(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    return e.select("series_id", "seq", F.floor(F.col("seq") / 12).alias("segment"), ((F.col("signal") - 0.25) / 100).alias("dx"), ((F.col("edge") - 0.5) / 300).alias("dy"), (1 + (F.col("signal") - F.col("edge") / 2) / 200).alias("scale"), (F.col("edge") / 8 - 0.05).alias("rotation"), (F.col("signal") / 1000).alias("magnitude"), (F.col("edge") < 0.7).alias("found"))


@registered(f"""WITH {MOVES}, m AS (SELECT series_id, segment, median(dx) FILTER (WHERE found) AS a, median(dy) FILTER (WHERE found) AS b, median(scale) FILTER (WHERE found) AS c, median(rotation) FILTER (WHERE found) AS r FROM mv GROUP BY ALL)
SELECT series_id, segment, concat_ws(',', CASE WHEN abs(a) >= 0.0005 THEN 'pan' END, CASE WHEN abs(b) >= 0.0005 THEN 'tilt' END, CASE WHEN abs(c - 1) >= 0.0005 THEN 'zoom' END, CASE WHEN abs(r) >= 0.03 THEN 'rotation' END) AS hypotheses FROM m""")
def c25_camera_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return S.camera_hypotheses(moves(spark, d), "found").withColumn("hypotheses", F.array_join("hypotheses", ","))


@registered(f"""WITH {MOVES}, s AS (SELECT series_id, segment, min(seq) AS a, max(seq) + 1 AS b, arg_max(seq, {{'m': magnitude, 's': -seq}}) AS top FROM mv GROUP BY ALL), q AS (SELECT *, b - a AS n FROM s WHERE b - a >= 4),
p AS (SELECT series_id, segment, top, unnest([{{'role': 'onset', 'x': a, 'y': a + n // 4}}, {{'role': 'development', 'x': a + n // 4, 'y': a + n // 2}}, {{'role': 'peak', 'x': a + n // 2, 'y': a + 3 * n // 4}}, {{'role': 'settle', 'x': a + 3 * n // 4, 'y': b}}]) AS u FROM q)
SELECT series_id, segment, u.role AS role, CAST(u.x AS BIGINT) AS "start", CAST(u.y AS BIGINT) AS "end", CASE WHEN u.role = 'peak' AND top >= u.x AND top < u.y THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM p""")
def c25_quarter_phases(spark: SparkSession, d: str) -> DataFrame:
    m = moves(spark, d)
    spans = m.groupBy("series_id", "segment").agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"))
    return S.quarter_phases(m, spans, "magnitude")


BIND = "b AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey % 3 AS grp, l_suppkey % 2 AS f0, (l_partkey + l_suppkey) % 2 AS f1, l_linenumber % 3 AS part, 1 + (l_linenumber + l_partkey) % 2 AS seg FROM lineitem)"


def bindings(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", order.alias("n"), (k % 3).alias("grp"), (s % 2).alias("f0"), ((k + s) % 2).alias("f1"), (n % 3).alias("part"), (1 + (n + k) % 2).alias("seg"))


@registered(f"WITH {BIND}, p AS (SELECT *, lag(grp) OVER w AS g, lag(f1) OVER w AS f FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)) SELECT l_orderkey, CAST(n AS INT) AS n FROM p WHERE g = grp AND f IS DISTINCT FROM f0")
def c34_focus_breaks(spark: SparkSession, d: str) -> DataFrame:
    return S.focus_breaks(bindings(spark, d), "l_orderkey", "n", "grp", "f0", "f1").select("l_orderkey", "n")


@registered(f"""WITH {BIND}, r AS (SELECT *, sum(CASE WHEN part IS DISTINCT FROM lp THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n) AS run FROM (SELECT *, lag(part) OVER (PARTITION BY l_orderkey ORDER BY n) AS lp FROM b)),
e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, run ORDER BY n) AS expected FROM r) SELECT l_orderkey, CAST(n AS INT) AS n, CAST(expected AS INT) AS expected FROM e WHERE seg <> expected""")
def c34_order_breaks(spark: SparkSession, d: str) -> DataFrame:
    return S.order_breaks(bindings(spark, d), "l_orderkey", "n", "part", "seg").select("l_orderkey", "n", "expected")


@registered("SELECT o_custkey, o_orderkey, coalesce(o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), false) AS same FROM orders")
def c36_same_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.same_candidates(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus").select("o_custkey", "o_orderkey", "same")


@registered(f"""WITH {FEAT}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seq) AS f, row_number() OVER (PARTITION BY series_id ORDER BY seq DESC) AS l, row_number() OVER (PARTITION BY series_id ORDER BY combined DESC, seq) AS t, max(seq) OVER (PARTITION BY series_id) AS hi FROM feat),
a AS (SELECT series_id, seq AS frame, unnest([CASE WHEN f = 1 OR l = 1 THEN 'endpoint' END, CASE WHEN asym > 0.95 THEN 'outlier' END, CASE WHEN t <= 8 THEN 'residual' END]) AS reason FROM r UNION ALL SELECT DISTINCT series_id, least(hi, greatest(0, k)), 'phase' FROM (SELECT series_id, hi, unnest([-3, 7, hi + 4]) AS k FROM r)),
g AS (SELECT series_id, frame, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM a WHERE reason IS NOT NULL GROUP BY ALL), v AS (SELECT series_id, seq FROM ev WHERE seq % 4 = 1)
SELECT series_id, frame, reasons, coalesce((SELECT v.seq FROM v WHERE v.series_id = g.series_id ORDER BY abs(v.seq - frame), v.seq LIMIT 1), -1) AS available FROM g""")
def d6_diagnostic_frames(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d)
    phases = f.groupBy("series_id").agg(F.max("seq").alias("hi")).select("series_id", F.explode(F.array(F.lit(-3).cast("long"), F.lit(7).cast("long"), F.col("hi") + 4)).alias("frame"))
    found = P.diagnostic_frames(f.withColumn("out", F.col("asym") > 0.95), "combined", "out", phases, f.where("seq % 4 = 1").select("series_id", F.col("seq").alias("frame")))
    return found.select("series_id", "frame", F.array_join("reasons", ",").alias("reasons"), F.coalesce("available", F.lit(-1)).alias("available"))


#: Tight enough that truths compete for detections.
RIVALS = f"""{EV}, truth AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY seq) AS i, seq * 3 AS frame, 4 + seq % 3 AS tolerance FROM ev WHERE kind <> 'error'), found AS (SELECT series_id, seq * 3 + seq % 4 // 2 AS frame FROM ev WHERE seq % 3 <> 1),
walk AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS pick, CAST([] AS BIGINT[]) AS used FROM truth
 UNION ALL SELECT series_id, i, frame, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (SELECT t.series_id, t.i, t.frame, w.used, arg_min(f.frame, abs(f.frame - t.frame) * 1000000 + f.frame) AS pick
  FROM walk w JOIN truth t ON w.series_id = t.series_id AND t.i = w.i + 1 LEFT JOIN found f ON f.series_id = t.series_id AND abs(f.frame - t.frame) <= t.tolerance AND NOT list_contains(w.used, f.frame) GROUP BY ALL)),
matched AS (SELECT series_id, frame, pick AS detected_frame FROM walk WHERE i > 0)"""


def rivals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = ev(spark, d)
    return e.where("kind <> 'error'").select("series_id", (F.col("seq") * 3).alias("frame"), (4 + F.col("seq") % 3).alias("tolerance")), e.where("seq % 3 <> 1").select("series_id", (F.col("seq") * 3 + F.floor(F.col("seq") % 4 / 2)).alias("frame"))


@registered(f"WITH RECURSIVE {RIVALS} SELECT series_id, frame, coalesce(detected_frame, -1) AS detected_frame FROM matched")
def e4_match_rivals(spark: SparkSession, d: str) -> DataFrame:
    return K.match_within_tolerance(*rivals(spark, d)).withColumn("detected_frame", F.coalesce("detected_frame", F.lit(-1)))


@registered(f"""WITH RECURSIVE {RIVALS}, a AS (SELECT series_id, count(*) AS nt FROM truth GROUP BY 1), b AS (SELECT series_id, count(*) AS nd FROM found GROUP BY 1), m AS (SELECT series_id, count(*) AS nm, avg(abs(detected_frame - frame)) AS err FROM matched WHERE detected_frame IS NOT NULL GROUP BY 1)
SELECT series_id, coalesce(nt, 0) AS n_truth, coalesce(nd, 0) AS n_detected, coalesce(nm, 0) AS n_matched, round(CASE WHEN nd > 0 THEN coalesce(nm, 0) / nd ELSE 0 END, 6) AS precision, round(CASE WHEN nt > 0 THEN coalesce(nm, 0) / nt ELSE 1 END, 6) AS recall, round(coalesce(err, 0), 6) AS mean_error FROM a FULL JOIN b USING (series_id) LEFT JOIN m USING (series_id)""")
def f6_scorecard_of_rivals(spark: SparkSession, d: str) -> DataFrame:
    truth, found = rivals(spark, d)
    return rounded(K.boundary_scorecard(truth, found, K.match_within_tolerance(truth, found)))


@registered(f'WITH {SEGMENTS} SELECT e.series_id, e.seq, s.segment_id FROM ev e JOIN segments s ON e.series_id = s.series_id AND e.seq >= s."start" AND e.seq < s."end"')
def e6_required_range(spark: SparkSession, d: str) -> DataFrame:
    return J.required_range(ev(spark, d).select("series_id", "seq"), segments(spark, d)).select("series_id", "seq", "segment_id")


@registered(f"""WITH {SPANS}, a AS (SELECT series_id, seq, seq * 0.4 + edge * 0.1 AS first, seq * 0.4 + edge * 0.1 + signal AS last FROM ev WHERE kind = 'click')
SELECT a.series_id, a.seq, s.seq AS seq2 FROM a JOIN spans s ON a.series_id = s.series_id AND CAST(round_even(last * 25, 0) AS BIGINT) >= s."start" AND CAST(round_even(first * 25, 0) AS BIGINT) < s."end" """)
def e7_inclusive_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = ev(spark, d).where("kind = 'click'").select("series_id", "seq", (F.col("seq") * 0.4 + F.col("edge") * 0.1).alias("first"), (F.col("seq") * 0.4 + F.col("edge") * 0.1 + F.col("signal")).alias("last"))
    spans = intervals(spark, d).select("series_id", F.col("seq").alias("seq2"), "start", "end")
    return J.inclusive_overlap(a, spans, 25.0).select("series_id", "seq", "seq2")


KEPT = f"""{CONV}, kept AS (SELECT series_id, seq AS k, "start" + 0.7 AS a, "end" - 0.9 AS b, CAST(round_even("start" * 20, 0) AS BIGINT) AS o FROM conv WHERE seq % 3 <> 2 AND "end" - "start" > 2), tot AS (SELECT series_id, CAST(round_even(max("end") * 22, 0) AS BIGINT) + 1 AS total FROM conv GROUP BY 1)"""


@registered(f"""WITH {KEPT}, m AS (SELECT c.series_id, c.seq, k, greatest("start" - 0.3, a) AS f, least("end" + 0.3, b) AS t, a, o, total FROM conv c JOIN kept ON c.series_id = kept.series_id JOIN tot ON c.series_id = tot.series_id WHERE least("end" + 0.3, b) > greatest("start" - 0.3, a)),
s AS (SELECT *, least(total - 1, o + CAST(round_even((f - a) * 25, 0) AS BIGINT)) AS cue_start FROM m)
SELECT series_id, seq, k, cue_start, greatest(1, least(greatest(1, CAST(round_even((t - f) * 25, 0) AS BIGINT)), total - cue_start)) AS cue_duration FROM s""")
def e7_remapped_captions(spark: SparkSession, d: str) -> DataFrame:
    t = conv(spark, d)
    kept = t.where("seq % 3 <> 2 and end - start > 2").select("series_id", F.col("seq").alias("k"), (F.col("start") + 0.7).alias("start"), (F.col("end") - 0.9).alias("end"), F.bround(F.col("start") * 20).cast("long").alias("output_start"))
    totals = t.groupBy("series_id").agg((F.bround(F.max("end") * 22).cast("long") + 1).alias("total"))
    captions = t.select("series_id", "seq", (F.col("start") - 0.3).alias("start"), (F.col("end") + 0.3).alias("end"))
    marked = kept.withColumn("output_start", F.struct("output_start", "k"))  # the span's number travels with it
    found = J.remapped_captions(captions, marked.withColumn("output_start", F.col("output_start.output_start")), totals, 25.0)
    named = found.join(kept.select("series_id", "k", "output_start"), ["series_id", "output_start"])
    return named.select("series_id", "seq", "k", "cue_start", "cue_duration")


@registered("""WITH f AS (SELECT sha256(text) AS h FROM benchmark WHERE item_id % 5 = 0), p AS (SELECT doc_id, 'x ' || sha256(text) || 'f00d and ' || CASE WHEN doc_id % 7 = 0 THEN (SELECT h FROM f ORDER BY h LIMIT 1) ELSE 'none' END || 'a' AS s FROM documents)
SELECT doc_id, h AS digest FROM p JOIN f ON contains(s, h)""")
def e13_forbidden_mentions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "benchmark").where("item_id % 5 = 0").select(F.sha2("text", 256).alias("digest"))
    first = f.agg(F.min("digest").alias("h")).withColumn("one", F.lit(1))  # one row
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit(1).alias("one")).join(F.broadcast(first), "one")
    text = F.concat(F.lit("x "), F.sha2("text", 256), F.lit("f00d and "), F.when(F.col("doc_id") % 7 == 0, F.col("h")).otherwise("none"), F.lit("a"))
    return L.forbidden_mentions(docs.select("doc_id", text.alias("s")), f, "doc_id", "s", "digest")


@registered("""WITH g AS (SELECT n_nationkey AS graph, CASE WHEN n_nationkey % 2 = 0 THEN 'approved' ELSE 'draft' END AS state, CASE WHEN n_nationkey % 6 > 0 THEN n_name END AS version FROM nation),
n AS (SELECT c_nationkey AS graph, c_custkey // 2 AS id, CASE WHEN c_custkey % 11 = 0 THEN 'open' ELSE 'approved' END AS approval, c_custkey % 13 AS n_inverse FROM customer), e AS (SELECT c_nationkey AS graph, c_custkey // 2 AS src, c_custkey // 2 + c_custkey % 5 AS dst FROM customer)
SELECT graph, 'repeated id' AS problem, id FROM n GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT graph, 'no src', src FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.graph = e.graph AND n.id = e.src) UNION ALL SELECT graph, 'no dst', dst FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.graph = e.graph AND n.id = e.dst)
UNION ALL SELECT graph, 'no version', NULL FROM g WHERE state = 'approved' AND version IS NULL AND EXISTS (SELECT 1 FROM n WHERE n.graph = g.graph)
UNION ALL SELECT n.graph, 'not approved or not reversible', id FROM n JOIN g ON n.graph = g.graph WHERE state = 'approved' AND (approval <> 'approved' OR n_inverse = 0)""")
def e14_graph_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    graphs = table(spark, d, "nation").select(k.alias("graph"), F.when(k % 2 == 0, "approved").otherwise("draft").alias("state"), F.when(k % 6 > 0, F.col("n_name")).alias("version"))
    c, half = F.col("c_custkey"), F.floor(F.col("c_custkey") / 2)
    rows = table(spark, d, "customer")
    nodes = rows.select(F.col("c_nationkey").alias("graph"), half.alias("id"), F.when(c % 11 == 0, "open").otherwise("approved").alias("approval"), (c % 13).alias("n_inverse"))
    return J.graph_problems(nodes, rows.select(F.col("c_nationkey").alias("graph"), half.alias("src"), (half + c % 5).alias("dst")), graphs)


def derived(name: str, before: str, columns: tuple[str, ...]) -> str:
    return ", ".join(f"{grad(f'{c}{before}', '25')} AS {c}{name}" for c in columns)


DERIVED = f"""{ALIGNED}, v AS (SELECT *, {derived('1', '', ('se', 'sa', 'ee', 'ea'))} FROM al {W}), a AS (SELECT *, {derived('2', '1', ('se', 'sa', 'ee', 'ea'))} FROM v {W}), j AS (SELECT *, {derived('3', '2', ('se', 'sa', 'ee', 'ea'))} FROM a {W}),
r AS (SELECT series_id, {", ".join(f"sqrt(avg(pow(se{n} - sa{n}, 2) + pow(ee{n} - ea{n}, 2))) AS {k}_position, sqrt(avg(pow(se{n} - sa{n}, 2))) AS {k}_scale, sqrt(avg(pow(ee{n} - ea{n}, 2))) AS {k}_rotation" for n, k in ((1, 'velocity'), (2, 'acceleration'), (3, 'jerk')))} FROM j GROUP BY series_id)"""


@registered(f"WITH {DERIVED} SELECT series_id, {', '.join(f'round({k}_{c}, 6) AS {k}_{c}' for k in ('velocity', 'acceleration', 'jerk') for c in ('position', 'scale', 'rotation'))}, round(greatest(jerk_position, jerk_scale, jerk_rotation), 6) AS combined_jerk FROM r")
def f1_derivative_rmse(spark: SparkSession, d: str) -> DataFrame:
    a = aligned(spark, d).withColumn("edge_actual", F.col("edge_actual") * 0.99)
    return rounded(K.derivative_rmse(a, (("signal_expected", "edge_expected"), ("signal_actual", "edge_actual")), ("signal_expected", "signal_actual"), ("edge_expected", "edge_actual"), 25.0))


@registered(f"""WITH {EV}, m AS (SELECT series_id, avg(signal) / 5 AS scale_rmse, avg(edge) AS rotation_rmse_degrees, max(signal) * 100 AS vmaf_mean FROM ev GROUP BY 1), c AS (SELECT series_id, 'scale_rmse' AS metric, 0.05 AS lim FROM m WHERE series_id % 3 = 0 UNION ALL SELECT series_id, 'vmaf_mean', 95 FROM m WHERE series_id % 4 = 1),
u AS (SELECT series_id, 'scale_rmse' AS metric, scale_rmse AS value, 0.03 AS dflt, false AS least FROM m UNION ALL SELECT series_id, 'rotation_rmse_degrees', rotation_rmse_degrees, 0.30, false FROM m UNION ALL SELECT series_id, 'vmaf_mean', vmaf_mean, 80, true FROM m)
SELECT u.series_id, u.metric, round(value, 6) AS value, round(CAST(coalesce(lim, dflt) AS DOUBLE), 6) AS "limit", CASE WHEN CASE WHEN least THEN value >= coalesce(lim, dflt) ELSE value <= coalesce(lim, dflt) END THEN 'pass' ELSE 'fail' END AS status FROM u LEFT JOIN c ON u.series_id = c.series_id AND u.metric = c.metric""")
def f4_default_criteria(spark: SparkSession, d: str) -> DataFrame:
    m = ev(spark, d).groupBy("series_id").agg((F.avg("signal") / 5).alias("scale_rmse"), F.avg("edge").alias("rotation_rmse_degrees"), (F.max("signal") * 100).alias("vmaf_mean"))
    own = m.where("series_id % 3 = 0").select("series_id", F.lit("scale_rmse").alias("metric"), F.lit(0.05).alias("limit")).unionByName(m.where("series_id % 4 = 1").select("series_id", F.lit("vmaf_mean").alias("metric"), F.lit(95.0).alias("limit")))
    return rounded(K.criteria_checks(m, own, "series_id"))


CARD = f"""{EV}, tr AS (SELECT series_id, seq * 10 AS frame, seq % 3 + 2 AS tolerance, CASE seq % 2 WHEN 0 THEN 'hard-cut' ELSE 'dissolve' END AS type, seq % 5 <> 0 AS splits, CASE WHEN seq % 20 = 3 THEN 'loud boundary' ELSE 'x' END AS label FROM ev WHERE kind = 'click'),
de AS (SELECT series_id, seq * 10 + seq % 6 AS frame, CASE seq % 4 WHEN 0 THEN 'hard-cut' WHEN 1 THEN 'dissolve' WHEN 2 THEN 'flash' ELSE 'continuous' END AS type, sqrt(signal) AS confidence FROM ev WHERE seq % 3 <> 1),
sp AS (SELECT * FROM de WHERE type NOT IN ('flash', 'continuous') AND confidence >= 0.55), tot AS (SELECT series_id, max(seq) * 10 + 10 AS total FROM ev GROUP BY 1), sm AS (SELECT series_id, seq * 10 AS frame, edge < 0.8 AS kept FROM ev WHERE kind = 'view'),
m1 AS (SELECT t.series_id, t.frame, s.frame AS f FROM tr t JOIN sp s ON t.series_id = s.series_id AND abs(t.frame - s.frame) <= t.tolerance WHERE splits), m2 AS (SELECT t.series_id, t.type = s.type AS ok FROM tr t JOIN de s ON t.series_id = s.series_id AND abs(t.frame - s.frame) <= t.tolerance),
a AS (SELECT series_id, count(*) AS nt FROM tr WHERE splits GROUP BY 1), b AS (SELECT series_id, count(*) AS nd FROM sp GROUP BY 1), c AS (SELECT series_id, count(*) AS nm, avg(abs(f - frame)) AS err FROM m1 GROUP BY 1), k AS (SELECT series_id, count(*) FILTER (WHERE ok) AS ok FROM m2 GROUP BY 1), n AS (SELECT series_id, count(*) AS n FROM tr GROUP BY 1),
sh AS (SELECT series_id, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS r FROM (SELECT e.series_id, EXISTS (SELECT 1 FROM sm WHERE sm.series_id = e.series_id AND kept AND sm.frame >= e.seq * 10 AND sm.frame < e.seq * 10 + 25) AS hit FROM ev e WHERE kind = 'error' AND seq % 3 = 0) GROUP BY 1), dr AS (SELECT series_id, avg(CASE WHEN kept THEN 0.0 ELSE 1 END) AS r FROM sm GROUP BY 1),
un AS (SELECT series_id, sum(2 + seq % 4) AS lost FROM ev WHERE kind = 'error' GROUP BY 1), la AS (SELECT DISTINCT series_id, 'k' || seq % 4 AS label FROM ev WHERE kind = 'view'), ob AS (SELECT DISTINCT series_id, 'k' || seq % 7 AS label FROM ev WHERE kind = 'error'), le AS (SELECT series_id, avg(CASE WHEN EXISTS (SELECT 1 FROM ob WHERE ob.series_id = la.series_id AND ob.label = la.label) THEN 1.0 ELSE 0 END) AS r FROM la GROUP BY 1),
aw AS (SELECT DISTINCT series_id, unnest(['accent', 'silence']) AS kind FROM ev WHERE series_id % 3 > 0), au AS (SELECT series_id, CASE WHEN seq % 8 = 1 THEN 'accent' ELSE 'noise' END AS kind, seq * 10 + 3 AS frame FROM ev WHERE kind = 'click' AND series_id % 5 > 0), ac AS (SELECT series_id, avg(CASE WHEN EXISTS (SELECT 1 FROM au WHERE au.series_id = w.series_id AND au.kind = w.kind) THEN 1.0 ELSE 0 END) AS r FROM aw w GROUP BY 1),
mk AS (SELECT series_id, min(frame) AS mark FROM tr WHERE label LIKE '%boundary' GROUP BY 1), ae AS (SELECT au.series_id, min(abs(frame - mark)) AS r FROM au JOIN mk USING (series_id) WHERE kind = 'accent' GROUP BY 1)"""


@registered(f"""WITH {CARD} SELECT t.series_id, round(CASE WHEN nd > 0 THEN coalesce(nm, 0) / nd WHEN coalesce(nt, 0) = 0 THEN 1 ELSE 0 END, 6) AS precision, round(CASE WHEN nt > 0 THEN coalesce(nm, 0) / nt ELSE 1 END, 6) AS recall, round(coalesce(err, 0), 6) AS mean_error, round(coalesce(coalesce(ok, 0) / n.n, 1), 6) AS type_accuracy,
 round(coalesce(sh.r, 1), 6) AS short_recall, round(coalesce(dr.r, 0), 6) AS duplicate_reduction, round(coalesce(lost, 0) / total, 6) AS unresolved_ratio, round(coalesce(ac.r, 1), 6) AS audio_coverage, round(coalesce(1 - le.r, 0), 6) AS label_error, round(CASE WHEN mark IS NULL THEN 0 ELSE coalesce(ae.r, total) END, 6) AS accent_error
FROM tot t LEFT JOIN a USING (series_id) LEFT JOIN b USING (series_id) LEFT JOIN c USING (series_id) LEFT JOIN k USING (series_id) LEFT JOIN n USING (series_id) LEFT JOIN sh USING (series_id) LEFT JOIN dr USING (series_id) LEFT JOIN un USING (series_id) LEFT JOIN le USING (series_id) LEFT JOIN ac USING (series_id) LEFT JOIN mk USING (series_id) LEFT JOIN ae USING (series_id)""")
def f6_full_scorecard(spark: SparkSession, d: str) -> DataFrame:
    e, n = ev(spark, d), F.col("seq")
    truth = e.where("kind = 'click'").select("series_id", (n * 10).alias("frame"), (n % 3 + 2).alias("tolerance"), F.when(n % 2 == 0, "hard-cut").otherwise("dissolve").alias("type"), (n % 5 != 0).alias("splits"), F.when(n % 20 == 3, "loud boundary").otherwise("x").alias("label"))
    kind = F.when(n % 4 == 0, "hard-cut").when(n % 4 == 1, "dissolve").when(n % 4 == 2, "flash").otherwise("continuous")
    found = e.where("seq % 3 <> 1").select("series_id", (n * 10 + n % 6).alias("frame"), kind.alias("type"), F.sqrt("signal").alias("confidence"))
    totals = e.groupBy("series_id").agg((F.max("seq") * 10 + 10).alias("total"))
    short = e.where("kind = 'error' and seq % 3 = 0").select("series_id", (n * 10).alias("start"), (n * 10 + 25).alias("end"))
    samples = e.where("kind = 'view'").select("series_id", (n * 10).alias("frame"), (F.col("edge") < 0.8).alias("kept"))
    lost = e.where("kind = 'error'").select("series_id", n.alias("start"), (n + 2 + n % 4).alias("end"))
    label = lambda k, m: e.where(f"kind = '{k}'").select("series_id", F.concat(F.lit("k"), (n % m).cast("string")).alias("label"))
    wanted = e.where("series_id % 3 > 0").select("series_id").distinct().select("series_id", F.explode(F.array(F.lit("accent"), F.lit("silence"))).alias("kind"))
    audio = e.where("kind = 'click' and series_id % 5 > 0").select("series_id", F.when(n % 8 == 1, "accent").otherwise("noise").alias("kind"), (n * 10 + 3).alias("frame"))
    return rounded(K.full_scorecard(totals, truth, found, short, samples, lost, label("view", 4), label("error", 7), wanted, audio))


@registered(f"""WITH {EV}, t AS (SELECT series_id, max(seq) * 10 + 15 AS total FROM ev GROUP BY 1), g AS (SELECT series_id, seq * 10 - 5 AS a, seq * 10 + 2 + 9 * (seq % 3) AS b FROM ev WHERE kind = 'error'), r AS (SELECT *, max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g JOIN t USING (series_id)),
s AS (SELECT series_id, count(*) AS n, bool_or(coalesce(reach > a, false)) AS o, bool_or(a < 0 OR b > total) AS x FROM r GROUP BY 1), p AS (SELECT series_id, count(DISTINCT seq % 7) AS n FROM ev WHERE kind = 'click' GROUP BY 1)
SELECT t.series_id, coalesce(s.n, 0) AS n_gaps, coalesce(o, false) AS gaps_overlap, coalesce(x, false) AS outside, coalesce(p.n, 0) AS n_protected FROM t LEFT JOIN s USING (series_id) LEFT JOIN p USING (series_id)""")
def f8_coverage_checks(spark: SparkSession, d: str) -> DataFrame:
    e, n = ev(spark, d), F.col("seq")
    gaps = e.where("kind = 'error'").select("series_id", (n * 10 - 5).alias("start"), (n * 10 + 2 + 9 * (n % 3)).alias("end"))
    return K.coverage_checks(gaps, e.where("kind = 'click'").select("series_id", (n % 7).alias("sample_id")), e.groupBy("series_id").agg((F.max("seq") * 10 + 15).alias("total")))


@registered(f"""WITH {EV}, r AS (SELECT series_id, seq, CASE WHEN series_id % 3 = 0 AND seq % 9 = 4 THEN t_seconds - 1e7 ELSE t_seconds END AS t, CASE WHEN series_id % 4 = 0 THEN seq // 2 ELSE seq END AS id FROM ev), b AS (SELECT *, t < lag(t) OVER (PARTITION BY series_id ORDER BY seq) AS back FROM r)
SELECT series_id, NOT bool_or(coalesce(back, false)) AS chronological, count(DISTINCT id) = count(*) AS unique_ids FROM b GROUP BY series_id""")
def f9_manifest_order(spark: SparkSession, d: str) -> DataFrame:
    t = F.when((F.col("series_id") % 3 == 0) & (F.col("seq") % 9 == 4), F.col("t_seconds") - 1e7).otherwise(F.col("t_seconds"))
    rows = ev(spark, d).select("series_id", "seq", t.alias("t"), F.when(F.col("series_id") % 4 == 0, F.floor(F.col("seq") / 2)).otherwise(F.col("seq")).alias("id"))
    return K.manifest_order(rows, "series_id", "id", "seq", "t")


@registered(f"""WITH {EV}, u AS (SELECT series_id, signal AS c FROM ev WHERE kind = 'click' AND series_id % 4 > 0 UNION ALL SELECT series_id, edge FROM ev WHERE kind = 'error' AND series_id % 4 > 0)
SELECT s.series_id, round(coalesce(avg(c), 1), 6) AS confidence FROM (SELECT DISTINCT series_id FROM ev) s LEFT JOIN u USING (series_id) GROUP BY s.series_id""")
def f10_structure_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    some = e.where("series_id % 4 > 0")
    return rounded(K.structure_confidence(e, some.where("kind = 'click'").withColumn("confidence", F.col("signal")), some.where("kind = 'error'").withColumn("confidence", F.col("edge"))))


@registered(f"""WITH {EV}, m AS (SELECT series_id, CASE kind WHEN 'click' THEN 'homography' WHEN 'error' THEN 'unknown' ELSE kind END AS m FROM ev), s AS (SELECT series_id, avg(CAST(m = 'homography' AS INT)) AS p, avg(CAST(m = 'unknown' AS INT)) AS u FROM m GROUP BY 1), c AS (SELECT series_id, avg(signal) - 0.5 AS o, avg(edge) / 100 AS dv, max(signal) AS cf FROM ev GROUP BY 1)
SELECT series_id, CASE WHEN p >= 0.25 THEN 'perspective with coupled rotation' WHEN u >= 0.20 THEN 'structured residual or local warp' ELSE 'curve' END AS explanation, round(cf * least(1, abs(o) / 0.20 + dv / 0.02), 6) AS twist FROM s JOIN c USING (series_id)""")
def f13_twist_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    coupling = e.groupBy("series_id").agg((F.avg("signal") - 0.5).alias("max_offset"), (F.avg("edge") / 100).alias("deviation"), F.max("signal").alias("confidence")).withColumn("explanation", F.lit("curve"))
    kind = F.when(F.col("kind") == "click", "homography").when(F.col("kind") == "error", "unknown").otherwise(F.col("kind"))
    return rounded(K.twist_candidates(e.withColumn("m", kind), coupling, "series_id", "m"))


@registered(r"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(string_split_regex(lower(text), '[ \t\n\r\f\v]+')) AS term FROM conversations), t AS (SELECT DISTINCT conv_id, term FROM w WHERE length(term) >= 5),
c AS (SELECT t.conv_id, term, count(*) AS n FROM t JOIN conversations d ON t.conv_id = d.conv_id AND contains(lower(d.text), term) GROUP BY ALL HAVING count(*) >= 2), a AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) >= 2),
m AS (SELECT conv_id, 'recurring visual term: ' || term AS motif, n FROM c UNION ALL SELECT conv_id, 'recurring audio accents: ' || n, n FROM a)
SELECT conv_id, motif, n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY motif) AS INT) AS place FROM m QUALIFY place <= 20""")
def f16_recurring_motifs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return T.recurring_motifs(c, c.select("conv_id", F.when(F.col("role") == "user", "accent").otherwise("x").alias("kind")), "conv_id", "turn")


@registered("""WITH a AS (SELECT source, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 17 <> 3), b AS (SELECT source, doc_id, sha256(CASE WHEN doc_id % 23 = 5 THEN 'other' ELSE text END) AS h FROM documents WHERE doc_id % 19 <> 2),
j AS (SELECT coalesce(a.source, b.source) AS source, a.h AS x, b.h AS y FROM a FULL JOIN b ON a.source = b.source AND a.doc_id = b.doc_id)
SELECT source, count(*) AS n, count(*) FILTER (WHERE x = y) AS n_equal, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS n_only, count(*) = count(*) FILTER (WHERE x = y) AS replay_equal FROM j GROUP BY source""")
def f17_corpus_replay(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 17 <> 3").withColumn("h", F.sha2("text", 256))
    b = docs.where("doc_id % 19 <> 2").withColumn("h", F.sha2(F.when(F.col("doc_id") % 23 == 5, "other").otherwise(F.col("text")), 256))
    return K.corpus_replay(a, b, "source", "doc_id", "h")


@registered(f"""WITH {EV}, s AS (SELECT *, sqrt(pow(signal - lag(signal) OVER w, 2) + pow(edge - lag(edge) OVER w, 2)) AS step FROM ev {W})
SELECT series_id, round(coalesce(max(step), 0), 6) AS max_center_step, round(max(greatest(abs(signal * 0.01), abs(edge * 0.02), 0.004)), 6) AS max_matrix_error, round(max(sqrt(pow(0.5 + signal / 50 - 0.5, 2) + pow(0.5 - edge / 80 - 0.5, 2))), 6) AS max_pivot_deviation FROM s GROUP BY series_id""")
def f18_contract_extrema(spark: SparkSession, d: str) -> DataFrame:
    one, no = F.lit(1.0), F.lit(0.0)
    e = F.array(one, no, no, no, one, no, no, no, one)
    a = F.array(1 + F.col("signal") * 0.01, no, F.lit(0.004), no, 1 - F.col("edge") * 0.02, no, no, no, one)
    rows = ev(spark, d).withColumns({"px": 0.5 + F.col("signal") / 50, "py": 0.5 - F.col("edge") / 80, "e": e, "a": a})
    return rounded(K.contract_extrema(rows, "series_id", "seq", ("signal", "edge"), ("px", "py"), (0.5, 0.5), "e", "a"))


@registered("""SELECT tag, CAST(doc_id // 100 AS BIGINT) AS part, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS ids FROM (SELECT doc_id, unnest([lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END]) AS tag FROM documents) GROUP BY ALL""")
def f19_requirement_postings(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array("lang", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short"))
    found = K.requirement_postings(table(spark, d, "documents"), "doc_id", tags, 100)
    return found.select("tag", "part", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


#: Keys at uneven distances.
KEYS = f"{EV}, k AS (SELECT series_id, seq * 3 + seq % 2 * 2 + 2 AS x, signal AS y, edge AS z FROM ev WHERE seq % 4 < 2), tm AS (SELECT series_id, seq * 2 AS t FROM ev)"
ENDS = "en AS (SELECT series_id, arg_min(y, x) AS yf, arg_min(z, x) AS zf, min(x) AS lo, arg_max(y, x) AS yl, arg_max(z, x) AS zl, max(x) AS hi FROM k GROUP BY series_id), tx AS (SELECT tm.series_id, t, CASE WHEN t < lo THEN yf ELSE yl END AS y, CASE WHEN t < lo THEN zf ELSE zl END AS z FROM tm JOIN en USING (series_id) WHERE t < lo OR t >= hi)"
CUBIC = "(2 * p * p * p - 3 * p * p + 1) * {0} + (-2 * p * p * p + 3 * p * p) * {0}1 + (p * p * p - 2 * p * p + p) * span * {1} + (p * p * p - p * p) * span * {2}"


def keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, n = ev(spark, d), F.col("seq")
    return e.where("seq % 4 < 2").select("series_id", (n * 3 + n % 2 * 2 + 2).alias("seq"), F.col("signal").alias("y"), F.col("edge").alias("z")), e.select("series_id", (n * 2).alias("t"))


def tangent_sql(v: str) -> str:
    return f"CASE WHEN h IS NULL THEN s{v}1 WHEN h1 IS NULL THEN s{v} WHEN s{v} * s{v}1 > 0 THEN ((2 * h1 + h) + (h1 + 2 * h)) / ((2 * h1 + h) / s{v} + (h1 + 2 * h) / s{v}1) ELSE 0 END AS m{v}"


MONOTONE = f"""{KEYS}, {ENDS}, a AS (SELECT *, x - lag(x) OVER w AS h, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS sy, (z - lag(z) OVER w) / (x - lag(x) OVER w) AS sz FROM k WINDOW w AS (PARTITION BY series_id ORDER BY x)), b AS (SELECT *, lead(h) OVER w AS h1, lead(sy) OVER w AS sy1, lead(sz) OVER w AS sz1 FROM a WINDOW w AS (PARTITION BY series_id ORDER BY x)),
c AS (SELECT *, {tangent_sql('y')}, {tangent_sql('z')} FROM b), sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(my) OVER w AS ny, lead(mz) OVER w AS nz FROM c WINDOW w AS (PARTITION BY series_id ORDER BY x)),
i AS (SELECT tm.series_id, t, (t - x) / CAST(x1 - x AS DOUBLE) AS p, x1 - x AS span, y, y1, z, z1, my, ny, mz, nz FROM tm JOIN sg ON tm.series_id = sg.series_id AND t >= x AND t < x1)"""


@registered(f"WITH {MONOTONE} SELECT series_id, t, round({CUBIC.format('y', 'my', 'ny')}, 6) AS y, round({CUBIC.format('z', 'mz', 'nz')}, 6) AS z FROM i UNION ALL SELECT series_id, t, round(y, 6), round(z, 6) FROM tx")
def g15_densify_path(spark: SparkSession, d: str) -> DataFrame:
    k, t = keys(spark, d)
    return rounded(I.densify_curve(k, t, "monotone", ("y", "z")))


@registered(f"""WITH {KEYS}, {ENDS}, sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY x)), i AS (SELECT tm.series_id, t, (t - x) / CAST(x1 - x AS DOUBLE) AS p, x1 - x AS span, y, y1, z, z1 FROM tm JOIN sg ON tm.series_id = sg.series_id AND t >= x AND t < x1)
SELECT series_id, t, round({CUBIC.format('y', 'z / 10', '-y1 / 20')}, 6) AS y FROM i UNION ALL SELECT series_id, t, round(y, 6) FROM tx""")
def g15_densify_tangents(spark: SparkSession, d: str) -> DataFrame:
    k, t = keys(spark, d)
    return rounded(I.densify_curve(k.withColumns({"y_out": F.col("z") / 10, "y_in": -F.col("y") / 20}), t, "tangents", "y"))


def solve_sql(times: str, steps: int = 24) -> str:
    """Bisection and then Newton steps for the parameter of a Bezier curve: another way than the operator's to the same root."""
    x = "pow(1 - u, 3) * x0 + 3 * pow(1 - u, 2) * u * a + 3 * (1 - u) * u * u * b + u * u * u * x1"
    slope = "3 * pow(1 - u, 2) * (a - x0) + 6 * (1 - u) * u * (b - a) + 3 * u * u * (x1 - b)"
    parts = [f"n0 AS (SELECT *, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.5::DOUBLE AS u FROM {times})"]
    for i in range(steps):
        parts.append(f"n{i + 1} AS (SELECT * EXCLUDE (lo, hi, u), lo, hi, (lo + hi) / 2 AS u FROM (SELECT * EXCLUDE (lo, hi), CASE WHEN {x} < t THEN u ELSE lo END AS lo, CASE WHEN {x} < t THEN hi ELSE u END AS hi FROM n{i}))")
    for i in range(steps, steps + 3):
        parts.append(f"n{i + 1} AS (SELECT * EXCLUDE (u), u - ({x} - t) / ({slope}) AS u FROM n{i})")
    return ", ".join([*parts, f"solved AS (SELECT * FROM n{steps + 3})"])


@registered(f"""WITH {KEYS}, {ENDS}, sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY x)),
i AS (SELECT tm.series_id, CAST(t AS DOUBLE) AS t, CAST(x AS DOUBLE) AS x0, x + 0.5 + z AS a, x1 - 0.6 - y1 AS b, CAST(x1 AS DOUBLE) AS x1, y AS v0, y + 0.2 AS v1, y1 - z1 / 4 AS v2, y1 AS v3, z AS w0, z - 0.1 AS w1, z1 + 0.3 AS w2, z1 AS w3 FROM tm JOIN sg ON tm.series_id = sg.series_id AND t >= x AND t < x1), {solve_sql('i')}
SELECT series_id, CAST(t AS BIGINT) AS t, round(pow(1 - u, 3) * v0 + 3 * pow(1 - u, 2) * u * v1 + 3 * (1 - u) * u * u * v2 + u * u * u * v3, 6) AS y, round(pow(1 - u, 3) * w0 + 3 * pow(1 - u, 2) * u * w1 + 3 * (1 - u) * u * u * w2 + u * u * u * w3, 6) AS z FROM solved UNION ALL SELECT series_id, t, round(y, 6), round(z, 6) FROM tx""")
def g15_densify_bezier(spark: SparkSession, d: str) -> DataFrame:
    k, t = keys(spark, d)
    k = k.withColumns({"out_t": 0.5 + F.col("z"), "in_t": -0.6 - F.col("y"), "y_out": F.lit(0.2), "y_in": -F.col("z") / 4, "z_out": F.lit(-0.1), "z_in": F.lit(0.3)})
    return rounded(I.densify_bezier(k, t, ("y", "z")))


@registered(f"""WITH {KEYS}, {ENDS}, sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY x)), i AS (SELECT tm.series_id, t, (t - x) / CAST(x1 - x AS DOUBLE) AS p, y, y1, z, z1 FROM tm JOIN sg ON tm.series_id = sg.series_id AND t >= x AND t < x1),
n AS (SELECT series_id, t, 1 + y + (y1 - y) * p AS a, z * 5 + (z1 - z) * 5 * p AS tx, 1 + z / 10 + (z1 - z) / 10 * p AS w FROM i) SELECT series_id, t, round(a / w, 6) AS a, round(tx / w, 6) AS tx, round(1 / w, 6) AS d FROM n UNION ALL SELECT series_id, t, round(1 + y, 6), round(z * 5, 6), 1 FROM tx""")
def g15_densify_matrix(spark: SparkSession, d: str) -> DataFrame:
    k, t = keys(spark, d)
    one, no = F.lit(1.0), F.lit(0.0)
    m = F.array(1 + F.col("y"), no, F.col("z") * 5, no, one, no, no, no, 1 + F.col("z") / 10)
    found = I.densify_matrix(k.select("series_id", "seq", m.alias("m")), t)
    return rounded(found.select("series_id", "t", F.get("m", F.lit(0)).alias("a"), F.get("m", F.lit(2)).alias("tx"), F.get("m", F.lit(4)).alias("d")))


@registered(f"""WITH {KEYS}, sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY x)), i AS (SELECT series_id, j / 64.0 AS p, x1 - x AS span, y, y1, z, z1 FROM sg, generate_series(0, 63) g(j) WHERE x1 IS NOT NULL),
v AS (SELECT series_id, {CUBIC.format('y', 'z / 10', '-y1 / 20')} AS y FROM i UNION ALL SELECT series_id, y FROM sg WHERE x1 IS NULL) SELECT series_id, round(min(y), 6) AS least, round(max(y), 6) AS most FROM v GROUP BY series_id""")
def g15_curve_extrema(spark: SparkSession, d: str) -> DataFrame:
    k = keys(spark, d)[0].withColumns({"y_out": F.col("z") / 10, "y_in": -F.col("y") / 20})
    return rounded(I.curve_extrema(k, lambda k, t: I.densify_curve(k, t, "tangents", "y"), value="y"))


@registered(f"WITH {KEYS}, r AS (SELECT series_id, x, y, (SELECT max(x) FROM k) AS m FROM k), q AS (SELECT *, 100 * m + x * 350 AS n FROM r) SELECT series_id, x AS seq, n // gcd(n, m) AS num, m // gcd(n, m) AS den, round(y / (350.0 / CAST(m AS DOUBLE)), 6) AS y FROM q")
def g15_retime_curve(spark: SparkSession, d: str) -> DataFrame:
    k = keys(spark, d)[0]
    last = k.agg(F.max("seq")).first()[0]
    return rounded(I.retime_curve(k, (0, last), (100, 450), tangents=("y",)).select("series_id", "seq", "num", "den", "y"))


def off_kind(text: str) -> tuple[str, float]:
    return ("other" if len(text) % 2 else "sized", float(len(text)))


@registered("SELECT doc_id, 'sized' AS kind, length(text) % 2 = 0 AS ok, CASE WHEN length(text) % 2 = 0 THEN CAST(length(text) AS DOUBLE) ELSE -1 END AS value, CASE WHEN length(text) % 2 = 0 THEN '' ELSE 'ValueError' END AS error_type, CASE WHEN length(text) % 2 = 0 THEN '' ELSE 'contract mismatch: expected sized, received other' END AS message FROM documents")
def h4_kind_mismatch(spark: SparkSession, d: str) -> DataFrame:
    found = G.run_analyzers(table(spark, d, "documents"), {"sized": off_kind}, "doc_id", "text")
    return found.select("doc_id", "kind", "ok", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("error_type", F.lit("")).alias("error_type"), F.coalesce("message", F.lit("")).alias("message"))


@registered(f"""WITH {SEGMENTS}, m AS (SELECT *, "end" - "start" AS dur, least(5, "end" - "start") AS m FROM segments)
SELECT DISTINCT series_id, segment_id, "start" + CAST(round_even(i * (dur - 1) / CAST(greatest(m - 1, 1) AS DOUBLE), 0) AS BIGINT) AS frame FROM (SELECT *, unnest(generate_series(0, m - 1)) AS i FROM m)""")
def h5_table_function(spark: SparkSession, d: str) -> DataFrame:
    surface.register(spark)
    segments(spark, d).createOrReplaceTempView("chronoform_segments")
    return spark.sql("SELECT series_id, segment_id, f.frame FROM chronoform_segments s, LATERAL even_frames(s.start, s.end, 5) f")


@registered(f"""WITH {EV}, b AS (SELECT series_id, CAST(seq // 64 AS BIGINT) AS block, signal FROM ev), m AS (SELECT series_id, block, median(signal) AS med FROM b GROUP BY ALL)
SELECT b.series_id, b.block, round(median(abs(signal - med)), 6) AS deviation, count(*) AS n FROM b JOIN m ON b.series_id = m.series_id AND b.block = m.block GROUP BY ALL""")
def h6_aggregate_function(spark: SparkSession, d: str) -> DataFrame:
    surface.register(spark)
    rows = ev(spark, d).select("series_id", F.floor(F.col("seq") / 64).alias("block"), "signal")
    counts = rows.groupBy("series_id", "block").agg(F.count("*").alias("n"))
    rows.createOrReplaceTempView("chronoform_blocks")
    found = spark.sql("SELECT series_id, block, median_deviation(collect_list(signal)) AS deviation FROM chronoform_blocks GROUP BY series_id, block")
    return rounded(found.join(counts, ["series_id", "block"]))


@registered(ORACLE["c18_classify_curve"])
def h6_classify_curve(spark: SparkSession, d: str) -> DataFrame:
    surface.register(spark)
    ev(spark, d).createOrReplaceTempView("chronoform_series")
    found = spark.sql("SELECT series_id, classify_curve(transform(array_sort(collect_list(struct(seq, signal))), r -> r.signal)) AS c FROM chronoform_series GROUP BY series_id")
    return rounded(found.select("series_id", "c.*"))


@registered(f"""WITH {KEYS}, sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY x))
SELECT series_id, x + j AS t, round(y + (y1 - y) * j / CAST(x1 - x AS DOUBLE), 6) AS y FROM sg, LATERAL (SELECT unnest(generate_series(CAST(0 AS BIGINT), x1 - x - 1)) AS j) WHERE x1 IS NOT NULL UNION ALL SELECT series_id, x, round(y, 6) FROM sg WHERE x1 IS NULL""")
def h5_densify_curve(spark: SparkSession, d: str) -> DataFrame:
    surface.register(spark)
    keys(spark, d)[0].select("series_id", "seq", "y").createOrReplaceTempView("chronoform_keys")
    return rounded(spark.sql("SELECT * FROM densify_curve(TABLE(SELECT series_id, seq, y FROM chronoform_keys) PARTITION BY series_id ORDER BY seq)"))


@registered(f'WITH {SEGMENTS} SELECT series_id, segment_id, "start", "end" FROM segments')
def h5_split_segments(spark: SparkSession, d: str) -> DataFrame:
    surface.register(spark)
    marks = peaks(spark, d).select("series_id", F.col("seq").alias("frame"), F.col("combined").alias("confidence"))
    ends = bounds(spark, d)
    rows = marks.join(ends, "series_id").select("series_id", "frame", "confidence", "end")
    rows.unionByName(ends.select("series_id", F.col("end").alias("frame"), F.lit(0.0).alias("confidence"), "end")).createOrReplaceTempView("chronoform_marks")
    return spark.sql("SELECT * FROM split_segments(0.55D, TABLE(SELECT series_id, frame, confidence, `end` FROM chronoform_marks) PARTITION BY series_id ORDER BY frame)")
