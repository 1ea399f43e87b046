"""Queries of the interval, sampling and join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoform.operators import intervals as I
from chronoform.operators import joins as J
from chronoform.operators import sampling as P
from chronoform.operators import series as S

from .fixtures import CONV, EV, FEAT, HOURLY, SPANS, conv, ev, feat, hourly, intervals, table
from .registry import r6, registered, rounded
from .series_queries import PEAKS, SEGMENTS, bounds, peaks, segments

MERGED = f"""{SPANS}, m1 AS (SELECT *, max("end") OVER (PARTITION BY series_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans),
m2 AS (SELECT *, sum(CASE WHEN far IS NULL OR "start" > far THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m1),
merged AS (SELECT series_id, min("start") AS "start", max("end") AS "end", count(*) AS n FROM m2 GROUP BY series_id, g)"""


@registered(f'WITH {MERGED} SELECT series_id, "start", "end", n FROM merged')
def g1_merge_ranges(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_ranges(intervals(spark, d))


@registered(f"""WITH {SPANS}, t AS (SELECT series_id, max("end") + 7 AS total FROM spans GROUP BY series_id), a AS (SELECT series_id, "start", "end" FROM spans UNION ALL SELECT series_id, total, total FROM t),
f AS (SELECT *, coalesce(max("end") OVER (PARTITION BY series_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frm FROM a) SELECT series_id, frm AS "start", "start" AS "end" FROM f WHERE "start" - frm > 0.05""")
def g2_gaps(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals(spark, d)
    return I.gaps(spans, spans.groupBy("series_id").agg((F.max("end") + 7).alias("total")))


SILENT = f"""{HOURLY}, r AS (SELECT *, sum(CASE WHEN level < 0.35 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM hourly),
sil AS (SELECT series_id, CAST(min(seq) AS DOUBLE) AS "start", max(seq) + 1.0 AS "end" FROM r WHERE level < 0.35 GROUP BY series_id, g), tot AS (SELECT series_id, count(*) AS total FROM hourly GROUP BY series_id)"""


@registered(f"""WITH {SILENT}, c AS (SELECT sil.*, total, greatest(0, lag("end") OVER s - 0.08) AS a, greatest(0, "start" + 0.08) AS b, lead("start") OVER s IS NULL AS last FROM sil JOIN tot USING (series_id) WINDOW s AS (PARTITION BY series_id ORDER BY "start")),
k AS (SELECT series_id, coalesce(CASE WHEN a IS NULL THEN 0 ELSE a END, 0) AS "start", least(b, total) AS "end" FROM c UNION ALL SELECT series_id, greatest(0, "end" - 0.08), total FROM c WHERE last), kept AS (SELECT * FROM k WHERE "end" - "start" >= 0.12)
SELECT series_id, round("start", 6) AS "start", round("end", 6) AS "end" FROM (SELECT * FROM kept UNION ALL SELECT series_id, 0.0, CAST(total AS DOUBLE) FROM tot WHERE series_id NOT IN (SELECT series_id FROM kept))""")
def g3_keep_complement(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d)
    silences = S.level_intervals(h, F.col("level") < 0.35, 1).select("series_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return rounded(I.keep_complement(silences, h.groupBy("series_id").agg(F.count("*").alias("total"))))


PACKED = f"""{SPANS}, packed AS (SELECT *, greatest(1, CAST(round_even(("end" - "start") * 0.37, 0) AS BIGINT)) AS frames FROM spans)"""


@registered(f"WITH {PACKED} SELECT series_id, seq, frames, CAST(coalesce(sum(frames) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start FROM packed")
def g4_pack_timeline(spark: SparkSession, d: str) -> DataFrame:
    return I.pack_timeline(intervals(spark, d), 0.37).select("series_id", "seq", "frames", "out_start")


@registered(f"""WITH {SPANS}, w AS (SELECT series_id, min("start") AS "start", max("end") AS "end" FROM spans GROUP BY series_id), fit AS (SELECT series_id, "start", "end" FROM spans WHERE "end" - "start" >= 90),
a AS (SELECT * FROM fit UNION ALL SELECT * FROM w WHERE series_id NOT IN (SELECT series_id FROM fit)), n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY "start", "end") AS n FROM a QUALIFY n <= 6),
f AS (SELECT *, least(greatest(1, CAST(round_even(("end" - "start") * 1.5, 0) AS BIGINT)), 142) AS frames FROM n)
SELECT series_id, "start", "end", CAST(n AS INT) AS n, frames, CAST(coalesce(sum(frames) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start FROM f""")
def g5_montage(spark: SparkSession, d: str) -> DataFrame:
    return I.montage(intervals(spark, d), 1.5, shortest=90, longest=95)


@registered(f"""WITH {PACKED}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seq DESC) - 1 AS n FROM packed QUALIFY n % 2 = 0)
SELECT series_id, seq, CAST(coalesce(sum(frames) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start FROM n""")
def g6_resequence(spark: SparkSession, d: str) -> DataFrame:
    return I.resequence(I.pack_timeline(intervals(spark, d), 0.37).drop("out_start"), reverse=True, sparse=True).select("series_id", "seq", "out_start")


@registered(f"""WITH {SPANS}, c AS (SELECT series_id, kind AS track_id, CASE WHEN kind = 'view' THEN 'audio' ELSE 'video' END AS track_kind, seq % 70 AS clip_id, "start" // 3 AS "start", "end" // 3 + 20 AS "end" FROM spans),
late AS (SELECT series_id, clip_id, lead("start") OVER (PARTITION BY series_id, track_id ORDER BY "start", clip_id) < "end" AS o FROM c WHERE track_kind <> 'audio')
SELECT series_id, clip_id, 'overlap' AS problem FROM late WHERE o UNION ALL SELECT series_id, clip_id, 'duplicate id' FROM c GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT series_id, clip_id, 'beyond end' FROM c WHERE "end" > 900""")
def g7_validate_timeline(spark: SparkSession, d: str) -> DataFrame:
    clips = intervals(spark, d).select("series_id", F.col("kind").alias("track_id"), F.when(F.col("kind") == "view", "audio").otherwise("video").alias("track_kind"), (F.col("seq") % 70).alias("clip_id"), F.floor(F.col("start") / 3).alias("start"), (F.floor(F.col("end") / 3) + 20).alias("end"))
    return I.validate_timeline(clips, clips.select("series_id").distinct().withColumn("duration", F.lit(900)))


@registered(f"""WITH {MERGED}, f AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY "start") AS k FROM merged QUALIFY k <= 8), b AS (SELECT series_id, max("end") AS hi FROM spans GROUP BY series_id)
SELECT f.series_id, greatest(0, "start" - 6) AS "start", least(hi, "end" + 6) AS "end", array_to_string([greatest(0, "start" - 6), least(hi, "end" + 6) - 1], ',') AS pins FROM f JOIN b ON f.series_id = b.series_id""")
def g9_focused_ranges(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals(spark, d)
    found = I.focused_ranges(spans, spans.groupBy("series_id").agg(F.lit(0).cast("long").alias("lo"), F.max("end").alias("hi")))
    return found.withColumn("pins", F.array_join(F.transform("pins", lambda x: x.cast("string")), ","))


@registered(f"""WITH {CONV}, t AS (SELECT *, CAST(600 AS BIGINT) AS lim, CAST(round_even("start" * 12.5, 0) AS BIGINT) AS a, CAST(round_even("end" * 12.5, 0) AS BIGINT) AS b FROM conv)
SELECT series_id, seq, least(greatest(a, 0), lim) AS first, least(greatest(b, 0), lim) AS last FROM t WHERE least(greatest(b, 0), lim) > least(greatest(a, 0), lim)""")
def g10_seconds_to_frames(spark: SparkSession, d: str) -> DataFrame:
    return I.seconds_to_frames(conv(spark, d).withColumn("lim", F.lit(600).cast("long")), 12.5, "lim").select("series_id", "seq", "first", "last")


@registered(f"""WITH {EV}, a AS (SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY series_id) AS total, row_number() OVER (PARTITION BY series_id ORDER BY signal DESC, seq) = 1 AS top FROM ev),
b AS (SELECT *, max(CASE WHEN top THEN n END) OVER (PARTITION BY series_id) AS t FROM a), c AS (SELECT *, CASE WHEN t > 1 AND t < total THEN t ELSE total - 1 END AS climax FROM b)
SELECT series_id, seq, CASE WHEN n = 1 THEN 'hook' WHEN n = total THEN 'conclusion' WHEN n = climax AND total > 2 THEN 'climax' WHEN n = 2 THEN 'setup' ELSE 'development' END AS role FROM c""")
def g13_editorial_roles(spark: SparkSession, d: str) -> DataFrame:
    return I.editorial_roles(ev(spark, d), "signal").select("series_id", "seq", "role")


@registered(f"""WITH RECURSIVE {EV}, ops AS (SELECT series_id AS doc_id, kind AS path, seq, seq // 5 AS patch, CASE WHEN seq % 7 = 5 THEN 'remove' WHEN seq % 10 = 8 THEN 'test' ELSE 'replace' END AS op,
 CASE WHEN seq % 7 = 5 OR seq % 30 = 8 THEN NULL ELSE CAST(CAST(round(edge * 100) AS BIGINT) AS VARCHAR) END AS value FROM ev),
walk AS (SELECT doc_id, CAST(-1 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS patch, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS state, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS snap, false AS failed FROM (SELECT DISTINCT doc_id FROM ops) UNION ALL
 SELECT doc_id, seq, patch, CASE WHEN op = 'test' OR failed THEN base ELSE map_concat(base, MAP {{path: value}}) END, snap, failed OR (op = 'test' AND value IS DISTINCT FROM base[path]) FROM
  (SELECT o.*, CASE WHEN o.patch <> w.patch AND w.failed THEN w.snap ELSE w.state END AS base, CASE WHEN o.patch = w.patch THEN w.snap WHEN w.failed THEN w.snap ELSE w.state END AS snap, o.patch = w.patch AND w.failed AS failed FROM walk w JOIN ops o ON o.doc_id = w.doc_id AND o.seq = w.seq + 1)),
bad AS (SELECT DISTINCT doc_id, patch FROM walk WHERE failed),
t AS (SELECT ops.*, bad.patch IS NOT NULL AS aborted FROM ops LEFT JOIN bad ON ops.doc_id = bad.doc_id AND ops.patch = bad.patch),
u AS (SELECT *, last_value(CASE WHEN op <> 'test' AND NOT aborted THEN {{'v': value}} END IGNORE NULLS) OVER (PARTITION BY doc_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).v AS before FROM t)
SELECT doc_id, path, seq, aborted, CASE WHEN aborted THEN '' WHEN op = 'test' THEN 'test' WHEN before IS NULL THEN 'remove' WHEN op = 'remove' THEN 'add' ELSE 'replace' END AS inverse_op, CASE WHEN NOT aborted THEN before END AS inverse_value FROM u""")
def g14_patch_log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("seq") % 7 == 5, "remove").when(F.col("seq") % 10 == 8, "test").otherwise("replace")
    value = F.when((F.col("seq") % 7 != 5) & (F.col("seq") % 30 != 8), F.round(F.col("edge") * 100).cast("long").cast("string"))
    ops = ev(spark, d).select(F.col("series_id").alias("doc_id"), F.col("kind").alias("path"), "seq", F.floor(F.col("seq") / 5).alias("patch"), op.alias("op"), value.alias("value"))
    return I.patch_log(ops, patch="patch").select("doc_id", "path", "seq", "aborted", F.coalesce("inverse_op", F.lit("")).alias("inverse_op"), "inverse_value")


def curve_sql(at: str) -> str:
    return f"""WITH {EV}, k AS (SELECT series_id, seq * 3 + 2 AS x, signal AS y FROM ev WHERE seq % 4 = 0),
s1 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY series_id ORDER BY x)), s2 AS (SELECT *, (y1 - y) / (x1 - x) AS sl FROM s1), s3 AS (SELECT *, lag(sl) OVER w AS sb, lead(sl) OVER w AS sa FROM s2 WINDOW w AS (PARTITION BY series_id ORDER BY x)),
seg AS (SELECT *, CASE WHEN sb IS NULL THEN sl WHEN sb * sl > 0 THEN 2 * sb * sl / (sb + sl) ELSE 0 END AS m0, CASE WHEN sa IS NULL THEN sl WHEN sl * sa > 0 THEN 2 * sl * sa / (sl + sa) ELSE 0 END AS m1 FROM s3 WHERE x1 IS NOT NULL),
e AS (SELECT series_id, arg_min(y, x) AS yf, min(x) AS lo, arg_max(y, x) AS yl, max(x) AS hi FROM k GROUP BY series_id), t AS (SELECT series_id, seq * 2 AS t FROM ev),
i AS (SELECT t.series_id, t.t, (t.t - x) / CAST(x1 - x AS DOUBLE) AS p, x1 - x AS span, seg.* EXCLUDE (series_id) FROM t JOIN seg ON t.series_id = seg.series_id AND t.t >= x AND t.t < x1)
SELECT series_id, t, round({at}, 6) AS value FROM i UNION ALL SELECT t.series_id, t.t, round(CASE WHEN t.t < lo THEN yf ELSE yl END, 6) FROM t JOIN e ON t.series_id = e.series_id WHERE t.t < lo OR t.t >= hi"""


SMOOTH = "(2 * p * p * p - 3 * p * p + 1) * y + (-2 * p * p * p + 3 * p * p) * y1"


def curve(spark: SparkSession, d: str, mode: str) -> DataFrame:
    e = ev(spark, d)
    keys = e.where("seq % 4 = 0").select("series_id", (F.col("seq") * 3 + 2).alias("seq"), F.col("signal").alias("value"))
    return rounded(I.densify_curve(keys, e.select("series_id", (F.col("seq") * 2).alias("t")), mode))


@registered(curve_sql("y + (y1 - y) * p"))
def g15_densify_linear(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d, "linear")


@registered(curve_sql(SMOOTH))
def g15_densify_hermite(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d, "hermite")


@registered(curve_sql(f"{SMOOTH} + (p * p * p - 2 * p * p + p) * span * m0 + (p * p * p - p * p) * span * m1"))
def g15_densify_monotone(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d, "monotone")


@registered(f"""WITH {CONV}, t AS (SELECT series_id, max("end") - 3 AS total FROM conv GROUP BY series_id), u AS (SELECT series_id, 'speech' AS kind, "start", "end", 1.0 AS strength FROM conv UNION ALL SELECT series_id, speaker, "start", "start", 0.5 FROM conv WHERE seq % 2 = 0),
c AS (SELECT u.series_id, kind, greatest(0, "start") AS "start", least(total, "end") AS "end", strength FROM u JOIN t USING (series_id))
SELECT series_id, kind, round("start", 6) AS "start", round("end", 6) AS "end", strength, CAST(row_number() OVER (PARTITION BY series_id ORDER BY c."start", c."end", kind, strength) AS INT) AS n FROM c WHERE "end" >= "start" """)
def g16_event_timeline(spark: SparkSession, d: str) -> DataFrame:
    t = conv(spark, d)
    speech = t.select("series_id", F.lit("speech").alias("kind"), "start", "end", F.lit(1.0).alias("strength"))
    turns = t.where("seq % 2 = 0").select("series_id", F.col("speaker").alias("kind"), "start", F.col("start").alias("end"), F.lit(0.5).alias("strength"))
    return rounded(I.event_timeline(speech, turns, totals=t.groupBy("series_id").agg((F.max("end") - 3).alias("total"))))


@registered(f"""WITH {SEGMENTS}, m AS (SELECT *, "end" - "start" AS dur, least(5, "end" - "start") AS m FROM segments)
SELECT DISTINCT series_id, segment_id, CASE WHEN m <= 1 THEN "start" ELSE "start" + CAST(round_even(i * (dur - 1) / CAST(m - 1 AS DOUBLE), 0) AS BIGINT) END AS frame FROM (SELECT *, unnest(generate_series(0, m - 1)) AS i FROM m)""")
def d1_even_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.even_sample(segments(spark, d), 5).select("series_id", "segment_id", "frame")


THIN = """even AS (SELECT DISTINCT series_id, CAST(round_even(i * (total - 1) / {b1}.0, 0) AS BIGINT) AS n FROM (SELECT series_id, count(*) AS total FROM {t} GROUP BY series_id) u, generate_series(0, {b1}) g(i) WHERE total > {b}),
thin AS (SELECT * EXCLUDE (n, total) FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY {o}) - 1 AS n, count(*) OVER (PARTITION BY series_id) AS total FROM {t}) x WHERE total <= {b} OR (series_id, n) IN (SELECT (series_id, n) FROM even))"""


@registered(f"WITH {EV}, {THIN.format(t='ev', o='seq', b=16, b1=15)} SELECT series_id, seq FROM thin")
def d3_keyframe_thin(spark: SparkSession, d: str) -> DataFrame:
    return P.keyframe_thin(ev(spark, d), 16).select("series_id", "seq")


@registered(f"""WITH {SPANS}, sh AS (SELECT *, "end" - "start" AS dur, greatest(1, CAST(round_even(48 * ("end" - "start") / CAST(sum("end" - "start") OVER (PARTITION BY series_id) AS DOUBLE), 0) AS INT)) AS share FROM spans),
ts AS (SELECT series_id, CASE WHEN share = 1 THEN "start" + 0.1 * dur + dur * 0.8 / 2 ELSE "start" + 0.1 * dur + dur * 0.8 * i / (share - 1) END AS t FROM (SELECT *, unnest(generate_series(0, share - 1)) AS i FROM sh)), {THIN.format(t='ts', o='t', b=48, b1=47)}
SELECT series_id, round(t, 6) AS t FROM thin""")
def d4_allocate_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.allocate_timestamps(intervals(spark, d), 48))


@registered(f"""WITH {SPANS} SELECT series_id, seq, CAST(row_number() OVER (PARTITION BY series_id ORDER BY "start", seq) AS INT) AS n FROM spans WHERE "end" - "start" >= 35 QUALIFY n <= 6""")
def d5_first_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    return P.first_k_per_group(intervals(spark, d).where("end - start >= 35"), 6, "start", "seq").select("series_id", "seq", "n")


@registered(f"""WITH {FEAT}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seq) AS f, row_number() OVER (PARTITION BY series_id ORDER BY seq DESC) AS l, row_number() OVER (PARTITION BY series_id ORDER BY combined DESC, seq) AS t FROM feat)
SELECT series_id, seq, concat_ws(',', CASE WHEN f = 1 OR l = 1 THEN 'endpoint' END, CASE WHEN asym > 0.95 THEN 'outlier' END, CASE WHEN t <= 8 THEN 'residual' END) AS reasons FROM r WHERE f = 1 OR l = 1 OR asym > 0.95 OR t <= 8""")
def d6_diagnostic_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = feat(spark, d).withColumn("out", F.col("asym") > 0.95)
    return P.diagnostic_topk(rows, "combined", "out").select("series_id", "seq", F.array_join("reasons", ",").alias("reasons"))


@registered(f"""WITH {EV}, b AS (SELECT series_id, max(seq) AS hi, min(CASE WHEN signal > 0.5 THEN seq END) AS m2, max(CASE WHEN signal > 0.5 THEN seq END) AS m3, arg_max(seq, {{'a': signal, 'b': -seq}}) AS m4 FROM ev GROUP BY series_id)
SELECT series_id, array_to_string(list_sort(list_distinct([least(greatest(m, 0), hi) FOR m IN [-1, m2, m3, m4, hi + 5] IF m IS NOT NULL])), ',') AS frames FROM b""")
def d7_phase_frames(spark: SparkSession, d: str) -> DataFrame:
    high = F.when(F.col("signal") > 0.5, F.col("seq"))
    b = ev(spark, d).groupBy("series_id").agg(F.lit(0).cast("long").alias("lo"), F.max("seq").alias("hi"), F.min(high).alias("m2"), F.max(high).alias("m3"), F.max(F.struct("signal", -F.col("seq"), F.col("seq").alias("at")))["at"].alias("m4"))
    b = b.withColumns({"m1": F.lit(-1).cast("long"), "m5": F.col("hi") + 5, "m2": F.coalesce("m2", "m4"), "m3": F.coalesce("m3", "m4")})
    return P.phase_frames(b, "m1", "m2", "m3", "m4", "m5").select("series_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@registered(f"""WITH {SPANS} SELECT series_id, seq, row_number() OVER (PARTITION BY series_id ORDER BY "start", "end", kind) AS place FROM spans""")
def d8_deterministic_order(spark: SparkSession, d: str) -> DataFrame:
    return P.first_k_per_group(intervals(spark, d), 2**31 - 1, "start", "end", "kind").select("series_id", "seq", F.col("n").cast("long").alias("place"))


EVEN = """CASE WHEN m <= 1 THEN a ELSE a + CAST(round_even(i * (dur - 1) / CAST(m - 1 AS DOUBLE), 0) AS BIGINT) END"""


@registered(f"""WITH {SEGMENTS}, cuts AS (SELECT series_id, seq AS f FROM peaks WHERE combined >= 0.55), sp AS (SELECT series_id, "start" AS a, "end" - "start" AS dur, least("end" - "start", 4, greatest(3, least(5, "end" - "start"))) AS m FROM segments),
roles AS (SELECT series_id, "start" AS f, 'first' AS role, 4 AS p, 0 AS s FROM bounds UNION ALL SELECT series_id, "end" - 1, 'last', 4, 1 FROM bounds UNION ALL SELECT series_id, {EVEN}, 'representative', 1, 2 FROM (SELECT *, unnest(generate_series(0, m - 1)) AS i FROM sp)
 UNION ALL SELECT series_id, f - 1, 'pre', 2, 3 FROM cuts UNION ALL SELECT series_id, f, 'boundary', 3, 4 FROM cuts UNION ALL SELECT series_id, f + 1, 'post', 2, 5 FROM cuts UNION ALL SELECT series_id, seq, 'pinned', 5, 6 FROM ev WHERE kind = 'error' AND seq % 20 = 7),
kept AS (SELECT r.series_id, f, arg_max(role, p * 10 - s) AS role, string_agg(DISTINCT role, ',' ORDER BY role) AS reasons FROM roles r JOIN bounds b ON r.series_id = b.series_id AND f >= b."start" AND f < b."end" GROUP BY ALL),
n AS (SELECT series_id, count(*) AS n FROM kept GROUP BY 1), ev0 AS (SELECT DISTINCT series_id, n, {EVEN} AS f FROM (SELECT b.series_id, n, b."start" AS a, b."end" - b."start" AS dur, least(24, b."end" - b."start") AS m, unnest(generate_series(0, least(24, b."end" - b."start") - 1)) AS i FROM bounds b JOIN n ON b.series_id = n.series_id WHERE n < 24)),
fill AS (SELECT series_id, f FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY f) AS k FROM ev0 WHERE (series_id, f) NOT IN (SELECT (series_id, f) FROM kept)) WHERE k <= 24 - n),
everything AS (SELECT * FROM kept UNION ALL SELECT series_id, f, 'interior', 'interior' FROM fill), t AS (SELECT *, role NOT IN ('interior', 'representative') AS protected FROM everything),
u AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS total, sum(CAST(protected AS INT)) OVER (PARTITION BY series_id) AS safe, row_number() OVER (PARTITION BY series_id, protected ORDER BY f) AS k FROM t)
SELECT series_id, f AS frame, role, reasons, protected FROM u WHERE NOT (total > 24 AND safe <= 24 AND NOT protected AND k > 24 - safe)""")
def d2_budgeted_sample(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d).select("series_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    cuts = peaks(spark, d).where("combined >= 0.55").select("series_id", F.col("seq").alias("frame"))
    pins = ev(spark, d).where("kind = 'error' and seq % 20 = 7").select("series_id", F.col("seq").alias("frame"))
    found = P.budgeted_sample(b, segments(spark, d), cuts, pins, 4, 24)
    return found.withColumn("reasons", F.array_join("reasons", ","))


HALVES = f"{EV}, e1 AS (SELECT * FROM ev WHERE seq % 5 <> 0), a1 AS (SELECT series_id, seq, signal * 0.97 + edge * 0.01 AS signal, edge FROM ev WHERE seq % 7 <> 0)"


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = ev(spark, d)
    return e.where("seq % 5 <> 0"), e.where("seq % 7 <> 0").select("series_id", "seq", (F.col("signal") * 0.97 + F.col("edge") * 0.01).alias("signal"), "edge")


@registered(f"""WITH {HALVES} SELECT series_id, seq, round(e1.signal, 6) AS signal_expected, round(a1.signal, 6) AS signal_actual, CASE WHEN e1.signal IS NULL THEN 'actual' WHEN a1.signal IS NULL THEN 'expected' ELSE 'both' END AS side FROM e1 FULL JOIN a1 USING (series_id, seq)""")
def e3_frame_align(spark: SparkSession, d: str) -> DataFrame:
    return rounded(J.frame_align(*halves(spark, d), ("signal",)))


@registered(f"""WITH {EV}, p AS (SELECT series_id, seq, t_seconds AS t FROM ev WHERE kind = 'click'), q AS (SELECT series_id, t_seconds AS t FROM ev WHERE kind = 'view')
SELECT p.series_id, p.seq, round(t, 6) AS t, round((SELECT q.t FROM q WHERE q.series_id = p.series_id ORDER BY abs(q.t - p.t), q.t LIMIT 1), 6) AS nearest FROM p""")
def e5_nearest_timestamp(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).withColumnRenamed("t_seconds", "t")
    return rounded(J.nearest_timestamp(e.where("kind = 'click'").select("series_id", "seq", "t"), e.where("kind = 'view'").select("series_id", "t")))


@registered(f'WITH {SEGMENTS} SELECT e.series_id, e.seq, s.segment_id FROM ev e JOIN segments s ON e.series_id = s.series_id AND e.seq >= s."start" AND e.seq < s."end"')
def e6_point_in_range(spark: SparkSession, d: str) -> DataFrame:
    return J.point_in_range(ev(spark, d).select("series_id", "seq"), segments(spark, d)).select("series_id", "seq", "segment_id")


@registered(f"""WITH {SPANS}, b AS (SELECT series_id, seq AS seq2, "start" + 17 AS start2, "end" + 90 AS end2 FROM spans WHERE kind = 'view')
SELECT a.series_id, a.seq, b.seq2, greatest(a."start", start2) AS overlap_start, least(a."end", end2) AS overlap_end FROM spans a JOIN b ON a.series_id = b.series_id AND a."start" < end2 AND start2 < a."end" WHERE a.kind = 'click'""")
def e7_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals(spark, d)
    left, right = spans.where("kind = 'click'").select("series_id", "seq", "start", "end"), spans.where("kind = 'view'").select("series_id", F.col("seq").alias("seq2"), (F.col("start") + 17).alias("start2"), (F.col("end") + 90).alias("end2"))
    return J.interval_overlap(left, right, width=None).select("series_id", "seq", "seq2", "overlap_start", "overlap_end")


@registered(f"""WITH {SPANS}, q AS (SELECT series_id, seq * 40 + 60 AS moment FROM spans WHERE kind = 'view') SELECT s.series_id, s.seq, EXISTS (SELECT 1 FROM q WHERE q.series_id = s.series_id AND moment >= s."start" AND moment < s."end") AS found FROM spans s""")
def e8_exists_in_range(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals(spark, d)
    points = spans.where("kind = 'view'").select("series_id", (F.col("seq") * 40 + 60).alias("at"))
    return J.exists_in_range(spans, points, order="at").select("series_id", "seq", "found")


@registered(f"""WITH {PEAKS} SELECT e.series_id, e.seq AS frame, coalesce((SELECT min(p.seq) FROM peaks p WHERE p.series_id = e.series_id AND abs(p.seq - e.seq) <= 1), -1) AS near FROM ev e""")
def e9_near_boundary_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = J.near_boundary_lookup(ev(spark, d).select("series_id", F.col("seq").alias("frame")), peaks(spark, d).select("series_id", F.col("seq").alias("frame")))
    return found.withColumn("near", F.coalesce("near", F.lit(-1)))


@registered(f"""WITH {SEGMENTS}, m AS (SELECT series_id, seq % 4 AS k, event_id AS id, kind AS motion_class, signal AS confidence FROM ev WHERE kind <> 'error'), o AS (SELECT series_id, seq % 4 AS k, event_id AS id, kind AS label, edge AS confidence FROM ev WHERE kind = 'view'),
s AS (SELECT series_id, segment_id, ("end" - "start") % 5 AS k, 0.9 AS confidence FROM segments), ml AS (SELECT series_id, k, arg_max(motion_class, id) AS motion_class, arg_max(confidence, id) AS mc FROM m GROUP BY ALL), ol AS (SELECT series_id, k, arg_min(label, id) AS label, arg_min(confidence, id) AS oc FROM o GROUP BY ALL)
SELECT s.series_id, segment_id, motion_class, label, round(least(confidence, coalesce(mc, 0.5), coalesce(oc, 0.5)), 6) AS confidence FROM s LEFT JOIN ml USING (series_id, k) LEFT JOIN ol USING (series_id, k)""")
def e10_assemble_segments(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).withColumn("k", F.col("seq") % 4)
    motion = e.where("kind <> 'error'").select("series_id", "k", F.col("event_id").alias("id"), F.col("kind").alias("motion_class"), F.col("signal").alias("confidence"))
    seen = e.where("kind = 'view'").select("series_id", "k", F.col("event_id").alias("id"), F.col("kind").alias("label"), F.col("edge").alias("confidence"))
    s = segments(spark, d).select("series_id", "segment_id", ((F.col("end") - F.col("start")) % 5).alias("k"), F.lit(0.9).alias("confidence"))
    return rounded(J.assemble_segments(s, motion, seen, ("series_id", "k")).select("series_id", "segment_id", "motion_class", "label", "confidence"))


@registered(f"""WITH {CONV}, a AS (SELECT series_id, max("end") AS span FROM conv WHERE speaker = 'system' GROUP BY series_id), b AS (SELECT series_id, count(*) * 2.0 AS span FROM conv WHERE seq > 2 GROUP BY series_id)
SELECT c.series_id, CASE WHEN a.span IS NOT NULL THEN 'transcript' WHEN b.span IS NOT NULL THEN 'silence' END AS method, round(coalesce(a.span, b.span), 6) AS span FROM (SELECT DISTINCT series_id FROM conv) c LEFT JOIN a USING (series_id) LEFT JOIN b USING (series_id)""")
def e11_prefer_source(spark: SparkSession, d: str) -> DataFrame:
    t = conv(spark, d)
    first = t.where("speaker = 'system'").groupBy("series_id").agg(F.max("end").alias("span")).withColumn("method", F.lit("transcript"))
    second = t.where("seq > 2").groupBy("series_id").agg((F.count("*") * 2.0).alias("span")).withColumn("method", F.lit("silence"))
    return J.prefer_source(t, first, second).select("series_id", "method", r6("span").alias("span"))


@registered(f"""WITH {EV}, r AS (SELECT series_id, kind FROM (SELECT DISTINCT series_id FROM ev), (SELECT DISTINCT kind FROM ev WHERE kind <> 'view')), p AS (SELECT DISTINCT series_id, kind FROM ev WHERE seq % 9 < 3)
SELECT *, 'missing' AS problem FROM (FROM r EXCEPT FROM p) UNION ALL SELECT *, 'extra' FROM (FROM p EXCEPT FROM r)""")
def e12_missing_required(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    kinds = e.where("kind <> 'view'").select("kind", F.lit(1).alias("one")).distinct()  # event types, a handful
    required = e.select("series_id", F.lit(1).alias("one")).distinct().join(F.broadcast(kinds), "one").drop("one")
    return J.missing_required(required, e.where("seq % 9 < 3"), ("series_id", "kind"))


@registered("""WITH n AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 4 <> 1), e AS (SELECT c_custkey AS src, c_nationkey AS dst FROM customer UNION ALL SELECT s_nationkey, s_suppkey FROM supplier)
SELECT src, dst, 'no src' AS problem FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT src, dst, 'no dst' FROM e WHERE dst NOT IN (SELECT id FROM n)""")
def e14_dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("id"))
    edges = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("dst")))
    return J.dangling_edges(nodes, edges)


@registered("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), up AS (SELECT 'c' || c_custkey AS id, 'c' || c_custkey AS ancestor, 0 AS steps FROM customer
UNION ALL SELECT id, parent, steps + 1 FROM up JOIN e ON ancestor = child WHERE steps < 16) SELECT id, ancestor, steps FROM up""")
def e15_version_chain(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    c = table(spark, d, "customer")
    edges = c.select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")).unionByName(table(spark, d, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")))
    return J.version_chain(edges, c.select(name("c", "c_custkey").alias("id")))
