"""Queries of the ordered folds, and of the streams run over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoform.functions import scalar
from chronoform.operators import grouped as G
from chronoform.operators import series as S

from .fixtures import CONV, EV, conv, ev, feat, table
from .registry import registered, rounded
from .series_queries import DAILY, GROUPS, daily, peaks

TRANSITION_SQL = f"""WITH {GROUPS}, g AS (SELECT series_id, "start" AS g0, "end" AS g1 FROM grouped WHERE "start" >= 1),
c AS (SELECT g.*, f.seq, f.pixel, f.hist, f.asym, f.combined, f.signal AS luminance, f.seq >= g0 AND f.seq < g1 AS ins FROM g JOIN feat f ON g.series_id = f.series_id AND f.seq >= greatest(1, g0 - 3) AND f.seq < g1 + 3),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, g0, g1 ORDER BY CASE WHEN g1 - g0 >= 4 THEN CASE WHEN seq = g0 + (g1 - g0) // 2 THEN 1.0 END ELSE combined END DESC NULLS LAST, seq) AS k FROM c WHERE ins),
a AS (SELECT series_id, g0, g1, coalesce(avg(combined) FILTER (WHERE NOT ins), 0) AS neighbor, list(luminance ORDER BY seq) AS lum, max(luminance) FILTER (WHERE seq = g0 - 1) AS pre, max(luminance) FILTER (WHERE seq = g1) AS post, avg(pixel) FILTER (WHERE ins) AS mp, avg(hist) FILTER (WHERE ins) AS mh, max(asym) FILTER (WHERE ins) AS ma FROM c GROUP BY ALL),
b AS (SELECT a.*, a.g1 - a.g0 AS n, i.pixel, i.hist, i.asym, i.combined, [lum[j + 1] - lum[j] FOR j IN generate_series(1, len(lum) - 1)] AS st FROM a JOIN r i ON a.series_id = i.series_id AND a.g0 = i.g0 AND a.g1 = i.g1 AND k = 1),
d AS (SELECT *, greatest(len([x FOR x IN st IF x >= -0.005]), len([x FOR x IN st IF x <= 0.005])) / greatest(len(st), 1) AS mono, list_max(lum) - greatest(pre, post) AS rise FROM b),
t AS (SELECT *, CASE WHEN n <= 3 AND pre IS NOT NULL AND post IS NOT NULL AND rise >= 0.30 AND abs(pre - post) <= 0.08 AND pixel >= 0.15 THEN 1 WHEN n >= 4 AND len(lum) >= 5 AND mono >= 0.75 AND list_min(lum) < 0.12 THEN 2 WHEN n >= 24 THEN 3 WHEN n >= 4 AND ma >= 0.25 AND mp >= 0.04 THEN 4 WHEN n >= 4 AND mh >= 0.08 THEN 5
 WHEN n <= 2 AND hist >= 0.35 AND neighbor <= greatest(0.08, 0.45 * combined) THEN 6 WHEN asym >= 0.3 AND pixel >= 0.05 THEN 7 WHEN neighbor >= 0.035 AND hist >= 0.12 THEN 8 WHEN pixel >= 0.04 AND hist < 0.12 THEN 9 ELSE 10 END AS rule FROM d), e AS (SELECT series_id, max(seq) + 1 AS hi FROM ev GROUP BY 1)
SELECT t.series_id, g0 AS "start", g1 AS "end", CASE rule WHEN 1 THEN 'flash' WHEN 2 THEN CASE WHEN lum[-1] < lum[1] THEN 'fade-out' ELSE 'fade-in' END WHEN 3 THEN 'continuous' WHEN 4 THEN 'wipe' WHEN 5 THEN 'dissolve' WHEN 6 THEN 'hard-cut' WHEN 7 THEN 'wipe' WHEN 8 THEN 'dissolve' WHEN 9 THEN 'continuous' ELSE 'unknown' END AS type,
 round(greatest(0, least(1, CASE rule WHEN 1 THEN least(0.98, 0.65 + 0.2 * rise + 0.1 * pixel) WHEN 2 THEN least(0.9, 0.55 + 0.35 * mono) WHEN 3 THEN least(0.82, 0.5 + mp + 0.2 * mh) WHEN 4 THEN least(0.88, 0.52 + 0.32 * ma) WHEN 5 THEN least(0.88, 0.52 + 0.25 * mh) WHEN 6 THEN least(0.99, 0.55 + 0.25 * hist + 0.15 * pixel)
 WHEN 7 THEN least(0.85, 0.5 + 0.35 * asym) WHEN 8 THEN least(0.85, 0.5 + 0.25 * hist + neighbor) WHEN 9 THEN least(0.75, 0.45 + pixel) ELSE least(0.6, greatest(0.2, combined)) END)), 6) AS confidence, greatest(0, g0 - 4) AS win_start, least(hi, g1 + 4) AS win_end FROM t JOIN e ON t.series_id = e.series_id"""


@registered(TRANSITION_SQL)
def c6_classify_transition(spark: SparkSession, d: str) -> DataFrame:
    f = feat(spark, d)
    groups = S.group_candidates(peaks(spark, d), S.isolated_impulses(f, "combined"))
    return rounded(G.classify_transition(groups.where("start >= 1"), f.withColumn("luminance", F.col("signal"))))


@registered(f"""WITH RECURSIVE {EV}, s AS (SELECT series_id, seq * 0.06 + edge * 0.0437 AS t, signal FROM ev), rs AS (SELECT *, greatest(0, coalesce(signal - lag(signal) OVER (PARTITION BY series_id ORDER BY t), 0)) AS rise FROM s),
st AS (SELECT *, rise / max(rise) OVER (PARTITION BY series_id) AS strength FROM rs), ok AS (SELECT series_id, t, strength FROM st WHERE rise > 0 AND rise >= 0.05), nxt AS (SELECT a.series_id, a.t, a.strength, min(b.t) AS nt FROM ok a LEFT JOIN ok b ON a.series_id = b.series_id AND b.t - a.t >= 0.15 GROUP BY ALL),
kept AS (SELECT series_id, t, strength, nt FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM nxt) WHERE k = 1 UNION ALL SELECT n.series_id, n.t, n.strength, n.nt FROM kept JOIN nxt n ON kept.series_id = n.series_id AND kept.nt = n.t)
SELECT series_id, round(t, 6) AS t, round(strength, 6) AS strength, CASE WHEN strength >= 0.75 THEN 'accent' ELSE 'onset' END AS kind FROM kept""")
def c12_energy_onsets(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).select("series_id", (F.col("seq") * 0.06 + F.col("edge") * 0.0437).alias("t_seconds"), "signal")
    return rounded(G.energy_onsets(e, e.select("series_id").distinct().withColumn("threshold", F.lit(0.05))))


WEIGHTS = str(G.polynomial_weights(15, 3).tolist())  # [place][coefficient][row]
FITTED = f"""{DAILY}, n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS total FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY seq)), s AS (SELECT *, greatest(0, least(i - 7, total - 15)) AS a FROM n),
x AS (SELECT s.series_id, s.seq, any_value(s.i) AS i, any_value(s.total) AS total, any_value(s.signal) AS signal, any_value(s.i - s.a) AS place, list(t.signal ORDER BY t.i) AS xs FROM s JOIN n t ON s.series_id = t.series_id AND t.i >= s.a AND t.i < s.a + 15 GROUP BY ALL),
c AS (SELECT *, [list_inner_product(xs, ({WEIGHTS})[place + 1][k]) FOR k IN [1, 2, 3, 4]] AS c FROM x)"""


@registered(f"WITH {FITTED} SELECT series_id, seq, round(c[2] * 25, 6) AS velocity, round(c[3] * 1250, 6) AS acceleration, round(c[4] * 93750, 6) AS jerk FROM c")
def c15_local_poly_derivatives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.local_polynomial(daily(spark, d), 25.0).select("series_id", "seq", "velocity", "acceleration", "jerk"))


@registered(f"WITH {FITTED} SELECT series_id, seq, round(CASE WHEN i = 0 OR i = total - 1 THEN signal ELSE c[1] END, 6) AS smooth FROM c")
def c16_local_poly_smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.local_polynomial(daily(spark, d), 25.0).select("series_id", "seq", "smooth"))


@registered()
def c21_similarity_coupling(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).withColumns({"cx": F.col("signal") + F.col("seq") * 0.05, "cy": F.col("edge") * 0.1 + F.col("seq") * 0.02, "sc": 1 + F.col("seq") * 0.03 + F.col("signal") * 0.1, "ro": F.col("seq") * 0.5 + F.col("edge")})
    return rounded(G.similarity_coupling(e, 25.0, "cx", "cy", "sc", "ro"))


@registered(f"""WITH RECURSIVE {EV}, st AS (SELECT series_id, seq, signal - 0.1 AS dx, edge / 5 - 0.1 AS dy, 0.9 + edge / 5 AS f FROM ev), w AS (SELECT series_id, seq, least(1, greatest(0, 0.5 + dx)) AS x, least(1, greatest(0, 0.5 + dy)) AS y, least(4.0, greatest(0.25, f)) AS scale FROM st WHERE seq = 0
UNION ALL SELECT st.series_id, st.seq, least(1, greatest(0, x + dx)), least(1, greatest(0, y + dy)), least(4.0, greatest(0.25, scale * f)) FROM w JOIN st ON w.series_id = st.series_id AND st.seq = w.seq + 1), l AS (SELECT series_id, max(seq) AS last FROM st GROUP BY 1)
SELECT w.series_id, seq AS n, round(x, 6) AS x, round(y, 6) AS y, round(scale, 6) AS scale FROM w JOIN l ON w.series_id = l.series_id WHERE seq IN (0, CAST(round_even(last / 4, 0) AS BIGINT), CAST(round_even(last / 2, 0) AS BIGINT), CAST(round_even(3 * last / 4, 0) AS BIGINT), last)""")
def c26_integrate_transform(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d).withColumns({"dx": F.col("signal") - 0.1, "dy": F.col("edge") / 5 - 0.1, "f": 0.9 + F.col("edge") / 5})
    return rounded(G.integrate_transform(e, "dx", "dy", "f"))


@registered(f"""WITH {EV}, v AS (SELECT series_id, seq, sum(signal) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS x FROM ev), l AS (SELECT series_id, max(seq) AS last, arg_min(x, seq) AS a, arg_max(x, seq) AS b FROM v GROUP BY series_id HAVING max(seq) >= 6),
g AS (SELECT unnest([-6, -4, -2, 0, 2, 4, 6]) AS k), c AS (SELECT l.*, e.k AS early, t.k AS tail, last // 3 AS o1, 2 * last // 3 AS o2, last // 3 + e.k AS s1, 2 * last // 3 + t.k AS s2 FROM l, g e, g t WHERE last // 3 + e.k > 0 AND 2 * last // 3 + t.k > last // 3 + e.k AND 2 * last // 3 + t.k < last),
r AS (SELECT *, unnest(generate_series(0, last)) AS o FROM c), p AS (SELECT *, CASE WHEN o <= o1 THEN s1 * o / CAST(o1 AS DOUBLE) WHEN o <= o2 THEN s1 + (s2 - s1) * (o - o1) / CAST(o2 - o1 AS DOUBLE) ELSE s2 + (last - s2) * (o - o2) / CAST(last - o2 AS DOUBLE) END AS at_ FROM r),
m AS (SELECT p.series_id, early, tail, sqrt(avg(pow(lo.x + (hi.x - lo.x) * (at_ - floor(at_)) - (a + (b - a) * o / last), 2))) AS error FROM p JOIN v lo ON lo.series_id = p.series_id AND lo.seq = floor(at_) JOIN v hi ON hi.series_id = p.series_id AND hi.seq = ceil(at_) GROUP BY ALL)
SELECT series_id, early, tail, round(error, 6) AS error, abs(early) + abs(tail) AS bend FROM m QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(error, 9), abs(early) + abs(tail), abs(early), early, tail) = 1""")
def c32_search_phase_warp(spark: SparkSession, d: str) -> DataFrame:
    w = S.along().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = ev(spark, d).select("series_id", "seq", F.sum("signal").over(w).alias("signal"))
    return rounded(G.search_phase_warp(e, (-6, -4, -2, 0, 2, 4, 6)))


@registered(f"""WITH RECURSIVE {CONV}, sc AS (SELECT series_id, list("end" - "start" ORDER BY seq) AS w, list(CAST(round_even(("start" + 1.7) * 25, 0) AS BIGINT)) AS pauses, CAST(round_even(max("end") * 25, 0) AS BIGINT) AS frames FROM conv GROUP BY series_id),
c AS (SELECT *, len(w) AS n, [list_sum([greatest(0.5, v) FOR v IN w[1:i]]) FOR i IN generate_series(1, len(w))] AS cum FROM sc),
walk AS (SELECT series_id, 0 AS i, CAST(0 AS BIGINT) AS last, CAST([0] AS BIGINT[]) AS cues FROM c UNION ALL
 SELECT series_id, i + 1, cue, list_append(cues, cue) FROM (SELECT series_id, i, cues, greatest(lo, least(hi, coalesce(pick, want))) AS cue FROM (SELECT *, (SELECT arg_min(p, abs(p - want) * 1000000.0 + p) FROM (SELECT unnest(pauses) AS p) WHERE p BETWEEN lo AND hi) AS pick FROM
  (SELECT w.series_id, w.i, w.cues, c.pauses, w.last + 1 AS lo, c.frames - (c.n - 1 - w.i) AS hi, CAST(round_even(c.frames * c.cum[w.i + 1] / c.cum[c.n], 0) AS BIGINT) AS want FROM walk w JOIN c ON w.series_id = c.series_id WHERE w.i < c.n - 1 AND c.frames >= c.n))))
SELECT c.series_id, coalesce(array_to_string(list_append(cues, frames), ','), '') AS bounds FROM c LEFT JOIN walk w ON w.series_id = c.series_id AND w.i = c.n - 1 AND c.frames >= c.n""")
def g11_silence_cues(spark: SparkSession, d: str) -> DataFrame:
    t = conv(spark, d)
    scripts = t.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", (F.col("end") - F.col("start")).alias("w")))), lambda x: x["w"]).alias("weights"), F.collect_list(F.bround((F.col("start") + 1.7) * 25).cast("long")).alias("silences"), F.bround(F.max("end") * 25).cast("long").alias("frames"))
    return G.silence_cues(scripts).withColumn("bounds", F.coalesce(F.array_join(F.transform("bounds", lambda x: x.cast("string")), ","), F.lit("")))


@registered()
def g12_align_to_script(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("s", scalar.normalize_words("text"))
    side = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "s")))), lambda x: x["s"])
    scripts = c.groupBy(F.col("conv_id").alias("series_id")).agg(side("user").alias("beats"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]).alias("segments"))
    return rounded(G.align_to_script(scripts).withColumn("ends", F.array_join(F.transform("ends", lambda x: x.cast("string")), ",")))


def long_words(text: str) -> float:
    return sum(len(w) > 8 for w in text.split())


def first_number(text: str) -> float:
    return float(next(w for w in text.split() if w.isdigit()))


@registered(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS w FROM documents), n AS (SELECT doc_id, [x FOR x IN w IF regexp_full_match(x, '[0-9]+')][1] AS d FROM t)
SELECT doc_id, 'long_words' AS kind, true AS ok, CAST(len([x FOR x IN w IF length(x) > 8]) AS DOUBLE) AS value, '' AS error_type FROM t WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'first_number', d IS NOT NULL, coalesce(CAST(d AS DOUBLE), -1), CASE WHEN d IS NULL THEN 'StopIteration' ELSE '' END FROM n""")
def h4_run_analyzers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    done = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("long_words").alias("kind"))
    found = G.run_analyzers(docs, {"long_words": long_words, "first_number": first_number}, "doc_id", "text", done)
    return found.select("doc_id", "kind", "ok", F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce("error_type", F.lit("")).alias("error_type"))
