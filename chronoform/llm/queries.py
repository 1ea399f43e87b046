"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, embedding_dedup, language, license_scan, max_sketch, mixing, quotation, secret_scan, simhash, token_files, toxicity, warc
from .quotation import DATED, NAMES
from .common import crc_mod, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    profiles = language.fit_profiles(docs.where(~F.coalesce(held_out, F.lit(False))))
    return language.identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE["op2_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM iw),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, ns WHERE len(w) >= n),
hit AS (SELECT dw.r, dw.n, dw.s, win.item_id FROM dw JOIN win ON dw.n = win.n AND array_to_string(dw.w[dw.s:dw.s + dw.n - 1], ' ') = win.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query
def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).drop("url", "payload")


ORACLE["op3_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, count(*) AS n, max(page_id) AS first FROM p GROUP BY h),
b AS (SELECT h, array_to_string(list_transform(generate_series(1, 40), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(h, i, 1))]), '') AS bits FROM f),
d AS (SELECT h, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS digest FROM b)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (h) JOIN d USING (h)"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


ORACLE["op5_license_scan"] = license_scan.oracle()


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE["op6_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS size FROM v WHERE x IS NOT NULL AND list_bool_and(list_transform(x, lambda a: a IS NOT NULL AND isfinite(a))) AND list_bool_or(list_transform(x, lambda a: a <> 0))),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.a"""


@query
def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.in_order(mixing.mix(table(spark, sf_dir, "documents")))
    billionths = F.transform("positions", lambda p: F.floor(p * 1e9 + 0.5).cast("string"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get(billionths, F.lit(0)).cast("long").alias("position"), F.array_join(billionths, ",").alias("positions"))


ORACLE["op7_curriculum_mix"] = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))) AS rank, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
  [-0.5, 0.0, 0.5][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS slope FROM d GROUP BY source),
l AS (SELECT *, sum(source_size) OVER () AS total, (sum(source_size) OVER () - 3 * (sum(source_size) OVER f - source_size)) / CAST(sum(w) OVER () - sum(w) OVER f + w AS DOUBLE) AS level
  FROM s WINDOW f AS (ORDER BY source_size / CAST(w AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, slope, CASE WHEN level * w > 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
  ELSE CAST(total - 3 * coalesce(sum(source_size) FILTER (WHERE level * w > 3 * source_size) OVER (), 0) AS DOUBLE) * w / sum(w) FILTER (WHERE NOT level * w > 3 * source_size) OVER () END AS target FROM l),
p AS (SELECT d.*, source_size, target, slope, sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start, CAST(floor(target / source_size + 1e-9) AS BIGINT) AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, floor(target + 1e-6) - whole * source_size - start)) AS part FROM p),
y AS (SELECT *, list_transform(range(CAST(CASE WHEN size > 0 THEN whole + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT)), lambda k: CAST(greatest(0.0, least(1.0, (k * source_size + start + size / 2.0::DOUBLE) / target)) AS DOUBLE)) AS ys FROM q),
z AS (SELECT *, list_transform(ys, lambda y: CAST(floor((CASE WHEN slope = 0 THEN y ELSE (sqrt(greatest(0.0, pow(1 - slope, 2) + 4 * slope * y)) - (1 - slope)) / (2 * slope) END) * 1e9 + 0.5) AS BIGINT)) AS turns FROM y)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken, turns[1] AS position, array_to_string(turns, ',') AS positions FROM z"""


@query
def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(table(spark, sf_dir, "conversations"))


ORACLE["op8_quotation_links"] = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id AS conv, turn, role, text FROM conversations),
l0 AS (SELECT r, conv, turn, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS pos FROM m WHERE text IS NOT NULL),
l1 AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS lev, regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '') AS content FROM l0),
l2 AS (SELECT *, lag(lev, 1, -1) OVER w <> lev AS fresh, lev = 0 AND lead(lev, 1, 0) OVER w > 0 AND regexp_matches(line, '""" + NAMES + r"""$') AS names FROM l1 WINDOW w AS (PARTITION BY r ORDER BY pos)),
l3 AS (SELECT *, names OR (lev = 0 AND lead(names, 1, false) OVER (PARTITION BY r ORDER BY pos) AND regexp_matches(line, '^""" + DATED + r""".*[0-9]') AND NOT regexp_matches(line, '[.!?:; \t]$')) AS named, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM l2),
quotes AS (SELECT r, conv, turn, lev, run, string_agg(content, chr(10) ORDER BY pos) AS t FROM l3 WHERE lev > 0 GROUP BY ALL),
own AS (SELECT r, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE lev = 0 AND NOT named), ''), ' ' || chr(9) || chr(13) || chr(10)) AS body FROM l3 GROUP BY r HAVING max(lev) > 0),
bodies AS (SELECT m.*, coalesce(own.body, text) AS body FROM m LEFT JOIN own USING (r)),
piece AS (SELECT k, a, conv, turn, lev, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS x FROM
  (SELECT k, a, conv, turn, lev, unnest(list_concat([t], string_split_regex(t, '\n[ \t]*\n+'), string_split_regex(t, '\r?\n'), string_split_regex(t, '[.!?]+[ \t\r\n]+'))) AS x FROM
    (SELECT 'quote' AS k, r * 1000000 + run AS a, conv, turn, lev, t FROM quotes UNION ALL SELECT 'own', r, conv, turn, 0, body FROM bodies WHERE body IS NOT NULL))),
pieces AS (SELECT DISTINCT * FROM piece WHERE x <> '' AND conv IS NOT NULL AND turn IS NOT NULL),
met AS (SELECT q.a // 1000000 AS r, q.conv, q.turn, q.lev, q.a, q.x, max(o.turn) AS source FROM pieces q JOIN pieces o ON o.k = 'own' AND q.conv = o.conv AND q.x = o.x AND o.turn < q.turn WHERE q.k = 'quote' GROUP BY ALL),
scored AS (SELECT r, conv, turn, lev, source, sum(len(string_split(x, ' '))) AS words FROM met GROUP BY ALL),
linked AS (SELECT r, conv, turn, source AS reply_to, (SELECT count(DISTINCT source) FROM scored s WHERE s.r = scored.r) AS n_linked FROM scored QUALIFY row_number() OVER (PARTITION BY r ORDER BY lev, words DESC, source DESC) = 1),
nodes AS (SELECT conv, turn, max(reply_to) AS up FROM linked GROUP BY ALL),
walk AS (SELECT conv, turn, up AS top, 1 AS depth, [up, turn] AS path FROM nodes
  UNION ALL SELECT walk.conv, walk.turn, nodes.up, depth + 1, list_prepend(nodes.up, path) FROM walk JOIN nodes ON walk.conv = nodes.conv AND walk.top = nodes.turn),
far AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY depth DESC) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv, top ORDER BY path) - 1 AS thread_order FROM (SELECT conv, turn, top, depth, path FROM far UNION SELECT conv, top, top, 0, [top] FROM far)),
n AS (SELECT r, count(*) AS n FROM quotes WHERE trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')) <> '' GROUP BY r)
SELECT b.conv AS conv_id, b.turn, b.role, b.body, coalesce(n.n, 0) AS n_quotes, coalesce(linked.n_linked, 0) AS n_linked, linked.reply_to, coalesce(placed.top, b.turn) AS root_turn, CAST(coalesce(placed.depth, 0) AS BIGINT) AS depth, CAST(coalesce(placed.thread_order, 0) AS BIGINT) AS thread_order
FROM bodies b LEFT JOIN n USING (r) LEFT JOIN linked ON b.r = linked.r LEFT JOIN placed ON b.conv = placed.conv AND b.turn = placed.turn"""


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.regexp_count("base_spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), F.col("all_spans").alias("spans"), "unopened")


@query
def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


@query
def op13_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_max_sketch"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM s) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t GROUP BY term),
x AS (SELECT q.item_id, t.r, t.doc_id, CAST(sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + (50 * t.n * (SELECT n FROM s)) // CAST((SELECT l FROM s) AS BIGINT))))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))
