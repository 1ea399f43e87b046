"""Benchmark decontamination with DataFrame functions only.

Every window of L words (13, or all words of a shorter item) holds exactly one run of g words that starts at a multiple of
k = L - g + 1. So a document is probed at each k-th word only, its probes meet a hash set of the benchmark's runs, and the
windows around a meeting meet the benchmark's windows word by word. Nothing is missed and nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, hot_join, without

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters a-z (A-Z in lower case) and non-ASCII characters. Null: none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAKS), ""), F.array().cast("array<string>"))


def run_of(length: int) -> tuple[int, int]:
    """(g, k) for windows of so many words."""
    g = max(1, min(5, length // 2))
    return g, length - g + 1


def item_windows(benchmark: DataFrame, item_col: str, text: str, window: int) -> DataFrame:
    """(wid, len, win, w, items): each distinct window of the benchmark, its words, and the items that hold it."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("len", F.least(F.size("w"), F.lit(window)))
    windows = words.select("item", "len", F.explode(F.expr("transform(sequence(1, size(w) - len + 1), s -> slice(w, s, len))")).alias("w"))
    windows = windows.groupBy("len", "w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return windows.select(F.monotonically_increasing_id().alias("wid"), "len", F.array_join("w", " ").alias("win"), "w", "items")


def runs_of(windows: DataFrame) -> DataFrame:
    """(len, h, ats): the hash of each run of the windows once, with the places in a window at which it stands.

    A run that very many windows share, such as a template in all items, is one row; which of them is meant is told by the whole window.
    """
    g = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("len") / 2))).cast("int")
    runs = windows.select("len", "w", g.alias("g")).select("len", "w", "g", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("g"))).alias("at"))
    return runs.groupBy("len", F.expr("xxhash64(slice(w, at + 1, g))").alias("h")).agg(F.array_sort(F.collect_set("at")).alias("ats"))


def report(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, max_broadcast_rows: int = 500_000, max_broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """For each row of docs: id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated and spans.

    A document word inside any occurrence of a window is hit; contaminated means n_hit > 0 and 20 n_hit >= n_words. spans
    are the [start, end) word numbers of the windows found. Null, empty or wordless texts have no words and no hit; a
    repeated row is reported once for each time it occurs; a repeated item counts once; an item without an id hits but is not listed.
    A probe meets its run, then each place of the run makes one window, which meets the window of the same words: at most 9 rows
    a probe and one a window, however many windows share a run. Runs and windows are broadcast if the runs number
    ``max_broadcast_rows`` and the windows' texts take ``max_broadcast_bytes`` or less; beyond that the joins are Spark's to plan.
    One pass over docs; what is shuffled is one narrow row a document and one for each window found. Items join last.
    """
    windows = cut(item_windows(benchmark, item_col, item_text, window))
    runs = cut(runs_of(windows))
    size = windows.agg(F.sum(F.octet_length("win")).alias("bytes"), F.sum(F.size("items")).alias("items")).first()
    small = runs.count() <= max_broadcast_rows and (size["bytes"] or 0) <= max_broadcast_bytes
    near_by = F.broadcast if small else lambda df: df
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    pad = window - 1
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), words_of(F.col(text)).alias("w")
    ).withColumns({"n": F.size("w"), "padded": F.expr(f"concat(array_repeat('', {pad}), w, array_repeat('', {pad}))")})
    probes = ["array(named_struct('len', 0, 'p', 0, 'h', cast(0 as bigint), 'near', cast(array() as array<string>)))"]
    for length in lengths:
        g, k = run_of(length)
        # p counts from 1; near: the k - 1 words before the run, the run, and the k - 1 words after it
        probes.append(
            f"if(n >= {g}, transform(sequence(1, greatest(n - {g} + 1, 1), {k}), p -> named_struct('len', {length}, 'p', p, 'h', xxhash64(slice(w, p, {g})), 'near', slice(padded, p + {pad - k + 1}, {g + 2 * (k - 1)}))), array())"
        )
    met = rows.select("id", "text_hash", "n", F.explode(F.expr(f"concat({', '.join(probes)})")).alias("x")).select("id", "text_hash", "n", "x.*")
    met = met.join(near_by(runs), ["len", "h"], "left").where((F.col("len") == 0) | F.col("ats").isNotNull())
    met = met.select("id", "text_hash", "n", "len", "p", "near", F.explode_outer("ats").alias("at"))
    # the window starts at word (before the run) - at of near, which has len - g words before the run
    k = F.col("len") - F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("len") / 2))).cast("int") + 1
    start = F.col("p") - F.col("at")
    inside = (start >= 1) & (start + F.col("len") - 1 <= F.col("n"))
    met = met.withColumns({"start": start - 1, "win": F.when(inside, F.array_join(F.slice("near", F.greatest(k - F.col("at"), F.lit(1)), F.greatest("len", F.lit(1))), " "))})
    met = met.join(near_by(windows.select("len", "win", "wid")), ["len", "win"], "left").where((F.col("len") == 0) | F.col("wid").isNotNull())
    span = F.when(F.col("wid").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end")))
    # rows of one id and text have the same hits; each brought one entry of length 0, which tells how many there are
    found = met.groupBy("id", "text_hash", "n").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("wid").alias("wids"), F.count(F.when(F.col("len") == 0, 1)).cast("int").alias("copies"))
    found = cut(found)
    hits = found.where(F.size("wids") > 0).select("id", "text_hash", F.explode("wids").alias("wid"))
    named = windows.select("wid", "items")
    if (size["items"] or 0) <= 10 * max_broadcast_rows and small:
        listed = hits.join(F.broadcast(named), "wid")
    else:
        named = cut(named.join(hits.groupBy("wid").agg(F.count(F.lit(1)).alias("n_hits")), "wid"))
        listed = hot_join(hits, named, "wid", "n_hits")
    listed = listed.groupBy("id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.alias("f").join(listed.alias("l"), F.expr("f.id <=> l.id and f.text_hash = l.text_hash"), "left").select("f.*", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    hit = "aggregate(spans, named_struct('n', 0L, 'reach', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.end - greatest(x.start, a.reach)), 'reach', greatest(a.reach, x.end)), a -> a.n)"
    found = found.withColumns({"n_words": F.col("n").cast("long"), "n_hit": F.expr(hit)})
    return found.select(
        F.col("id").alias(id_col),
        "text_hash",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns and texts they came with."""
    bad = report(docs, benchmark, id_col, text, **options).where("contaminated").select(F.col(id_col).alias("__cf_id"), F.col("text_hash").alias("__cf_hash")).distinct()
    return without(docs, bad, docs[id_col].eqNullSafe(F.col("__cf_id")) & (F.xxhash64(docs[text]) == F.col("__cf_hash")))
