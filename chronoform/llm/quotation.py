"""Quotation linking in conversations, with DataFrame functions only.

Quoted lines (``>``, nested levels ``>>``) are cut into passages; normalised passages and lines are hashed and meet the messages of the
same conversation that they were copied from; the message that gave most words is the one replied to. Threads are numbered in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut

QUOTED = r"(?md)^[ \t]*>"  # d: lines end at \n alone
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
#: How a line ends that names whom the quote below it is from, in English, German, French and Spanish.
NAMES = r"(?:\b(?:wrote|writes|said)|\bschrieb\b[^\n]{0,100}|\ba écrit ?|\bescribió ?):[ \t]*"
#: How such a line starts that is wrapped into two, with a date in the first.
DATED = r"(?:On|Am|Le|El)[ \t]"
ATTRIBUTION = rf"(?md)^(?:{DATED}(?=[^\n]*[0-9])[^\n]*+(?<![.!?:; \t]\r?)\n)?[ \t]*+(?!>)[^\n]*{NAMES}\r?\n(?=[ \t]*>)"
PARAGRAPHS = r"\n[ \t]*\n+"
SENTENCES = r"[.!?]+[ \t\r\n]+"  # over line ends, so a part quoted in other lines is found


def normal(text: Column) -> Column:
    """Lower case, letters and digits only, single blanks: what stays equal when a text is quoted and wrapped anew."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def without_quotes(text: Column) -> Column:
    """The lines that are no quotes, without the line, or two if it is wrapped, that names whom they quote."""
    kept = F.regexp_replace(F.regexp_replace(text, ATTRIBUTION, ""), r"(?md)^[ \t]*>[^\n]*(?:\n|\z)", "")
    return F.btrim(kept, F.lit(" \t\r\n"))


def passages(messages: DataFrame) -> DataFrame:
    """(row, conv, turn, level, passage): runs of lines of one quote level, in messages(row, conv, turn, text)."""
    lines = messages.where(F.col("text").rlike(QUOTED)).select("row", "conv", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    lines = lines.withColumns({"level": F.length(F.regexp_replace(marks, r"[^>]", "")), "line": F.regexp_replace("line", MARKS, "")})
    order = Window.partitionBy("row").orderBy("pos")
    lines = lines.withColumn("run", F.sum((F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")).over(order)).where("level > 0")
    found = lines.groupBy("row", "conv", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return found.select("row", "conv", "turn", "level", F.array_join(F.col("lines.line"), "\n").alias("passage"))


def pieces(text: Column) -> Column:
    """What of a text can be recognised: its paragraphs, its lines, its sentences and all of it, normalised and distinct."""
    parts = F.concat(F.array(text), F.split(text, PARAGRAPHS), F.split(text, r"\r?\n"), F.split(text, SENTENCES))
    return F.array_remove(F.array_distinct(F.transform(parts, normal)), "")


def keyed(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """rows exploded to (columns, conv, turn, hash, words) by pieces of the text; two hashes, so different pieces do not meet."""
    rows = rows.select(*columns, "conv", "turn", F.explode(pieces(F.col(text))).alias("piece"))
    key = F.concat_ws(":", F.xxhash64("piece"), F.xxhash64(F.lit("second"), "piece"))
    return rows.select(*columns, "conv", "turn", key.alias("hash"), F.size(F.split("piece", " ")).cast("long").alias("words"))


def latest_source(quoted: DataFrame, own: DataFrame, span: int) -> DataFrame:
    """quoted with ``source``: the latest earlier turn of the conversation whose own text has the same hash; null if none.

    A merge of both in order of turn, not a join of all pairs. Turns are cut into spans, so a hash that one conversation repeats
    without end is not one task's work; what earlier spans end with is carried over by their maxima.
    """
    both = quoted.withColumn("mine", F.lit(None).cast("long")).unionByName(own.join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi").withColumn("mine", F.col("turn")), allowMissingColumns=True)
    both = both.withColumn("span", F.floor(F.col("turn") / span))
    key = [F.col("conv"), F.col("hash")]
    inside = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*key, "span").agg(F.max("mine").alias("end"))
    ends = ends.select(*key, "span", F.last("end", ignorenulls=True).over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    both = both.withColumn("within", F.max("mine").over(inside)).where("mine is null")
    return both.join(ends, ["conv", "hash", "span"]).withColumn("source", F.coalesce("within", "before")).drop("within", "before", "mine", "span")


def neighbours(links: DataFrame, span: int) -> DataFrame:
    """links(conv, turn, up) with ``elder``, the turn before among those with the same up (null of the first).

    Turns are cut into spans, so the replies to a message that has very many are not one task's work.
    """
    rows = links.withColumn("span", F.floor(F.col("turn") / span))
    key = ["conv", "up"]
    ends = rows.groupBy(*key, "span").agg(F.max("turn").alias("end"))
    ends = ends.select(*key, "span", F.lag("end").over(Window.partitionBy(*key).orderBy("span")).alias("before"))
    rows = rows.withColumn("elder", F.lag("turn").over(Window.partitionBy(*key, "span").orderBy("turn")))
    return rows.join(ends, [*key, "span"]).select("conv", "turn", "up", F.coalesce("elder", "before").alias("elder"))


def threads(links: DataFrame, span: int) -> DataFrame:
    """(conv, turn, root_turn, depth, thread_order) of the messages in threads, from links(conv, turn, up), one a message.

    The walk down and up every thread is a list of entries, each with the one before it; entries find what lies before them by doubling their
    reach, so rounds grow with the logarithm of the longest thread, and no entry is the target of two. The number of steps down is the
    place in reply order, that of steps down less steps up the depth.
    """
    links = cut(links)
    own = neighbours(links, span)
    youngest = links.groupBy("conv", F.col("up").alias("turn")).agg(F.max("turn").alias("child"))
    members = links.select("conv", "turn").unionByName(links.select("conv", F.col("up").alias("turn"))).distinct()
    members = cut(members.join(own, ["conv", "turn"], "left").join(youngest, ["conv", "turn"], "left"))
    down = members.select("conv", "turn", F.lit(True).alias("down"), F.coalesce("elder", "up").alias("to"), F.when(F.col("up").isNotNull(), F.col("elder").isNull()).alias("to_down"))
    up = members.select("conv", "turn", F.lit(False).alias("down"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().alias("to_down"))
    walk = down.unionByName(up).withColumns({"steps": F.when(F.col("to_down"), 1).otherwise(0).cast("long"), "depth": F.when(F.col("to").isNull(), 0).when(F.col("to_down"), 1).otherwise(-1).cast("long")})
    walk = cut(walk.withColumn("root", F.when(F.col("to").isNull(), F.col("turn"))))
    while not walk.where("to is not null").isEmpty():
        ahead = walk.select("conv", F.col("turn").alias("to"), F.col("down").alias("to_down"), F.col("to").alias("to2"), F.col("to_down").alias("to_down2"), F.col("steps").alias("steps2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        rest = walk.where("to is not null").join(ahead, ["conv", "to", "to_down"])
        rest = rest.select("conv", "turn", "down", F.col("to2").alias("to"), F.col("to_down2").alias("to_down"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("root2").alias("root"))
        walk = cut(walk.where("to is null").unionByName(rest))
    return walk.where("down").select("conv", "turn", F.col("root").alias("root_turn"), "depth", F.col("steps").alias("thread_order"))


def link(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = 4096) -> DataFrame:
    """For each message: conv, turn, role, body (without quotes), n_quotes, n_linked, reply_to, root_turn, depth and thread_order.

    reply_to is the earlier turn of the conversation that the message's outermost linked quotes copy most words from (the later one
    among equals); null if it quotes nothing known. In order of root_turn and thread_order, replies stand under what they reply to,
    earlier ones first; a message in no thread is a root of its own. Turns may be negative and of any size.
    Null text: a null body. A message without conversation or turn has no links. Repeated messages are rows of their
    own and one place in the thread. Quotes of other conversations are not looked for: no order tells which came first. Only
    messages that quote, and those that they quote, take part in threads.
    """
    rows = cut(conversations.select(F.monotonically_increasing_id().alias("row"), F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))
    rows = rows.withColumn("body", F.when(F.col("text").rlike(QUOTED), without_quotes(F.col("text"))).otherwise(F.col("text")))
    quotes = cut(passages(rows))
    n_quotes = quotes.where(normal(F.col("passage")) != "").groupBy("row").agg(F.count("*").alias("n_quotes"))
    # only conversations that quote can link: of the others no pieces are made
    quoting = cut(quotes.where("conv is not null").select("conv").distinct())
    own = keyed(rows.where("turn is not null and body is not null").join(bounded(quoting, quoting.count()), "conv", "left_semi"), "body")
    found = latest_source(keyed(quotes.where("conv is not null and turn is not null"), "passage", "row", "level"), own, span).where("source is not null")
    by_source = found.groupBy("row", "conv", "turn", "level", "source").agg(F.sum("words").alias("words"))
    linked = by_source.groupBy("row", "conv", "turn").agg(F.max(F.struct(-F.col("level"), "words", "source")).alias("best"), F.count_distinct("source").alias("n_linked"))
    linked = cut(linked.select("row", "conv", "turn", "n_linked", F.col("best.source").alias("reply_to")))
    nodes = threads(linked.groupBy("conv", "turn").agg(F.max("reply_to").alias("up")), span)
    out = rows.select("row", "conv", "turn", "role", "body").join(n_quotes, "row", "left").join(linked.select("row", "n_linked", "reply_to"), "row", "left").join(nodes, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "body", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("thread_order", F.lit(0)).cast("long").alias("thread_order"),
    )
