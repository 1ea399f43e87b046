"""Operators on scripts, transcripts and commands."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronoform.functions.scalar import any_of, canonical_hash, clamp


def public_projection(claims: DataFrame, document: str, order: str, public: tuple[str, ...]) -> DataFrame:
    """(document, n, digest): a hash over the public columns of each claim of a document, in order."""
    rows = claims.select(document, F.struct(F.col(order).alias("o"), canonical_hash(*public).alias("h")).alias("c"))
    found = rows.groupBy(document).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("c")).alias("c"))
    return found.select(document, "n", F.sha2(F.array_join(F.col("c.h"), ","), 256).alias("digest"))


def normalize_segments(df: DataFrame, mode: str, duration: str | None = None) -> DataFrame:
    """Transcript segments (start, end, text) as a consumer takes them; blank texts are dropped.

    planner drops what does not end after its start; voiceover keeps what lies within [0, duration]; timeline fills in missing
    times and keeps the end within [start, duration].
    """
    rows = df.withColumn("text", F.trim("text")).where("text <> ''")
    if mode == "planner":
        return rows.where("end > start")
    if mode == "voiceover":
        limit = F.col(duration)
        rows = rows.where("start is not null and end is not null").withColumns({"start": F.least(F.greatest("start", F.lit(0.0)), limit), "end": F.least(F.greatest("end", F.lit(0.0)), limit)})
        return rows.where("end > start")
    if mode == "timeline":
        begin = F.coalesce("start", F.lit(0.0))
        return rows.withColumns({"start": begin, "end": F.least(F.col(duration), F.greatest(begin, F.coalesce("end", begin)))})
    raise ValueError(f"no mode named {mode}")


def file_level_fallback(segments: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """segments(key, start, end, text) with ``partial``: a file of files(key, duration, text) without any gives one row over all of it, flagged."""
    none = files.join(segments.select(key).distinct(), key, "left_anti")
    whole = none.select(key, F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.trim("text").alias("text"), F.lit(True).alias("partial")).where("text <> ''")
    return segments.select(key, "start", "end", "text", F.lit(False).alias("partial")).unionByName(whole)


#: A mark that no text has, where a paragraph or a sentence ends; a sentence ends at a stop and blanks before a capital or a digit.
MARK, BLANK_LINES, SENTENCE_END = "\x01", r"\n\s*\n", r"([.!?])\s+([A-Z0-9А-ЯЁ])"
#: Words that tell the kind of a beat.
RESULT_WORDS = ("result", "done", "passed", "готов", "результат", "получил")
WAIT_WORDS = ("wait", "build", "install", "test", "жд", "сборк", "установ", "тест")


def beats_of(text: Column) -> Column:
    """The beats of a script in order: paragraphs, parted at blank lines, then sentences, each blanks as one; headings (#) and empty ones are left out."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(text, BLANK_LINES, MARK), SENTENCE_END, f"$1{MARK}$2"), MARK), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: (b != "") & ~b.startswith("#"))


def split_script(scripts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ordinal, role, kind, seconds, beat): the beats of a script (:func:`beats_of`), with what each is for and how long it takes to say. No shuffle."""
    beats = scripts.select(key, beats_of(F.col(text)).alias("__beats")).select(key, F.size("__beats").alias("n"), F.posexplode("__beats").alias("ordinal", "beat"))
    first, last, low = F.col("ordinal") == 0, F.col("ordinal") == F.col("n") - 1, F.lower("beat")
    role = F.when(first, "first").when(last, "last").otherwise("middle")
    kind = F.when(first, "establish").when(last | any_of([low.contains(x) for x in RESULT_WORDS]), "result").when(any_of([low.contains(x) for x in WAIT_WORDS]), "wait").when(F.col("ordinal") % 2 == 1, "focus").otherwise("step")
    seconds = clamp(F.size(F.split("beat", " ")) / 2.5, 2.0, 10.0)
    return beats.select(key, "ordinal", role.alias("role"), kind.alias("kind"), seconds.alias("seconds"), "beat")


# The words of commands, English and Russian; each is found within longer words too.
COMMAND_WORDS = {
    "background": ("background", "фон"), "white": ("white", "бел"), "black": ("black", "черн"), "duration": ("duration", "длительность", "длительности", "длительност"), "speed": ("speed", "скорость", "скорости", "скорост"),
    "to": ("to", "до", "="), "enable": ("enable", "включи"), "disable": ("disable", "exclude", "отключи"), "pin": ("pin ", "pin:", "закрепи"), "unpin": ("unpin", "открепи"),
}


def amount_after(low: Column, words: tuple[str, ...]) -> Column:
    """The number that follows the first of the words that has one, after a blank, with or without a word that leads to it."""
    escaped = lambda xs: "|".join(re.escape(x) for x in xs)
    found = F.regexp_extract(low, rf"(?:{escaped(words)})(?:\s+(?:{escaped(COMMAND_WORDS['to'])}))?\s+([0-9]+(?:[.,][0-9]+)?)", 1)
    return F.regexp_replace(found, ",", ".").try_cast("double")


def tag_commands(df: DataFrame, text: str, fps: float = 25.0, fastest: float = 100.0) -> DataFrame:
    """df with ``intents`` (name:value, in rule order) and ``error`` for commands, English or Russian, that ask for what cannot be."""
    low = F.lower(F.col(text))
    says = lambda name: any_of([low.contains(w) for w in COMMAND_WORDS[name]])
    hexed = F.lower(F.regexp_extract(F.col(text), r"(#[0-9a-fA-F]{6})", 1))
    color = F.when(hexed != "", hexed).when(says("white"), "#ffffff").when(says("black"), "#000000")
    seconds, rate = amount_after(low, COMMAND_WORDS["duration"]), amount_after(low, COMMAND_WORDS["speed"])
    background, on, off, pin, unpin = map(says, ("background", "enable", "disable", "pin", "unpin"))
    intents = F.array_compact(F.array(
        F.when(background, F.concat(F.lit("background:"), color)), F.when(seconds > 0, F.concat(F.lit("duration:"), F.greatest(F.lit(1), F.bround(seconds * fps).cast("long")).cast("string"))), F.when(rate.between(0.5, fastest), F.concat(F.lit("speed:"), F.format_number(rate, 2))),
        F.when(on | off, F.concat(F.lit("enabled:"), (on & ~off).cast("string"))), F.when(pin | unpin, F.concat(F.lit("pinned:"), (pin & ~unpin).cast("string"))),
    ))
    error = F.when(F.trim(F.col(text)) == "", "empty").when(background & color.isNull(), "background needs a colour").when(seconds <= 0, "duration must be positive").when(~rate.between(0.5, fastest), "speed out of range").when(F.size(intents) == 0, "no rule matched")
    return df.withColumns({"intents": intents, "error": error})


def cer(expected: Column, actual: Column) -> Column:
    """Character error rate of normalised strings: edits over the expected length; of an empty one, the length of the other."""
    return F.when(F.length(expected) > 0, F.levenshtein(expected, actual) / F.length(expected)).otherwise(F.length(actual).cast("double"))


def edits(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two token lists, row by row in numpy."""
    ids = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([ids[t] for t in a], np.int64), np.array([ids[t] for t in b], np.int64)
    row = np.arange(len(y) + 1)
    step = np.arange(len(y) + 1)
    for i, t in enumerate(x, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != t))
        row = np.minimum.accumulate(np.concatenate([[i], new]) - step) + step
    return int(row[-1])


@F.pandas_udf(DoubleType())
def wer(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Word error rate of normalised strings."""
    out = []
    for e, a in zip(expected, actual, strict=True):
        e, a = (e or "").split(), (a or "").split()
        out.append(edits(e, a) / len(e) if e else float(len(a)))
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def recurring_terms(docs: DataFrame, group: str, key: str, text: str = "text", shortest: int = 5, least: int = 2, first: int = 20) -> DataFrame:
    """(group, term, n): words of at least five letters in two or more documents of a group, the first by name. Counted before the shuffle."""
    words = docs.select(group, key, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"\s+"))).alias("term")).where(F.length("term") >= shortest)
    counts = words.groupBy(group, "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("term"))).where(F.col("place") <= first)


def recurring_motifs(docs: DataFrame, events: DataFrame, group: str, key: str, text: str = "text", shortest: int = 5, least: int = 2, first: int = 20) -> DataFrame:
    """(group, motif, n): words of at least ``shortest`` letters that occur in ``least`` documents or more of a group, within longer words too, and accents
    that come so often; the first by name.

    events(group, kind). A word holds no blank, so it occurs in a document where it occurs in one of its words: words meet longer ones by five of their
    letters, and no document is searched for every word. Most words are in no longer one: they are counted where they were collected, and only the others' documents are brought together.
    """
    words = docs.select(group, key, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"\s+"))).alias("word")).where((F.length("word") >= shortest) & F.col(group).isNotNull())
    # the condition always holds; with it every use reads the keys, so that the shuffle below is the same one for all
    vocabulary = words.groupBy(group, "word").agg(F.collect_set(key).alias("__keys")).where(F.size("__keys") >= 0)
    terms = vocabulary.select(group, F.col("word").alias("term"), F.xxhash64(F.left("word", F.lit(shortest))).alias("__g"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - shortest + 1), lambda i: F.xxhash64(F.substr("word", i, F.lit(shortest)))))
    longer = vocabulary.where(F.length("word") > shortest).select(group, "word", F.explode(grams).alias("__g"))
    held = longer.join(terms, [group, "__g"]).where(F.contains("word", "term") & (F.col("word") != F.col("term"))).select(group, "term", "word")
    own = held.select(group, "term").distinct().withColumn("word", F.col("term"))
    several = held.unionByName(own).join(vocabulary, [group, "word"]).select(group, "term", F.explode("__keys").alias("__key")).groupBy(group, "term").agg(F.count_distinct("__key").alias("__n"))
    counts = vocabulary.withColumnRenamed("word", "term").join(several, [group, "term"], "left").select(group, "term", F.coalesce("__n", F.size("__keys").cast("long")).alias("n")).where(F.col("n") >= least)
    motifs = counts.select(group, F.concat(F.lit("recurring visual term: "), "term").alias("motif"), "n")
    accents = events.where(F.col("kind").isin("accent", "onset")).groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    motifs = motifs.unionByName(accents.select(group, F.concat(F.lit("recurring audio accents: "), F.col("n").cast("string")).alias("motif"), "n"))
    return motifs.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("motif"))).where(F.col("place") <= first)
