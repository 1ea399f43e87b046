"""A training corpus from raw documents: language, near-duplicates, contamination, secrets, then the mix.

Of documents (doc_id, text, lang, source, n_chars) every column may be null, and other columns are left behind. An empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoform.llm import decontaminate, language, mixing, secret_scan, simhash
from chronoform.llm.common import new_path, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: null texts, texts without a letter, and texts too far from every profile; names the language where lang is null.

    Profiles are learned from the labelled documents; with none, every text with a letter stays. Rows without an id and repeated rows
    are judged by their text alone; a tie between languages goes to the first by name.
    """
    return language.recognised(docs, language.fit_profiles(docs)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id, rows without an id last, ties by text.

    Repeated rows are copies, so one stays. Null and wordless texts are copies of each other.
    """
    return simhash.keep_one(docs, repeats=False).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words repeat passages of the benchmark.

    Null texts have no words and stay; repeated rows and rows without an id are judged by their text. An empty benchmark drops nothing.
    """
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the new text. Every row stays, repeated ones too; a null text stays null, with n_chars null."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in training order: a row for each time that a document is read, with its text, in ranges of position.

    ``taken`` are the words of this reading: all of the document, or its first ones where the source's target is reached.
    Documents that the mix never reads come last, once, without pass and position. Repeated rows are documents of their own; a null
    source is a source; rows without an id stand where the hash of their text does.
    """
    mixed = mixing.mix(docs, carry=("text", "lang", "n_chars"))
    return mixing.readings(mixed).select(*COLUMNS, "size", "source_size", "target", "taken", "pass", "position")


STAGES = [
    ("language", keep_languages),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Profiles are ranked by n-gram counts and fingerprints by XXH64, which DuckDB does not have; tests hold the stages against brute force.
ORACLE_SQL = None


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage's table was written whole."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The stages on documents, each written as Parquet in the shared folder and read again by the next.

    A ``run_id`` names the tables; a later run of that name goes on after the last stage that was written whole.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{run_id}-{name}" if run_id else new_path(spark, f"pipeline-{name}")
        if not (run_id and finished(spark, path)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
