from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoform.llm import decontaminate, secret_scan, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "1234 5678", "en", "s", 9), (10**6 + 1, None, None, None, None), (10**6 + 2, 'see token = "abcdefghijkl1234" here with some words of text', "en", "s", 50)], docs.schema)
    docs = docs.unionByName(extra)
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        docs = out.cache()
    kept = {r.doc_id for r in docs.collect()}
    assert kept < before and not kept & {10**6, 10**6 + 1} and 10**6 + 2 in kept
    assert simhash.components(docs).where("doc_id <> component_id").count() <= 1  # masking may bring two texts together
    assert decontaminate.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    assert secret_scan.find_secrets(docs).where("all_spans <> ''").count() == 0
    assert docs.where("n_chars <> char_length(text)").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in mixed.collect()} == kept and mixed.columns[:5] == list(corpus_pipeline.COLUMNS)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)  # one row for each reading
    sizes = {r.doc_id: r.size for r in rows}
    assert sum(r.taken for r in rows) == pytest.approx(sum(sizes.values()), abs=len({r.source for r in rows}))


def test_a_named_run_goes_on_after_its_last_whole_stage(spark, monkeypatch):
    name, seen = f"t{time.time_ns()}", []
    counted = [(k, lambda *a, k=k, f=f: (seen.append(k), f(*a))[1]) for k, f in corpus_pipeline.STAGES]
    broken = [*counted[:3], ("secrets", lambda *a: 1 / 0), counted[4]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", broken)
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, SF, name)
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    assert corpus_pipeline.run(spark, SF, name).count() and seen == ["language", "simhash", "decontamination", "secrets", "mixing"]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    """Nulls in every column, repeated rows, ties, empty and very long texts, columns with clashing names, no row at all."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = "the cat sat on the mat and the dog was there with them all day long".split()
    rows = [(1, " ".join(words), "en", "a", 1), (1, " ".join(words), "en", "a", 1), (None, " ".join(words[::-1]), None, None, None), (3, None, None, "a", None), (4, "", "en", "b", 0), (5, "12 34 !", "en", "b", 7), (6, " ".join(words * 8000), "en", "b", 9), (7, " ".join(words[3:] + ["too"]), None, "a", 2)]
    docs = spark.createDataFrame(rows, schema)
    for c in ("score", "lang_pred", "fp", "id", "hash", "size", "taken", "position", "base_spans", "n_words"):
        docs = docs.withColumn(c, F.lit("x"))
    got = stage(spark, docs, SF).collect()
    texts = [r.text for r in got]
    want = {
        "language": [rows[0][1]] * 2 + [rows[2][1], rows[6][1], rows[7][1]], "simhash": [rows[0][1], rows[2][1], None, rows[5][1], rows[6][1], rows[7][1]],
        "decontamination": [r[1] for r in rows], "secrets": [r[1] for r in rows],
    }
    if name in want:
        assert sorted(texts, key=str) == sorted(want[name], key=str)
        assert list(got[0].asDict()) == list(corpus_pipeline.COLUMNS)
    else:
        assert {(r.doc_id, r.text) for r in got} == {r[:2] for r in rows}
    if name == "language":
        assert {r.lang for r in got} == {"en"}
    empty = stage(spark, docs.where("false"), SF)
    assert empty.count() == 0 and empty.columns[:1] == ["doc_id"]


def test_language_stage_rejects_by_distance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "Привет, как дела", None, "s", 9), (-2, "zzz kkk www", None, "s", 9), (-3, "the", None, "s", 3)], docs.schema)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.keep_languages(spark, docs.unionByName(odd), SF).collect()}
    assert not {-1, -2} & set(kept) and kept[-3] == "en"
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert len(kept) == lettered + 1
    assert corpus_pipeline.keep_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).count() == lettered
