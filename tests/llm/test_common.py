from __future__ import annotations

from pyspark.sql import functions as F

from chronoform.llm import language, secret_scan, simhash
from chronoform.llm.common import bounded, hot_join, without


def test_hot_joins_give_what_joins_give(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", "b", "c", None) for i in range({"a": 500, "b": 3}.get(k, 1))], "key string, i long")
    lookup = rows.where("key is not null and key <> 'c'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    want = sorted(rows.join(lookup, "key").collect())
    for least in (1, 10, 1000):
        found = hot_join(rows, lookup, "key", "n", least)
        assert sorted(found.collect()) == want
    assert hot_join(rows, lookup.where("false"), "key", "n").count() == 0


def test_rows_are_taken_out_with_and_without_a_broadcast(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (None, "y")], "id long, t string")
    gone = spark.createDataFrame([(2,), (None,)], "__id long")
    for most in (0, 10):
        assert [r.id for r in without(docs, gone, docs.id.eqNullSafe(F.col("__id")), most).collect()] == [1]
    assert bounded(docs, 5, 4) is docs


def test_groups_of_very_many_copies(spark):
    """Copies beyond the bound of a shuffled key, and a chain of near fingerprints as one component."""
    chain = [(1 << k) - 1 for k in range(40)]
    rows = [(10_000 + i, 0x555555 << 40) for i in range(2500)] + [(k, fp) for k, fp in enumerate(chain)] + [(5000 + k, fp) for k, fp in enumerate(chain)]
    own = spark.createDataFrame(rows, "id long, fp long")
    got = simhash.grouped(own).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.id >= 10_000} == {10_000} and {r.component_id for r in got if r.id < 10_000} == {0}


def test_settings_of_the_session_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    docs = spark.createDataFrame([(1, "some text", "en"), (2, "token=abcdefghijklmnop", "en")], "doc_id long, text string, lang string")
    language.identify(docs, language.fit_profiles(docs)).collect()
    secret_scan.find_secrets(docs).collect()
    simhash.components(docs).collect()
    assert spark.conf.get(key) == "10000"
    spark.conf.set(key, before)
