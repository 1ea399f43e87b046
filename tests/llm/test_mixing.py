from __future__ import annotations

import hashlib
import math

import pytest

import corpus_pipeline
from chronoform.llm import mixing
from chronoform.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string"


def rows(counts):
    out, n = [], 0
    for source, sizes in counts.items():
        for size in sizes:
            out.append((n, " ".join(["w"] * size), source))
            n += 1
    return out


def water_fill(sizes, weights, most=3):
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s in share if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in sizes}
        full |= over


def test_targets_and_taken(spark):
    data = rows({"a": [3] * 5, "b": [100, 50, 7], "c": [1000, 1], "d": [10] * 30, None: [40, 2]})
    got = mixing.mix(spark.createDataFrame(data, SCHEMA), bucket_rows=2).collect()
    sizes = {"a": 15, "b": 157, "c": 1001, "d": 300, None: 42}
    want = water_fill(sizes, dict(zip(sizes, [5, 2, 1, 5, 2], strict=True)))
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert {round(r.target, 6) for r in mine} == {round(target, 6)} and {r.source_size for r in mine} == {sizes[s]}
        assert abs(sum(r.taken for r in mine) - target) < 1
    assert all(r.taken <= 3 * r.size and len(r.positions) >= r.taken / max(1, r.size) for r in got)
    assert all(0 <= p <= 1 for r in got for p in r.positions)


def test_positions_follow_the_schedule(spark):
    data = rows({"a": [1] * 200, "b": [1] * 200, "c": [1] * 200})
    got = mixing.mix(spark.createDataFrame(data, SCHEMA), weights=(1, 1, 1)).collect()
    mean = lambda s: sum(p for r in got if r.source == s for p in r.positions) / sum(len(r.positions) for r in got if r.source == s)
    assert mean("a") < 0.45 < mean("b") < 0.55 < mean("c")
    order = [r.position for r in ordered_parts(mixing.schedule(mixing.mix(spark.createDataFrame(data, SCHEMA))))]
    assert order == sorted(order) and len(order) == sum(len(r.positions) for r in mixing.mix(spark.createDataFrame(data, SCHEMA)).collect())


def test_odd_rows(spark):
    data = [(1, None, None), (2, "", "x"), (3, "\t \n", "x"), (4, "a b c", "x"), (4, "a b c", "x"), (None, "w " * 100_000, "x")]
    df = spark.createDataFrame([(*r, 7) for r in data], SCHEMA + ", size int")
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 100_000), (1, 0), (2, 0), (3, 0), (4, 2), (4, 2)]
    assert {r.target for r in got if r.source is None} == {0.0}
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(df.where("false")).count() == 0


@pytest.mark.parametrize("slope", [-0.5, 0.0, 0.5])
def test_position_inverts_the_integral(spark, slope):
    from pyspark.sql import functions as F

    df = spark.range(11).select((F.col("id") / 10).alias("t")).withColumn("done", 8.0 * (F.col("t") + slope * (F.col("t") * F.col("t") - F.col("t"))))
    assert all(abs(r.t - r.p) < 1e-9 for r in df.select("t", mixing.position(F.col("done"), F.lit(8.0), F.lit(slope)).alias("p")).collect())


def brute_positions(data, weights, slopes):
    """(id, positions) by bisection on the integrated schedules, from documents in order of md5."""
    names = sorted({s for _, _, s in data})
    sizes = {s: sum(len(t.split()) for _, t, x in data if x == s) for s in names}
    targets = water_fill(sizes, dict(zip(names, weights, strict=True)))
    out = {i: [] for i, _, _ in data}
    for s, slope in zip(names, slopes, strict=True):
        mine, done = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, len(t.split())) for i, t, x in data if x == s), 0
        end = math.floor(targets[s] + 1e-6)
        while done < end:
            for _, i, size in mine:
                if done >= end:
                    break
                lo, hi, want = 0.0, 1.0, min(1.0, (done + size / 2) / targets[s])
                for _ in range(60):
                    at = (lo + hi) / 2
                    lo, hi = (at, hi) if at + slope * (at * at - at) < want else (lo, at)
                out[i].append(lo)
                done += size
    return out


def ordered_parts(df):
    """The rows partition by partition."""
    return [r for part in df.rdd.glom().collect() for r in part]


def test_order_matches_a_brute_force_inversion(spark):
    data = rows({"a": [3, 1, 2] * 20, "b": [7, 5] * 90, "c": [4] * 200})
    mixed = mixing.mix(spark.createDataFrame(data, SCHEMA), bucket_rows=40)
    want = brute_positions(data, mixing.WEIGHTS, mixing.SLOPES)
    got = {r.doc_id: r.positions for r in mixed.collect()}
    assert any(len(p) > 1 for p in want.values()) and got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    order = ordered_parts(mixing.schedule(mixed))
    assert [(r.position, r.doc_id) for r in order] == sorted((p, i) for i, ps in got.items() for p in ps)


def test_query_returns_all_positions_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: [math.floor(p * 1e9 + 0.5) for p in r.positions] for r in mixing.mix(docs).collect()}
    assert any(len(p) > 1 for p in want.values())
    got = ordered_parts(QUERIES["op7_curriculum_mix"](spark, sf))
    assert {r.doc_id: [int(x) for x in r.positions.split(",") if x] for r in got} == want and len(got) == docs.count()
    first = [(r.position if r.position is not None else 2e9, r.doc_id) for r in got]
    assert first == sorted(first)


def test_stage_returns_texts_in_training_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r for r in mixing.mix(docs).collect()}
    got = ordered_parts(corpus_pipeline.mix_sources(spark, docs, sf))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in got) and {r.doc_id for r in got} == set(texts)
    read = [r for r in got if r.position is not None]
    assert got[: len(read)] == read and [(r.position, r.doc_id) for r in read] == sorted((p, i) for i, r in want.items() for p in r.positions)
    for i, r in want.items():
        assert sum(x.taken for x in got if x.doc_id == i) == r.taken
        assert all(x["pass"] == k for k, x in enumerate((x for x in read if x.doc_id == i), 1))


def test_rows_without_an_id_are_spread(spark):
    data = [(None, f"word{i} " * (1 + i % 5), "a") for i in range(300)] + [(i, "w w", "a") for i in range(20)]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA), bucket_rows=4, carry=("text",)).collect()
    total = sum(len(t.split()) for _, t, _ in data)
    places = sorted((p, r.size) for r in got for p in r.positions)
    assert len(got) == 320 and {r.source_size for r in got} == {total} and sum(r.taken for r in got) == total and len(places) == 320
    assert [r.text for r in sorted((r for r in got if r.doc_id is None), key=lambda r: r.positions)] == sorted((t for i, t, _ in data if i is None), key=lambda t: hashlib.md5(f"text:{t}".encode()).hexdigest())
