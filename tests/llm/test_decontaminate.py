from __future__ import annotations

import random
import re

from chronoform.llm import decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        iw = words(text)
        n = min(13, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for s in range(len(w) - n + 1):
            if n and tuple(w[s : s + n]) in windows:
                hit.update(range(s, s + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "c", "é", "Dd", "7", "ω", "zz"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 9, 12, 13, 14, 20, 40, 40, 0])] + [(10, None), (10, "q w e"), (None, "only here once again")]
    docs = [(i, "-".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + k, "x " * k + items[9][1].upper() + ", y" * (50 * k)) for k in range(4)] + [(200, None), (201, ""), (202, "... ..."), (203, "q w e"), (203, "q w e"), (203, "other text"), (204, "only HERE once again")]
    long_text = "fill " * 30000 + items[8][1] + " fill" * 5
    docs.append((205, long_text))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(d, b).collect())
    want = []
    for i, t in docs:
        n, h, f, c = brute(t, items)
        want.append((i, n, h, len([x for x in f if x != "None"]), c))
    assert got == sorted(want)
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.report(d, b, max_broadcast_rows=0).collect()) == sorted((i, h) for i, _, h, _, _ in got)


def test_a_run_in_all_windows_makes_one_row_a_probe(spark):
    template = "answer the following question with one word only please"
    items = spark.createDataFrame([(i, f"{template} about topic number {i} of many {i}") for i in range(300)], "item_id long, text string")
    windows = decontaminate.item_windows(items, "item_id", "text", 13)
    runs = decontaminate.runs_of(windows)
    assert windows.count() > 600 and runs.groupBy("len", "h").count().where("count > 1").count() == 0
    docs = spark.createDataFrame([(k, f"x {template} about topic number {k * 100} of many {k * 100} y") for k in range(4)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_hit, r.n_items) for r in decontaminate.report(docs, items).collect())
    want = sorted((i, h, len(f)) for i, (_, h, f, _) in ((r.doc_id, brute(r.text, [(x.item_id, x.text) for x in items.collect()])) for r in docs.collect()))
    assert got == want


def test_empty_tables_and_removal(spark):
    d = spark.createDataFrame([(1, "one two three", "a"), (2, "free text", "b"), (None, None, "c")], "doc_id long, text string, n string")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(d, b.where("false")).collect()] == [0, 0, 0]
    assert decontaminate.report(d.where("false"), b).count() == 0
    kept = decontaminate.remove(d, b)
    assert kept.columns == d.columns and sorted(r.n for r in kept.collect()) == ["b", "c"]


def test_plan_is_native(spark):
    d = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    plan = decontaminate.report(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_an_item_without_an_id_hits_but_is_not_listed(spark):
    """The SQL of the query and the operator agree on it."""
    import duckdb
    import pandas as pd

    from chronoform.llm.queries import ORACLE

    docs, items = pd.DataFrame({"doc_id": [1, 2], "text": ["one two three four", "five"]}), pd.DataFrame({"item_id": pd.array([None, 7], "Int64"), "text": ["one two three", "two three four"]})
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("benchmark", items)
    want = {r[0]: r[1:4] for r in con.sql(f"SELECT doc_id, n_hit, n_items, items_sha256 FROM ({ORACLE['op2_decontamination']})").fetchall()}
    rows = decontaminate.report(spark.createDataFrame(docs), spark.createDataFrame([(None, "one two three"), (7, "two three four")], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in rows} == want and want[1][:2] == (4, 1)
