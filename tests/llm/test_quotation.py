from __future__ import annotations

import random

import duckdb

from chronoform.llm.queries import ORACLE
from chronoform.llm.quotation import link

SCHEMA = "conv_id long, turn long, role string, text string"


def by_turn(rows, conv=1):
    return {r.turn: r for r in rows if r.conv_id == conv}


def test_links_threads_and_bodies(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow do I mount a disk?\n\nThanks a lot"), (1, 1, "a", "> How do I mount a disk?\nUse mount."), (1, 2, "u", "Bob wrote:\n> > How do I mount a disk?\n> Use mount.\nIt fails."),
        (1, 3, "a", "Unrelated"), (1, 4, "u", "> It fails.\nwhy"), (1, 5, "u", "> Hello there.\n> How do I mount\n> a disk?\nme too"), (1, 6, "u", None), (None, 1, "u", "> It fails."), (2, 0, "u", ">never said\nx"), (2, 0, "u", "x"), (2, 1, "u", "> It fails.\ny"),
    ]
    got = link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    one = by_turn(got)
    assert {t: r.reply_to for t, r in one.items()} == {0: None, 1: 0, 2: 1, 3: None, 4: 2, 5: 0, 6: None}
    assert one[2].body == "It fails." and one[2].n_quotes == 2 and one[2].depth == 2 and one[4].root_turn == 0 and one[6].body is None
    order = [r.turn for r in sorted(one.values(), key=lambda r: (r.root_turn, r.thread_order))]
    assert order == [0, 1, 2, 4, 5, 3, 6]
    assert all(r.reply_to is None for r in got if r.conv_id != 1)


def test_the_latest_earlier_source_wins_whatever_the_span(spark):
    rows = [(1, t, "u", "same words here") for t in range(0, 9)] + [(1, 9, "u", "> same words here\nok"), (1, 10, "u", "same words here"), (1, 11, "u", "> SAME words, here\nok")]
    for span in (2, 4096):
        one = by_turn(link(spark.createDataFrame(rows, SCHEMA), span=span).collect())
        assert one[9].reply_to == 8 and one[11].reply_to == 10


def test_deep_chains_and_long_texts(spark):
    rows = [(1, 0, "u", "line zero")] + [(1, t, "u", f"> line {'zero' if t == 1 else t - 1}\nline {t}") for t in range(1, 40)] + [(2, 0, "u", "word " * 50_000)]
    got = link(spark.createDataFrame(rows, SCHEMA)).collect()
    one = by_turn(got)
    assert one[39].depth == 39 and one[39].root_turn == 0 and one[39].thread_order == 39


def test_turns_of_any_size_and_many_replies(spark):
    far = 10**10
    rows = [(1, -5, "u", "first of all"), (1, far, "u", "> first of all\nsecond of all"), (1, far + 5, "u", "> first of all\nother"), (1, far + 7, "u", "> second of all\nunder the second")]
    rows += [(2, 0, "u", "Ask me anything. Now.")] + [(2, t, "u", f"> Ask me\n> anything.\nreply {t}") for t in range(1, 60)] + [(2, 100, "u", "> reply 7\nlast")]
    for span in (3, 4096):
        got = link(spark.createDataFrame(rows, SCHEMA), span=span).collect()
        one, two = by_turn(got), by_turn(got, 2)
        assert [(one[t].root_turn, one[t].thread_order, one[t].depth) for t in (-5, far, far + 7, far + 5)] == [(-5, 0, 0), (-5, 1, 1), (-5, 2, 2), (-5, 3, 1)]
        assert [r.turn for r in sorted(two.values(), key=lambda r: r.thread_order)] == [*range(8), 100, *range(8, 60)] and {r.root_turn for r in two.values()} == {0}


def test_lines_that_name_the_quoted_are_no_part_of_the_body(spark):
    heads = {
        "Bob <b@x.org> wrote:": "", "Am 3. Mai schrieb Anna:": "", "Am 3. Mai 2020 um 10:15 schrieb Anna <a@x.org>:": "", "Le 3 mai, Anna a écrit :": "", "El 3 de mayo, Ana escribió:": "", "On Mon, 3 May, Bob <\nbob@x.org> wrote:": "",
        "On Mon, 3 May,\r\nBob wrote:\r": "", "On day 3 it failed.\nBob wrote:": "On day 3 it failed.", "It fails.\nBob wrote:": "It fails.", "She wrote: hello": "She wrote: hello", "On my machine\nBob wrote:": "On my machine",
    }
    rows = [(i, 0, "u", "How do I mount a disk?") for i in range(len(heads))] + [(i, 1, "u", f"{h}\n> How do I mount a disk?\nUse mount.") for i, h in enumerate(heads)]
    rows += [(99, 0, "u", "On 3 " + "3" * 100_000 + "\n" + "schrieb " * 20_000 + "\n> x")]
    got = {r.conv_id: r for r in link(spark.createDataFrame(rows, SCHEMA)).collect() if r.turn == 1}
    for i, (head, left) in enumerate(heads.items()):
        assert got[i].body == f"{left}\nUse mount.".strip() and got[i].reply_to == 0, head


def test_native_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "u", "x", "y")], SCHEMA + ", body string")
    out = link(df)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert out.count() == 1 and link(df.where("false")).count() == 0


def test_matches_the_sql(spark, tmp_path):
    rng = random.Random(7)
    lines = ["how do I do this", "use the other tool. Or none", "thanks", "no", "It fails, again!", "", "a b"]
    rows = []
    for conv in range(12):
        said = []
        for turn in range(14):
            own = [rng.choice(lines) for _ in range(rng.randint(0, 4))]
            head = []
            if said and rng.random() < 0.7:
                head = [rng.choice(["", "Ann wrote:", "Bob said: ", "Am 3. Mai schrieb Anna <a@x.org>:", "Le 3 mai, Anna a écrit :", "El 3 de mayo, Ana escribió:", "On Mon, 3 May, Bob <\nbob@x.org> wrote:", "On day 3.\nAnn wrote:"])] + [rng.choice(["> ", ">", " > ", ">> ", "> > "]) + x for x in rng.choice(said)[: rng.randint(1, 4)]]
            said.append(own or ["x"])
            rows.append((conv, turn, "u", "\n".join(head + own if rng.random() < 0.7 else own + head)))
    rows += [(1, 3, "u", "> thanks\nagain"), (None, 1, "u", "> no"), (3, 20, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "c"))
    got = link(spark.read.parquet(str(tmp_path / "c")))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE['op8_quotation_links']})").fetchall()
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want, key=key)
    assert sum(r[columns.index("reply_to")] is not None for r in want) > 20
