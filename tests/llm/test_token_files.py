"""The range coder by round trips, and token files against whole texts encoded one by one."""

from __future__ import annotations

import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoform.llm import range_coder, token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello  world, it's 12 o'clock.\n\n\tNaïve — “quotes” ½ ² ª", "日本語 текст\u0085\x1c x", "a<|endoftext|>b", "don't ''s  \n x" * 50, "word " * 3000]


def blocks_of(kind: str) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    n = range_coder.BLOCK_IDS
    ids = {
        "text": (rng.zipf(1.3, 3 * n + 17) % 50257).astype(np.uint32),
        "one": np.array([3], np.uint32),
        "same": np.full(n + 1, 50256, np.uint32),
        "all different": rng.permutation(n).astype(np.uint32),
        "large": rng.integers(0, 2**32, 500, dtype=np.uint32),
        "pattern": np.tile(np.arange(40, dtype=np.uint32), 300),
    }[kind]
    return [ids[i : i + n] for i in range(0, len(ids), n)]


@pytest.mark.parametrize("kind", ["text", "one", "same", "all different", "large", "pattern"])
def test_blocks_come_back(kind):
    blocks = blocks_of(kind)
    coded = range_coder.encode(blocks)
    for want, got in zip(blocks, range_coder.decode(range_coder.split(b"".join(coded))), strict=True):
        assert (want == got).all()
    alone = range_coder.decode(coded[-1:])[0]  # a block needs no other
    assert (alone == blocks[-1]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=200), min_size=1, max_size=5))
def test_any_blocks_come_back(parts):
    blocks = [np.array(p, np.uint32) for p in parts]
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(range_coder.encode(blocks)), strict=True))


def test_predictions_make_blocks_smaller():
    sizes = {kind: sum(map(len, range_coder.encode(blocks_of(kind)))) / sum(map(len, blocks_of(kind))) for kind in ("pattern", "same", "text")}
    assert sizes["pattern"] < 0.1 and sizes["same"] < 0.05 and sizes["text"] < 1.7  # bytes an id, of two that the ids take


def test_damage_is_noticed():
    block = range_coder.encode(blocks_of("pattern"))[0]
    for at in (5, 30, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode([bytes(bad)])
    with pytest.raises(ValueError, match="cut off"):
        range_coder.split(block[:10])
    with pytest.raises(ValueError, match="token file"):
        token_files.unpacked(b"x" * 100)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé’–19.'sdlve\n\t ²ªñ中😀\x0b\x1c　\u0085<|endoftext|>", max_size=40), min_size=1, max_size=6))
def test_pieces_are_what_whole_texts_give(texts):
    tool = Tokenizer.from_file(PATH)
    ids, sizes = ENCODE(texts)
    want = [tool.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


ENCODE = tokens.byte_bpe(PATH)


def test_groups_of_texts():
    texts = ["a" * 5, "b" * 30, "", "c", "d" * 4]
    assert list(tokens.batches(pa.array(texts), most=8, rows=2)) == [["a" * 5], ["b" * 30], ["", "c"], ["d" * 4]]
    assert list(tokens.batches(pa.array([], pa.string()))) == []


def expected(rows: list[tuple]) -> list[tuple]:
    tool, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_the_documents_in_order(spark, tmp_path):
    """Null ids first, ids beyond 2^53, null, empty and long texts, a column of a clashing name; several files a task."""
    big = 2**60
    rows = [(None, "no id"), *[(i, TEXTS[i % len(TEXTS)]) for i in range(20)], (30, None), (big + 1, "x y"), (big + 3, "x z")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, content string").repartition(3)
    token_files.write(df, f"file://{tmp_path}/t", file_ids=900, group_chars=900)
    assert spark.read.parquet(f"file://{tmp_path}/t").count() > 2
    found = token_files.read(spark, f"file://{tmp_path}/t", with_ids=True).collect()
    assert sorted([tuple(r)[:4] for r in found], key=lambda r: r[1]) == expected(rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)


def test_repeated_rows_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(7, "one two")] * 300 + [(7, "other"), (3, None)], "doc_id long, text string")
    token_files.write(df, f"file://{tmp_path}/r")
    got = token_files.read(spark, f"file://{tmp_path}/r").orderBy("start").collect()
    assert len(got) == 302 and got[0].doc_id == 3 and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got][:-1]).tolist()
    token_files.write(df.where("false"), f"file://{tmp_path}/e")
    assert token_files.read(spark, f"file://{tmp_path}/e").count() == 0


def test_texts_are_cut_only_where_pieces_begin():
    """Each unit encoded alone gives what the whole text does, whatever stands beside a blank, a mark or a line feed."""
    tool = Tokenizer.from_file(PATH)
    odd = ["a", "9", "é", "×", "÷", "²", "ʼ", "Ω", " ", "\u0085", "　", "日", "'s", "'", ".", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x1c", "́"]
    for text in ["".join(p) + "x." for p in itertools.product(odd, [" ", ".", "'", "\n", " \n", "\n "], odd)]:
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = [*tokens.cut_at_pieces(data, np.array([0, len(data)])).tolist(), len(data)]
        alone = [tool.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids for a, b in itertools.pairwise(cuts)]
        assert sum(alone, []) == tool.encode(text, add_special_tokens=False).ids, text


def test_known_words_cost_less_than_looking_each_up():
    """Of many words that all came before, less time is spent than on taking them out by a pattern and looking them up one by one (F1)."""
    words = [f" {a}{b}{c}" for a, b, c in itertools.product("the tion an ou re sh in ed".split(), "er on ti ble th en st".split(), "ly nt wh ha ing ea es at or".split())]
    texts = ["".join(np.random.default_rng(i).choice(words, 2000)) for i in range(200)]
    ENCODE(texts)
    taken = []
    for _ in range(3):
        began = time.process_time()
        ENCODE(texts)
        between = time.process_time()
        known, pattern = {w: i for i, w in enumerate(words)}, re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+|\s+(?!\S)|\s+")
        every = list(itertools.chain.from_iterable(pattern.findall(t) for t in texts))
        _, codes = [w for w in dict.fromkeys(every) if w not in known], np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        taken.append((between - began) / (time.process_time() - between))
    assert min(taken) < 1
