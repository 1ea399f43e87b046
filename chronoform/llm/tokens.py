"""Token ids of texts by public tokenizer files, many texts at a time."""

from __future__ import annotations

import itertools
import json
import os
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

WORD_START = "Ġ"  # the byte-level form of a blank
BLANK = 0x20
WORD = np.array([chr(i).isalnum() and i < 0x80 for i in range(256)])  # letters and digits of ASCII
WHITE = np.array([i in (9, 10, 13, BLANK) for i in range(256)])
KEPT_BYTES, KEPT_UNITS = 23, 2_000_000  # the longest unit that is remembered, and how many are


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What make() gives, made once a Python worker and kept for its later tasks: loading a tokenizer for each task takes time, and memory that is not all given back."""
    held = sys.modules.setdefault("__chronoform_worker__", types.ModuleType("__chronoform_worker__")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class Units:
    """Units of up to 23 bytes, each with its place in the order in which they came: an open-addressed table whose keys are the bytes themselves and their number."""

    def __init__(self, most: int):
        self.n, self.keys, self.mask = 0, np.zeros((most, 3), np.uint64), (1 << (2 * most - 1).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The slots at which to look for the keys first."""
        mixed = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (keys[:, 2] * np.uint64(0x165667B19E3779F9))
        return (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not known."""
        out, left, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self.first(keys)
        while len(left):
            place = self.slots[at]
            used = place >= 0
            left, at, place = left[used], at[used], place[used]
            same = (self.keys[place] == keys[left]).all(axis=1)
            out[left[same]] = place[same]
            left, at = left[~same], (at[~same] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Keys that are not known, each once."""
        places = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.keys[self.n : self.n + len(keys)] = keys
        self.n, at = self.n + len(keys), self.first(keys)
        while len(places):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]
            lost = self.slots[at] != places
            places, at = places[lost], (at[lost] + 1) & self.mask


def cut_at_pieces(text: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units begin in the UTF-8 of several texts, which begin at ``begins``: some of the places where the byte-level pre-tokenizer is sure to begin a piece, whatever comes before and after.

    These are white space behind what is none, marks of ASCII behind letters or digits, and what follows a single line feed. Of other than ASCII characters only those of two bytes
    from U+00C0 on are taken as no white space, and those up to U+027F but two as letters.
    """
    marked = np.zeros(len(text) + 1, bool)
    marked[begins] = True
    at = np.flatnonzero(text < 0x30)
    at = at[at > 1]
    now, last, lead = text[at], text[at - 1], text[at - 2]
    two = (last >= 0x80) & (lead >= 0xC3) & (lead < 0xE0)
    dark = two | ((last > BLANK) & (last < 0x7F))
    word = WORD[last] | (two & (lead < 0xCA) & ((lead != 0xC3) | ((last != 0x97) & (last != 0xB7))))
    marked[at[np.where(now > BLANK, word, dark & WHITE[now])]] = True
    feed = at[dark & (now == 0x0A)] + 1
    after = text[np.minimum(feed, len(text) - 1)]
    marked[feed[((after > BLANK) & (after < 0x7F)) | ((after >= 0xC3) & (after < 0xE0))]] = True
    return np.flatnonzero(marked[:-1])


def keys_of(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three numbers a unit of 23 bytes or fewer: its bytes, zeros after them, and their number in the last byte."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    words = np.ndarray((len(data) + 17,), "<u8", padded, strides=(1,))
    out = np.empty((len(begins), 3), np.uint64)
    for i in range(3):
        held = np.clip(sizes - 8 * i, 0, 8).astype(np.uint64) * np.uint64(8)
        all_ones = ~np.uint64(0)
        out[:, i] = words[np.minimum(begins + 8 * i, len(data))] & np.where(held > 0, all_ones >> (np.uint64(64) - np.maximum(held, np.uint64(8))), np.uint64(0))
    out[:, 2] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def byte_bpe(path: str, plain: bool = False) -> Encode:
    """encode(texts) -> (ids of all texts, how many of each), by the tokenizers library without added special tokens.

    The library never merges across the pieces that its byte-level pre-tokenizer makes, so texts are cut where a piece is sure to begin; each different unit of a
    group of texts is encoded once, and those of 23 bytes or fewer are remembered (up to 2,000,000). A text with a special token is encoded whole. With ``plain``
    the strings of special tokens are ordinary text.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = plain
    step = json.loads(tool.pre_tokenizer.__getstate__()) if tool.pre_tokenizer else {}
    special = [t.content for t in tool.get_added_tokens_decoder().values()]
    by_unit = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and not tool.normalizer and not tool.truncation and not tool.padding and not any(" " in s for s in special)
    starts_word = np.array([(tool.id_to_token(i) or "").startswith(WORD_START) for i in range(tool.get_vocab_size())], bool)
    held: dict[str, object] = {}

    def forget() -> None:
        held.update(units=Units(KEPT_UNITS), ids=np.zeros(1 << 16, np.uint32), begins=np.zeros(KEPT_UNITS + 1, np.int64))

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tool.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def of_units(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of different units; words after a blank stay apart when they are joined."""
        last, blanks = data[begins + sizes - 1], np.concatenate([[0], np.cumsum(data == BLANK)])
        joined = (data[begins] == BLANK) & (blanks[begins + sizes] - blanks[begins] == 1) & (last > BLANK) & (last < 0x7F)
        parts, counts = [], np.zeros(len(begins), np.int64)
        for m, many in ((joined, 500), (~joined, 1)):
            raw, ends = data[spread(begins[m], sizes[m])].tobytes(), np.concatenate([[0], np.cumsum(sizes[m])])
            edges = np.append(ends[:-1:many], ends[-1]).tolist()
            ids, n = whole([raw[a:b].decode() for a, b in itertools.pairwise(edges)])
            if m is joined:
                at = np.flatnonzero(starts_word[ids])
                n = np.diff(at, append=len(ids))
                if len(n) != m.sum():
                    raise ValueError("the tokenizer does not part words at blanks")
            counts[m] = n
            parts.append(ids)
        out = np.zeros(int(counts.sum()), np.uint32)
        of = np.repeat(joined, counts)
        out[of], out[~of] = parts
        return out, counts

    def by_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        data = b"".join(raw)
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        cuts = cut_at_pieces(np.frombuffer(data, np.uint8), begins)
        offsets = np.append(cuts, len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        every = pa.Array.from_buffers(pa.binary() if offsets.dtype == np.int32 else pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        named, codes = every.dictionary, every.indices.to_numpy()
        own = np.frombuffer(named.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(named.buffers()[1], offsets.dtype)[: len(named) + 1].astype(np.int64)
        at, sizes = at[:-1], np.diff(at)
        short = sizes <= KEPT_BYTES
        keys = keys_of(own, at[short], sizes[short])
        place = np.full(len(named), -1, np.int64)
        place[short] = held["units"].find(keys)
        if held["units"].n + int((place[short] < 0).sum()) > KEPT_UNITS:
            forget()
            place[:] = -1
        units = held["units"]
        known, new = place >= 0, place < 0
        ids, n_new = of_units(own, at[new], sizes[new])
        begin, counts = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
        before = held["begins"][units.n]
        begin[known], counts[known] = held["begins"][place[known]], held["begins"][place[known] + 1] - held["begins"][place[known]]
        begin[new], counts[new] = before + np.cumsum(n_new) - n_new, n_new
        if before + len(ids) > len(held["ids"]):
            held["ids"] = np.concatenate([held["ids"][:before], np.zeros(int(before + 2 * len(ids)) + len(held["ids"]) // 2, np.uint32)])
        held["ids"][before : before + len(ids)] = ids
        out = held["ids"][spread(begin[codes], counts[codes])]
        kept_ids = np.repeat(short[new], n_new)  # what is longer is not remembered
        n_kept, sizes_kept = int(kept_ids.sum()), n_new[short[new]]
        if units.n + len(sizes_kept) <= KEPT_UNITS:
            held["ids"][before : before + n_kept] = ids[kept_ids]
            held["begins"][units.n + 1 : units.n + 1 + len(sizes_kept)] = before + np.cumsum(sizes_kept)
            units.add(keys[new[short]])
        total = np.concatenate([[0], np.cumsum(counts[codes])])
        return out, np.diff(total[np.searchsorted(cuts, begins)])

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not by_unit:
            return whole(texts)
        simple = np.array([not any(s in t for s in special) for t in texts], bool)
        if simple.all():
            return by_units(texts)
        sizes = np.zeros(len(texts), np.int64)
        groups = [(m, f([t for t, s in zip(texts, m, strict=True) if s])) for m, f in ((simple, by_units), (~simple, whole)) if m.any()]
        for m, (_, n) in groups:
            sizes[m] = n
        out = np.zeros(int(sizes.sum()), np.uint32)
        for m, (ids, _) in groups:
            out[np.repeat(m, sizes)] = ids
        return out, sizes

    forget()
    return encode


def batches(column: pa.Array, most: int = 4 << 20, rows: int = 1000) -> Iterator[list[str]]:
    """The texts of a column in order, in groups of some ``most`` characters and ``rows`` texts; a longer text is a group of its own."""
    out: list[str] = []
    size = 0
    for at in range(0, len(column), rows):
        for t in column.slice(at, rows).to_pylist():
            if out and (size + len(t) > most or len(out) == rows):
                yield out
                out, size = [], 0
            out.append(t)
            size += len(t)
    if out:
        yield out
