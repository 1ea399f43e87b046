"""An adaptive context-mixing range coder of token ids, in blocks that stand alone.

Within a block three predictions are kept: order 0 counts how often each id came, order 1 and order 2 remember for the last one and two
ids which id followed and how often that held. The better of the two remembered ids is the guess; the three orders' probabilities of the guess are
mixed in the logistic domain, with weights that learn from each error, and the arithmetic coder first codes whether the guess holds. Where it
does not, the id is coded by the counts of order 0.

All arithmetic is on integers, so a block decodes to the same ids on any machine. Blocks are coded side by side, one numpy lane a block, because
one id depends on those before it of its own block only.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK_IDS = 1 << 13
LANES = 1024
#: The counts of order 0 become probabilities before these steps of a block.
REFRESH = frozenset([0, 128, 256, 512, 1024, *range(2048, BLOCK_IDS, 2048)])
HASH_BITS = 12
WHOLE, LEAST = 1 << 48, 1 << 32  # an interval at first, and the least that is not widened by 16 bits
LOW16, LOW32 = (1 << 16) - 1, (1 << 32) - 1
HEADER, HEADER_BYTES = "<IIIII", 20  # ids, bytes of the alphabet, words, crc32 of the ids, crc32 of the block's bytes


def squash(x: int) -> int:
    """Probability of 4096 of a logit in 256ths."""
    return min(4095, max(1, round(4096 / (1 + math.exp(-x / 256)))))


def stretch(p: int) -> int:
    """Logit in 256ths of a probability of 4096."""
    return min(2047, max(-2047, round(256 * math.log(max(p, 0.5) / (4096 - p)))))


def follow(p: int, held: bool) -> int:
    """How often a remembered id is taken to hold, of 4096, after it held or not; 0: it is forgotten."""
    p = p + ((4095 - p) >> 3) if held else p - (p >> 2) - 1
    return p if p >= 400 else 0


REACH = 3 << 13  # no sum of three weighted logits goes beyond
SQUASH = np.array([squash(min(2047, max(-2047, x))) for x in range(-REACH, REACH)], dtype=np.int64)
STRETCH = np.array([stretch(p) for p in range(4096)], dtype=np.int64)
#: By whether an order's remembered id is another than the guess, times 4096, plus how often it holds.
LOGIT = np.concatenate([STRETCH, STRETCH[(4095 - np.arange(4096)) >> 4]])
#: By whether another id than the remembered one came, times 4096, plus how often that held: how often it is taken to hold, in 65536ths of what is kept.
FOLLOW = np.array([[follow(p, held) << 16 for p in range(4096)] for held in (True, False)], dtype=np.int64).ravel()
ORDER2 = 1 << 15  # marks what order 2 keeps: ids are below 2 to the 13th, and of two that hold as often that of order 2 is the greater
FRESH = 900 << 16  # of an id remembered anew
RATE = 24  # by which a count of order 0 grows
HASH_LAST, HASH_BEFORE = 2654435761 % (1 << 25), 2654435761 * 40503 % (1 << 25)  # of the hash only bits 13 to 24 are used


class Model:
    """The state of the blocks being coded, one lane each, longest first; all blocks begin alike.

    What is kept of a lane lies together in ``kept``: two numbers an id, its range of order 0 (where it begins and, in the low half, its length) and what order 1 remembers after it,
    then what order 2 does after each hash. What is remembered is how often it holds, the order and the id. ``logits`` are those of the ids' probabilities of order 0. Steps write into arrays made once for the lanes
    still active, and choose by masks of whole numbers: making, casting and masking arrays took most of the time.
    """

    def __init__(self, sizes: np.ndarray, decoding: bool):
        self.lanes, self.width = len(sizes), int(sizes.max())
        self.sizes = sizes.astype(np.int64)
        self.bits = np.array([max(12, int(s).bit_length() + 2) for s in sizes], dtype=np.int64)
        self.counts = (np.arange(self.width) < self.sizes[:, None]).astype(np.uint32)
        self.logits = np.zeros(self.lanes * self.width, np.int16)
        self.stride = 2 * self.width + (1 << HASH_BITS)
        self.kept = np.zeros((self.lanes, self.stride), np.int32)
        self.kept[:, 2 * self.width :] = ORDER2
        self.kept = self.kept.reshape(-1)
        self.ranges = self.kept.view(np.uint32)
        self.weights = np.full((3, self.lanes), 22000, dtype=np.int64)  # in 65536ths
        self.hashed, self.counted = np.zeros(self.lanes, np.int64), 0
        self.decoding, self.k = decoding, -1
        self.places = np.arange(self.lanes) * self.stride + np.array([[1], [2 * self.width]])  # at first all ids before are 0

    def narrow(self, k: int) -> None:
        """Only the first k lanes go on."""
        self.k = k
        self.first = np.arange(k) * self.width  # of a lane's ids
        self.first1 = np.arange(k) * self.stride
        self.first2 = self.first1 + 2 * self.width
        self.weights, self.hashed, self.places = (np.ascontiguousarray(x[..., :k]) for x in (self.weights, self.hashed, self.places))
        self.flat = self.places.reshape(-1)
        self.bits = self.bits[:k]
        self.holds, self.names, self.index, self.both = (np.zeros((2, k), np.int64) for _ in range(4))
        self.state, self.gone = np.zeros((2, k), np.int32), np.zeros((2, k), bool)
        self.t, self.product = np.zeros((3, k), np.int64), np.zeros((3, k), np.int64)
        self.guess, self.p, self.place, self.own, self.start, self.error = (np.zeros(k, np.int64) for _ in range(6))
        self.narrow16, self.narrow32 = np.zeros(k, np.int16), np.zeros(k, np.uint32)

    def refresh(self, k: int, step: int, ids: np.ndarray) -> None:
        """The probabilities of order 0 from the counts before a step, of which ``ids`` are those of all steps so far: each id of the alphabet has one at least."""
        slots = []
        for lanes in (slice(a, min(a + 128, k)) for a in range(0, k, 128)):  # some lanes at a time, for what they need beside the tables
            counts, totals = self.counts[lanes], 1 << self.bits[lanes, None]
            seen = ids[self.counted : step, lanes] + np.arange(len(counts)) * self.width
            counts += (np.bincount(seen.ravel(), minlength=counts.size) * RATE).astype(np.uint32).reshape(counts.shape)
            scale = (totals - self.sizes[lanes, None]) / counts.sum(axis=1, keepdims=True)  # one division of whole numbers below 2 to the 53rd, rounded alike everywhere
            freq = (counts * scale).astype(np.int64) + (counts > 0)
            freq[:, :1] += totals - freq.sum(axis=1, keepdims=True)
            of = slice(lanes.start * self.width, lanes.stop * self.width)
            self.ranges.reshape(self.lanes, -1)[lanes, : 2 * self.width : 2] = ((np.cumsum(freq, axis=1) - freq) << 16) | freq
            self.logits[of] = STRETCH[((freq << 12) >> self.bits[lanes, None]) & 4095].ravel()
            if self.decoding:
                slots.append(np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), len(freq)), freq.ravel()))
        self.counted = step
        if self.decoding:
            self.at = np.concatenate(slots)
            self.at0 = np.cumsum(1 << self.bits[:k]) - (1 << self.bits[:k])

    def differ(self, ids: np.ndarray) -> None:
        """Into ``index``: whether an order remembers another id than these, times 4096, plus how often it holds."""
        np.copyto(self.both[0], ids)
        np.bitwise_or(ids, ORDER2, out=self.both[1])
        np.bitwise_xor(self.names, self.both, out=self.index)
        np.minimum(self.index, 1, out=self.index)
        self.index <<= 12
        self.index += self.holds

    def predict(self) -> None:
        """The guess of each lane and its probability, of 4096."""
        self.kept.take(self.places, out=self.state, mode="clip")
        np.copyto(self.names, self.state)
        np.right_shift(self.names, 16, out=self.holds)
        np.maximum(self.names[0], self.names[1], out=self.guess)
        self.guess &= BLOCK_IDS - 1
        self.names &= LOW16
        np.add(self.first, self.guess, out=self.place)
        np.copyto(self.t[0], self.logits.take(self.place, out=self.narrow16, mode="clip"))
        self.differ(self.guess)
        LOGIT.take(self.index, out=self.t[1:], mode="clip")
        np.multiply(self.weights, self.t, out=self.product)
        np.add(self.product[0], self.product[1], out=self.place)
        self.place += self.product[2]
        self.place >>= 16
        self.place += REACH
        SQUASH.take(self.place, out=self.p, mode="clip")

    def ranges_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the range of order 0 of one id of each lane begins, its length)"""
        np.left_shift(ids, 1, out=self.place)
        self.place += self.first1
        np.copyto(self.own, self.ranges.take(self.place, out=self.narrow32, mode="clip"))
        np.right_shift(self.own, 16, out=self.start)
        self.own &= LOW16
        return self.start, self.own

    def learn(self, ids: np.ndarray, held: np.ndarray) -> None:
        """What came, of which ``ranges_of`` was asked last, is remembered; ``held`` is -1 where the guess held, else 0."""
        np.bitwise_and(held, 4096, out=self.error)
        self.error -= self.p
        self.error *= 6
        np.multiply(self.t, self.error, out=self.product)
        self.product += 8192
        self.product >>= 14
        self.weights += self.product
        np.minimum(self.weights, 1 << 18, out=self.weights)
        np.maximum(self.weights, -(1 << 18), out=self.weights)
        self.differ(ids)
        FOLLOW.take(self.index, out=self.holds, mode="clip")
        np.equal(self.holds, 0, out=self.gone)
        self.names |= self.holds
        self.both |= FRESH
        np.copyto(self.state, np.where(self.gone, self.both, self.names), casting="unsafe")
        self.kept[self.flat] = self.state.reshape(-1)
        np.add(self.place, 1, out=self.places[0])
        hashed = self.places[1]  # of these ids and those before
        np.multiply(ids, HASH_LAST, out=hashed)
        hashed += self.hashed
        hashed >>= 13
        hashed &= (1 << HASH_BITS) - 1
        hashed += self.first2
        np.multiply(ids, HASH_BEFORE, out=self.hashed)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of one to BLOCK_IDS ids as bytes."""
    out: list[bytes] = []
    for at in range(0, len(blocks), LANES):
        out += encode_lanes([np.asarray(b, dtype="<u4") for b in blocks[at : at + LANES]])
    return out


def numbered(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alphabet, the block's ids as places in it)."""
    if block.max() >= 1 << 20:
        alphabet, local = np.unique(block, return_inverse=True)
        return alphabet, local.astype(np.uint16)
    seen = np.zeros(int(block.max()) + 1, bool)
    seen[block] = True
    alphabet, at = np.flatnonzero(seen), np.empty(len(seen), np.uint16)
    at[alphabet] = np.arange(len(alphabet))
    return alphabet, at[block]


def encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    parts = [numbered(blocks[i]) for i in order]
    ids = np.zeros((len(order), int(lengths[0])), np.uint16)
    for lane, (_, local) in enumerate(parts):
        ids[lane, : len(local)] = local
    ids, parts = np.ascontiguousarray(ids.T), [(a, None) for a, _ in parts]
    model = Model(np.array([len(a) for a, _ in parts]), decoding=False)
    low, span = np.zeros(len(order), np.int64), np.full(len(order), WHOLE, np.int64)
    words, due = np.empty((2 * int(lengths[0]) + 3, len(order)), np.int32), np.zeros((2 * int(lengths[0]) + 3, len(order)), bool)  # a step gives a lane two words at most
    row = 0
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()  # lanes longer than each step
    for step in range(int(lengths[0])):
        k = active[step]
        if k != model.k:
            model.narrow(k)
            own_low, own_span = low[:k], span[:k]
            x, held, bound, rest, short, word = (np.zeros(k, np.int64) for _ in range(6))
        if step in REFRESH:
            model.refresh(k, step, ids)
        model.predict()
        np.copyto(x, ids[step, :k])
        np.bitwise_xor(x, model.guess, out=held)
        np.minimum(held, 1, out=held)
        held -= 1  # -1 where the guess holds, else 0
        start, length = model.ranges_of(x)
        np.right_shift(own_span, 12, out=bound)
        bound *= model.p
        np.subtract(own_span, bound, out=rest)
        rest >>= model.bits
        start *= rest
        start += bound
        np.invert(held, out=short)
        start &= short
        own_low += start
        length *= rest
        bound -= length
        bound &= held
        np.add(length, bound, out=own_span)
        while True:
            np.subtract(own_span, LEAST, out=short)
            short >>= 63  # -1 where a word is due, else 0
            np.right_shift(own_low, 32, out=word)  # bit 16 is a carry into the words before
            np.copyto(words[row, :k], word, casting="unsafe")
            np.copyto(due[row, :k], short, casting="unsafe")
            row += 1
            word <<= 32
            word &= short
            own_low -= word
            short &= 16
            own_low <<= short
            own_span <<= short
            if own_span.min() >= LEAST:
                break
        model.learn(x, held)
    for _ in range(3):
        words[row], due[row] = low >> 32, True
        low, row = (low & LOW32) << 16, row + 1
    words, due = words[:row], due[:row]
    sizes = due.sum(axis=0)
    words = np.concatenate([np.ascontiguousarray(words[:, i : i + 128].T)[np.ascontiguousarray(due[:, i : i + 128].T)] for i in range(0, len(order), 128)])
    while (over := np.flatnonzero(words >> 16)).size:
        words[over] &= LOW16
        np.add.at(words, over - 1, 1)
    ends = np.cumsum(sizes)
    out = [b""] * len(order)
    for n, (i, (alphabet, _), end) in enumerate(zip(order, parts, ends, strict=True)):
        own = words[ends[n - 1] if n else 0 : end].astype("<u2")
        own = own[: len(own) - np.argmax(own[::-1] != 0) if own.any() else 0].tobytes()  # what follows the last word reads as zeros
        head = zlib.compress(np.diff(alphabet.astype(np.int64), prepend=0).astype("<u4").tobytes(), 6)
        out[i] = struct.pack(HEADER, len(blocks[i]), len(head), len(own) // 2, zlib.crc32(blocks[i].tobytes()), zlib.crc32(head + own)) + head + own
    return out


def split(content: bytes) -> list[bytes]:
    """The blocks that follow one another in content."""
    out, at = [], 0
    while at < len(content):
        if at + HEADER_BYTES > len(content):
            raise ValueError("a block is cut off")
        _, alphabet, words, _, _ = struct.unpack_from(HEADER, content, at)
        end = at + HEADER_BYTES + alphabet + 2 * words
        out.append(content[at:end])
        at = end
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, checked against its checksums."""
    out: list[np.ndarray] = []
    for at in range(0, len(blocks), LANES):
        out += decode_lanes(blocks[at : at + LANES])
    return out


def opened(block: bytes) -> tuple[int, np.ndarray, np.ndarray, int]:
    """(ids, alphabet, words, crc32 of the ids) of a block."""
    if len(block) < HEADER_BYTES:
        raise ValueError("a block is cut off")
    n, size, words, crc, own = struct.unpack_from(HEADER, block)
    body = block[HEADER_BYTES :]
    if len(body) != size + 2 * words or zlib.crc32(body) != own or not 0 < n <= BLOCK_IDS:
        raise ValueError("a block differs from its checksum")
    return n, np.cumsum(np.frombuffer(zlib.decompress(body[:size]), "<u4").astype(np.int64)), np.frombuffer(body[size:], "<u2"), crc


def decode_lanes(blocks: list[bytes]) -> list[np.ndarray]:
    parts = [opened(b) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -parts[i][0])
    lengths = np.array([parts[i][0] for i in order])
    model = Model(np.array([len(parts[i][1]) for i in order]), decoding=True)
    words = np.concatenate([x for i in order for x in (parts[i][2].astype(np.int64), np.zeros(4, np.int64))])
    begins = np.cumsum([0, *[len(parts[i][2]) + 4 for i in order]])
    pointer, limit = begins[:-1].copy(), begins[1:] - 1
    code, span, most = np.zeros(len(order), np.int64), np.full(len(order), WHOLE, np.int64), (1 << model.bits) - 1
    for _ in range(3):
        code = (code << 16) | words[pointer]
        pointer += 1
    ids = np.zeros((int(lengths[0]), len(order)), np.uint16)
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
    for step in range(int(lengths[0])):
        k = active[step]
        if k != model.k:
            model.narrow(k)
            own_code, own_span, own_pointer, own_limit, own_most = code[:k], span[:k], pointer[:k], limit[:k], most[:k]
            x, held, bound, rest, left, short, word, slot = (np.zeros(k, np.int64) for _ in range(8))
            share, found = np.zeros(k, np.float64), np.zeros(k, np.uint16)
        if step in REFRESH:
            model.refresh(k, step, ids)
        model.predict()
        np.right_shift(own_span, 12, out=bound)
        bound *= model.p
        np.subtract(own_code, bound, out=left)
        np.right_shift(left, 63, out=held)  # -1 where the guess holds, else 0
        np.subtract(own_span, bound, out=rest)
        rest >>= model.bits
        np.maximum(left, 0, out=slot)
        np.divide(slot, rest, out=share)  # rounds to no other whole part: both are below 2 to the 48th
        np.copyto(slot, share, casting="unsafe")
        np.minimum(slot, own_most, out=slot)
        slot += model.at0[:k]
        np.copyto(x, model.at.take(slot, out=found, mode="clip"))
        np.subtract(model.guess, x, out=slot)
        slot &= held
        x += slot
        start, length = model.ranges_of(x)
        start *= rest
        left -= start
        own_code -= left
        own_code &= held
        own_code += left
        length *= rest
        bound -= length
        bound &= held
        np.add(length, bound, out=own_span)
        while True:
            np.subtract(own_span, LEAST, out=short)
            short >>= 63  # -1 where a word is read, else 0
            np.minimum(own_pointer, own_limit, out=slot)
            words.take(slot, out=word, mode="clip")
            word &= short
            own_pointer -= short
            short &= 16
            own_code <<= short
            own_code |= word
            own_span <<= short
            if own_span.min() >= LEAST:
                break
        ids[step, :k] = x
        model.learn(x, held)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(order)
    for lane, i in enumerate(order):
        n, alphabet, _, crc = parts[i]
        found = alphabet[ids[:n, lane]].astype("<u4")
        if zlib.crc32(found.tobytes()) != crc:
            raise ValueError("the ids of a block differ from their checksum")
        out[i] = found
    return out
