"""Adaptive context-mixing range coder for token ids, in numpy.

A block holds whole documents and is independent: its model starts afresh and its ids carry a CRC-32. The block's ids are
cut into `lanes` runs of equal length that are coded in step: step t codes the t-th id of every lane under one model, which then
learns all of them. So coder and decoder work on arrays, and the decoder, which has read the same ids, learns the same.

Model: three predictors are mixed; an id's share is the sum of what they give it.
- order 2: the id last seen after this pair of ids (hashed), with a confidence from 0 to 3;
- order 1: the id last seen after this id, with a confidence;
- order 0: frequencies of all ids in the block so far, relearned every REFRESH steps.
The mixing weights are learned too: for each pair of confidences, and whether both predict the same id, it counts how often order 2
was right, only order 1 was, or neither. The interval has the id of order 2 first, then that of order 1, then the others by id.

Arithmetic coding: a 64-bit low and range for each lane, 32 bits out at a time; carries are added to the words before at the end
(Schindler's range coder, 1998).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TCR2"
REFRESH = 16
LANES = 8192
EVENT_BITS, TOTAL_BITS = 9, 20  # of the mixing weights, and of the frequencies of order 0
WHOLE = np.int32(1 << (EVENT_BITS + TOTAL_BITS))
PAIRS = 18  # bits of the order-2 table
LOW, U32, SHIFT = np.uint64(1 << 32), np.uint64(32), np.uint64(EVENT_BITS + TOTAL_BITS)
MASK = np.uint64(0xFFFFFFFF)
HEAD = "<4sIQIIII"  # magic, documents, ids, id space, lanes, CRC-32 of the ids as <u4, bytes of the document table


class Model:
    def __init__(self, space: int, lanes: int, decodes: bool = False) -> None:
        if space > 1 << (TOTAL_BITS - 1):
            raise ValueError(f"ids must be under {1 << (TOTAL_BITS - 1)}")
        self.decodes, self.space = decodes, space
        self.seen: list[np.ndarray] = []
        self.counts = np.zeros(space, np.int64)
        none = np.int32(space << 2)  # predicts an id that doesn't occur
        self.one = np.full(space + 1, none)  # id << 2 | confidence
        self.two = np.full(1 << PAIRS, none)
        self.mixes = np.tile(np.array([1, 1, 2], np.int64), (32, 1))
        self.last, self.hashed = np.zeros(lanes, np.int32), np.zeros(lanes, np.uint32)
        self.refresh()

    def refresh(self) -> None:
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.space)
            self.seen.clear()
        free = (1 << TOTAL_BITS) - self.space
        share = 1 + self.counts * free // max(1, int(self.counts.sum()))
        share[int(share.argmax())] += (1 << TOTAL_BITS) - int(share.sum())
        self.share = np.append(share, 0).astype(np.int32)
        self.below = np.append(0, np.cumsum(share)).astype(np.int32)
        if self.decodes:
            self.owner = np.repeat(np.arange(self.space, dtype=np.int32), share)  # whose share a number is in
        events = self.mixes * ((1 << EVENT_BITS) - 3) // self.mixes.sum(axis=1, keepdims=True) + 1
        both = events[:, 0] + events[:, 1]
        self.f21 = (both << TOTAL_BITS).astype(np.int32)
        self.f2 = (np.where(np.arange(32) & 1, events[:, 0], both) << TOTAL_BITS).astype(np.int32)  # the last bit: the two differ
        self.f0 = ((1 << EVENT_BITS) - both).astype(np.int32)

    def predict(self, n: int) -> None:
        """For the first n lanes: what both predict, how wide their ids are, and the weight of order 0."""
        last = self.last[:n]
        # numpy looks numbers up fastest by take(), and puts them fastest at places of its own index type
        self.at1 = last.astype(np.intp)
        self.at2 = ((self.hashed[:n] + last.view(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIRS)).astype(np.intp)
        self.v1, self.v2 = self.one.take(self.at1), self.two.take(self.at2)
        self.p1, self.p2 = self.v1 >> 2, self.v2 >> 2
        self.c1, self.c2 = self.v1 & 3, self.v2 & 3
        differ = self.p1 != self.p2
        self.mix = ((self.c2 << 3) | (self.c1 << 1) | differ).astype(np.intp)
        self.zero = self.f0.take(self.mix)
        self.s2 = self.share.take(self.p2)
        self.s1 = self.share.take(self.p1) * differ  # one id takes both predictors' shares
        self.w21 = self.f21.take(self.mix) + self.zero * (self.s2 + self.s1)
        self.w2 = self.f2.take(self.mix) + self.zero * self.s2

    def learn(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, step: int) -> None:
        n = len(ids)
        last = self.last[:n]
        event = np.int8(2) - (hit2.view(np.int8) << 1) - (hit1 > hit2)  # order 2: 0; order 1 alone: 1; neither: 2
        self.mixes += np.bincount(self.mix * 3 + event, minlength=96).reshape(32, 3)
        # right: one step surer; wrong: one less sure, and replaced where it was unsure already
        unsure = ids << 2
        for table, at, v, c, hit in ((self.one, self.at1, self.v1, self.c1, hit1), (self.two, self.at2, self.v2, self.c2, hit2)):
            new = v - 1 + hit * (np.int32(1) + (c < 3))
            np.copyto(new, unsure, where=(c == 0) > hit)
            table[at] = new
        self.seen.append(ids)
        self.hashed[:n] = last.view(np.uint32) * np.uint32(0x9E3779B1)
        self.last[:n] = ids
        if step % REFRESH == REFRESH - 1 or step < 4:
            self.refresh()


def _lanes(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids."""
    lanes = max(1, min(LANES, n // 192))
    steps = -(-n // lanes)
    return -(-n // steps) if n else 0, steps


def _turned(grid: np.ndarray) -> np.ndarray:
    """Rows as columns, copied in strips that fit the CPU's caches."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for at in range(0, len(grid), 64):
        out[:, at : at + 64] = grid[at : at + 64].T
    return out


def _encode_ids(ids: np.ndarray, space: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Lanes, 32-bit words of each lane, and all the words lane by lane."""
    n = len(ids)
    lanes, steps = _lanes(n)
    if not n:
        return 0, np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = _turned(grid.reshape(lanes, steps))
    model = Model(space, lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(2**64 - 1))
    written = np.zeros(lanes, np.int64)
    who: list[np.ndarray] = []
    out: list[np.ndarray] = []
    carried: list[tuple[np.ndarray, np.ndarray]] = []  # lanes, and how many of their words stood before
    for t in range(steps):
        m = (n - 1 - t) // steps + 1  # lanes that reach this step
        x = grid[t, :m]
        model.predict(m)
        hit1, hit2 = model.p1 == x, model.p2 == x
        start = model.w2 * ~hit2
        span = model.w21 - start  # of order 1, if it is right alone
        np.copyto(span, model.w2, where=hit2)
        i = np.flatnonzero(~(hit1 | hit2))
        y, zero = x[i], model.zero[i]
        before = model.below.take(y) - model.s2[i] * (model.p2[i] < y) - model.s1[i] * (model.p1[i] < y)
        start[i] = model.w21[i] + zero * before
        span[i] = zero * model.share.take(y)
        r = size[:m] >> SHIFT
        moved = low[:m] + r * start.astype(np.uint64)
        if len(over := np.flatnonzero(moved < low[:m])):
            carried.append((over, written[over]))
        low[:m] = moved
        size[:m] = r * span.astype(np.uint64)
        at = np.flatnonzero(size[:m] < LOW)
        who.append(at.astype(np.uint16))
        out.append((low[at] >> U32).astype(np.uint32))
        low[at] <<= U32
        size[at] <<= U32
        written[at] += 1
        model.learn(x, hit1, hit2, t)
    ending = low + MASK  # in the range, and of its 32 lower bits none is needed
    if len(over := np.flatnonzero(ending < low)):
        carried.append((over, written[over]))
    who.append(np.arange(lanes).astype(np.uint16))
    out.append((ending >> U32).astype(np.uint32))
    lane = np.concatenate(who)
    words = np.concatenate(out)[np.argsort(lane, kind="stable")].astype(np.uint64)
    counts = np.bincount(lane, minlength=lanes)
    first = np.cumsum(counts) - counts
    for lane, k in carried:
        words[first[lane] + k - 1] += np.uint64(1)
    while len(over := np.flatnonzero(words > MASK)):
        words[over] &= MASK
        words[over - 1] += np.uint64(1)  # a lane's first word never overflows: all its numbers are under 1
    return lanes, counts.astype(np.uint32), words.astype(np.uint32)


def _decode_ids(n: int, space: int, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes, steps = _lanes(n)
    if not n:
        return np.zeros(0, np.int64)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    place = np.cumsum(counts.astype(np.int64)) - counts
    end = place + counts

    def more(lane: np.ndarray) -> np.ndarray:
        p = place[lane]
        place[lane] = p + 1
        return np.where(p < end[lane], words[np.minimum(p, len(words) - 1)], np.uint64(0))

    code = more(np.arange(lanes)) << U32
    code |= more(np.arange(lanes))
    grid = np.zeros((steps, lanes), np.int32)
    model = Model(space, lanes, True)
    size = np.full(lanes, np.uint64(2**64 - 1))
    top = np.uint64(WHOLE - 1)
    for t in range(steps):
        m = (n - 1 - t) // steps + 1
        model.predict(m)
        r = size[:m] >> SHIFT
        v = np.minimum(code[:m] // r, top).astype(np.int32)
        hit2, hit1 = v < model.w2, v < model.w21
        x = model.p1.copy()
        start = model.w2 * ~hit2
        span = model.w21 - start
        np.copyto(x, model.p2, where=hit2)
        np.copyto(span, model.w2, where=hit2)
        i = np.flatnonzero(~hit1)
        zero, p1, p2, s1, s2 = (a.take(i) for a in (model.zero, model.p1, model.p2, model.s1, model.s2))
        u = (v[i] - model.w21[i]) // zero
        # put back the shares that stand at the front: of the higher one where u, with the lower one's, reaches it
        b1, b2 = model.below.take(p1), model.below.take(p2)
        front = s1 * (u >= b1 - s2 * (p2 < p1))
        front += s2 * (u >= b2 - s1 * (p1 < p2))
        u += front
        y = model.owner.take(np.minimum(u, (1 << TOTAL_BITS) - 1))
        before = model.below.take(y) - front
        x[i] = y
        start[i] = model.w21[i] + zero * before
        span[i] = zero * model.share.take(y)
        code[:m] -= r * start.astype(np.uint64)
        size[:m] = r * span.astype(np.uint64)
        at = np.flatnonzero(size[:m] < LOW)
        code[at] = (code[at] << U32) | more(at)
        size[at] <<= U32
        if (x >= space).any() or not size[:m].all():
            raise ValueError("block is damaged")
        grid[t, :m] = x
        model.learn(x, model.p1 == x, model.p2 == x, t)
    return _turned(grid).ravel()[:n].astype(np.int64)


def encode_block(doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of documents: doc_ids and lens (ids each) as a table, then the ids of all of them."""
    space = int(ids.max(initial=0)) + 1
    lanes, counts, words = _encode_ids(ids, space)
    table = zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + lens.astype("<u8").tobytes() + counts.astype("<u4").tobytes(), 1)
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(ids), space, lanes, zlib.crc32(ids.astype("<u4").tobytes()), len(table))
    body = head + table + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lens and ids of a block; ValueError if it is not as it was written."""
    at = struct.calcsize(HEAD)
    if len(block) < at + 4 or struct.unpack("<I", block[-4:])[0] != zlib.crc32(block[:-4]):
        raise ValueError("block is damaged")
    magic, docs, n, space, lanes, crc, size = struct.unpack(HEAD, block[:at])
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    table = zlib.decompress(block[at : at + size])
    doc_ids = np.cumsum(np.frombuffer(table, "<i8", docs))
    lens = np.frombuffer(table, "<u8", docs, 8 * docs).astype(np.int64)
    counts = np.frombuffer(table, "<u4", lanes, 16 * docs)
    ids = _decode_ids(n, space, counts, np.frombuffer(block[at + size : -4], "<u4"))
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids differ from those written")
    return doc_ids, lens, ids
