"""Adaptive range coder for token ids: order-0 to order-2 predictions, independent checksummed blocks.

Chunk layout (little endian): magic, u32 crc32 of all from here to the payloads; u32 ids, u32
blocks, u32 kinds; kinds x u16 id and u16 frequency - 1 (order 0, total 65,536); per block
u32 words and u32 crc32 of its payload; payloads of u16 words. A flipped bit anywhere raises. Every block but the last codes BLOCK ids and resets all adaptive state.

An id is coded as the order-2 prediction, the order-1 prediction, or by order 0. The shares of
the three are mixed from adaptive probabilities, chosen by how often the two predictions held
and whether they agree. An id takes one step of the coder: the share, then within it the
order-0 interval (the whole of it after a prediction that held). All blocks of a chunk advance
together, one id a step, as numpy lanes.
"""
from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"ACM3"
FIXED = 20         # bytes before the order-0 table
BLOCK = 1024
SLOTS = 512        # entries of a block's order-1 and order-2 tables
BITS = 12          # precision of a share
RATE = 5           # adaptation: a share moves by 1/32 of its error, and stays within 31..4,064
U16, U64 = np.uint16, np.uint64
FULL, LOW32 = U64(0xFFFFFFFFFFFFFFFF), U64(0xFFFFFFFF)
S12, S16, S32, S48 = U64(BITS), U64(16), U64(32), U64(48)
WHOLE = 65536      # in place of an id: a prediction held, so order 0 has nothing to say


class _Model:
    """Predictions and shares of L blocks, advanced by the ids that were coded.

    A table entry is 4 * id + trust, trust 0 to 3."""

    def __init__(self, lanes: int):
        self.at = np.arange(lanes) * SLOTS
        self.row = np.arange(lanes) * 32
        self.table = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]
        self.share = [np.full(lanes * 32, 512, np.int32) for _ in range(2)]
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self):
        """(order-2 id, order-1 id, share of order 2, share of order 1)."""
        h = self.last * 40503
        self.cell = (self.at + (((h ^ self.before) >> 5) & (SLOTS - 1)), self.at + ((h >> 4) & (SLOTS - 1)))
        e2, e1 = self.seen = (self.table[0].take(self.cell[0]), self.table[1].take(self.cell[1]))
        p2, p1 = e2 >> 2, e1 >> 2
        self.ctx = self.row + (((e2 & 3) << 3) + ((e1 & 3) << 1) + (p2 == p1))
        s2, q1 = self.odds = (self.share[0].take(self.ctx), self.share[1].take(self.ctx))
        return p2, p1, s2, np.maximum(((1 << BITS) - s2) * q1 >> BITS, 1)

    def update(self, ids: np.ndarray, two: np.ndarray, first: np.ndarray) -> None:
        """``two``, ``first``: where the order-2 and the order-1 prediction held."""
        fresh = ids << 2
        for k, hit in enumerate((two, first)):
            e = self.seen[k]
            trust = e & 3
            self.table[k][self.cell[k]] = np.where(hit, e + (trust < 3), np.where(trust > 1, e - trust + 1, fresh))
            p = self.odds[k]
            moved = p - (p >> RATE) + hit * np.int32((1 << BITS - RATE) - 1)
            # Order 1 is asked only where order 2 failed.
            self.share[k][self.ctx] = np.where(two, p, moved) if k else moved
        self.before, self.last = self.last * 60493, ids.astype(np.int64)


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and frequencies of at least 1 that add up to 65,536."""
    kinds, n = np.unique(ids, return_counts=True)
    f = np.maximum(n * (65536 - len(kinds)) // max(len(ids), 1), 1)
    f[np.argmax(f)] += 65536 - f.sum()
    return kinds, f


def _tables(kinds: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of every id's order-0 interval, and of WHOLE."""
    start, size = np.zeros(WHOLE + 1, U64), np.zeros(WHOLE + 1, U64)
    start[kinds], size[kinds] = np.cumsum(freq) - freq, freq
    size[WHOLE] = WHOLE
    return start, size


def _shift(low: np.ndarray, rng: np.ndarray):
    """Yield (lanes, whose top word is settled, low of them) until every range is wide again; both arrays change in place."""
    some = None
    lo, r = low, rng
    while True:
        settled = (lo ^ (lo + r)) >> S48 == 0
        go = np.flatnonzero(settled | (r <= LOW32))
        if not len(go):
            return
        some, lo, r, settled = (go if some is None else some[go]), lo[go], r[go], settled[go]
        # A short range that straddles a word is cut at the next boundary.
        r = np.where(settled, r, (U64(0) - lo) & LOW32)
        yield some, lo
        lo, r = lo << S16, r << S16
        low[some], rng[some] = lo, r


def _sealed(head: bytes) -> bytes:
    return MAGIC + zlib.crc32(head).to_bytes(4, "little") + head


def encode(ids: np.ndarray) -> bytes:
    """A chunk of ids below 65,536, any number of them."""
    n_blocks = -(-len(ids) // BLOCK)
    kinds, freq = _frequencies(ids) if len(ids) else (np.zeros(0, int), np.zeros(0, int))
    head = np.array([len(ids), n_blocks, len(kinds)], "<u4").tobytes() + np.stack([kinds, freq - 1], 1).astype("<u2").tobytes()
    if not n_blocks:
        return _sealed(head)
    start, size = _tables(kinds, freq)
    steps = np.full(n_blocks * BLOCK, kinds[0], U16)
    steps[:len(ids)] = ids
    steps = np.ascontiguousarray(steps.reshape(n_blocks, BLOCK).T)
    model = _Model(n_blocks)
    low, rng = np.zeros(n_blocks, U64), np.full(n_blocks, FULL, U64)
    words, n = np.zeros((n_blocks, 4 * BLOCK + 8), U16), np.zeros(n_blocks, np.int64)
    for step in steps:
        now = step.astype(np.int32)
        p2, p1, s2, s1 = model.predict()
        two, first = p2 == now, p1 == now
        s12 = s2 + s1
        unit = rng >> S12
        low += unit * np.where(two, 0, np.where(first, s2, s12)).astype(U64)
        unit = (unit * np.where(two, s2, np.where(first, s1, (1 << BITS) - s12)).astype(U64)) >> S16
        x = np.where(two | first, WHOLE, now)
        low += unit * start.take(x)
        rng = unit * size.take(x)
        for lanes, lo in _shift(low, rng):
            words[lanes, n[lanes]] = lo >> S48
            n[lanes] += 1
        model.update(now, two, first)
    lanes = np.arange(n_blocks)
    for k in (S48, S32, S16, U64(0)):
        words[lanes, n] = (low >> k).astype(U16)
        n += 1
    parts = [words[i, :m].astype("<u2").tobytes() for i, m in enumerate(n)]
    index = np.array([(len(p) // 2, zlib.crc32(p)) for p in parts], "<u4")
    return _sealed(head + index.tobytes()) + b"".join(parts)


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk; a wrong magic or checksum raises ValueError."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    crc, n, n_blocks, n_kinds = (int(x) for x in np.frombuffer(chunk, "<u4", 4, 4))
    payloads = FIXED + 4 * n_kinds + 8 * n_blocks
    if zlib.crc32(chunk[8:payloads]) != crc:
        raise ValueError("the header is damaged")
    table = np.frombuffer(chunk, "<u2", 2 * n_kinds, FIXED).reshape(-1, 2).astype(np.int64)
    if not n_blocks:
        return np.zeros(0, np.int32)
    kinds, freq = table[:, 0], table[:, 1] + 1
    start, size = _tables(kinds, freq)
    find = np.repeat(kinds, freq).astype(np.int32)
    index = np.frombuffer(chunk, "<u4", 2 * n_blocks, FIXED + 4 * n_kinds).reshape(-1, 2).astype(np.int64)
    at = payloads + 2 * (np.cumsum(index[:, 0]) - index[:, 0])
    words = np.zeros((n_blocks, int(index[:, 0].max()) + 8), U16)
    for i, (length, crc) in enumerate(index):
        payload = chunk[at[i]:at[i] + 2 * length]
        if zlib.crc32(payload) != crc:
            raise ValueError(f"block {i} is damaged")
        words[i, :length] = np.frombuffer(payload, "<u2")
    low, rng, pos = np.zeros(n_blocks, U64), np.full(n_blocks, FULL, U64), np.full(n_blocks, 4)
    code = np.zeros(n_blocks, U64)
    for k in range(4):
        code = (code << S16) | words[:, k]
    model, out = _Model(n_blocks), np.zeros((BLOCK, n_blocks), np.int32)
    for step in range(BLOCK):
        p2, p1, s2, s1 = model.predict()
        s12 = s2 + s1
        unit = rng >> S12
        v = np.minimum((code - low) // unit, U64((1 << BITS) - 1)).astype(np.int32)
        two, held = v < s2, v < s12
        low += unit * np.where(two, 0, np.where(held, s2, s12)).astype(U64)
        unit = (unit * np.where(two, s2, np.where(held, s1, (1 << BITS) - s12)).astype(U64)) >> S16
        other = find.take(np.minimum((code - low) // unit, U64(65535)).astype(np.int64))
        now = np.where(two, p2, np.where(held, p1, other))
        x = np.where(held, WHOLE, now)
        low += unit * start.take(x)
        rng = unit * size.take(x)
        for lanes, _ in _shift(low, rng):
            code[lanes] = (code[lanes] << S16) | words[lanes, pos[lanes]]
            pos[lanes] += 1
        model.update(now, p2 == now, p1 == now)
        out[step] = now
    return out.T.reshape(-1)[:n]
