"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks that are coded independently: model and coder start
anew in every block, and each block carries its id count and CRC-32.  Three
predictors guess the next id: the id last seen after the two previous ids
(order 2), after the previous id (order 1), and a cache of recent ids (order
0).  Their confidences and their recent success are mixed into one
distribution over {order 2, order 1, cached id, new id}, which a range coder
with carry codes; a cached id adds its cache slot, a new id its plain bits.

All blocks of a call run in step, one numpy lane per block.  Ids and words of
one place lie together, so that a step reads and writes its neighbours.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
MAGIC = 0x31444951
_SLOTS = 8                   # bits of a block's order-1 and order-2 tables
_CACHE = 8                   # bits of the order-0 cache
_TOTAL = 12                  # bits of the coded distribution
_LOW = np.uint64((1 << 48) - 1)
_CONF = 27                   # an entry is id | confidence << 27
_CONF32 = np.uint32(_CONF)
_ID = np.uint32((1 << _CONF) - 1)
_SHARE = np.array([60, 500, 1100, 1700, 2200, 2500, 2750, 2900, 3050, 3150, 3250, 3330, 3400, 3470, 3540, 3600],
                  dtype=np.int32)
# by confidence, then by confidence + 16 after a hit: change of an entry
_STEP = np.array([(k >> 1) - k for k in range(16)] + [int(k < 15) for k in range(16)], dtype=np.int64) << _CONF
_STEP = (_STEP & 0xFFFFFFFF).astype(np.uint32)
_HEAD = struct.Struct("<4I")
_HASH = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
HEADER = np.dtype([("magic", "<u4"), ("ids", "<u4"), ("words", "<u4"), ("crc", "<u4")])


class _Model:
    """Predictors of ``lanes`` blocks; ``predict``, ``slots`` and ``learn`` for every position.
    Orders 1 and 2 are rows of the same arrays."""

    def __init__(self, lanes: int):
        self.rows = np.arange(lanes, dtype=np.int64)
        self.base = np.stack([self.rows, self.rows + lanes]) << _SLOTS
        self.cbase = self.rows << _CACHE
        self.table = np.zeros(2 * lanes << _SLOTS, dtype=np.uint32)
        self.cache = np.full(lanes << _CACHE, _ID, dtype=np.uint32)
        self.w = np.full((3, lanes), 2048, dtype=np.int32)
        self.c1 = np.zeros(lanes, dtype=np.uint32)
        self.c2 = np.zeros(lanes, dtype=np.uint32)
        self.hashes = np.zeros((2, lanes), dtype=np.uint32)       # the first row: of c1
        self.bounds = np.zeros((5, lanes), dtype=np.uint64)
        self.flat = self.bounds.reshape(-1)
        self.bounds[4] = 1 << _TOTAL

    def predict(self, n: int) -> None:
        h = self.hashes[:, :n]
        h2 = self.c2[:n] * _HASH[1]
        h2 += h[0]
        np.multiply(h2, _HASH[2], out=h[1])
        self.at = (h >> np.uint32(32 - _SLOTS)).astype(np.int64)
        self.at += self.base[:, :n]
        self.e = self.table.take(self.at)
        self.p, self.k = self.e & _ID, (self.e >> _CONF32).astype(np.int64)
        f = _SHARE.take(self.k)
        f *= self.w[1:, :n]
        f >>= _TOTAL
        f1, f2 = f
        f2 += 1
        rest = (1 << _TOTAL) - f2
        f1 *= rest
        f1 >>= _TOTAL
        rest -= f1
        self.same = self.p[0] == self.p[1]
        twice = f1 * self.same
        f2 += twice
        f1 -= twice
        b = self.bounds
        b[1, :n] = f2
        f2 += f1
        b[2, :n] = f2
        rest *= self.w[0, :n]
        rest >>= _TOTAL
        f2 += rest
        b[3, :n] = f2

    def interval(self, n: int, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the chosen kind."""
        at = kind * len(self.rows)
        at += self.rows[:n]
        lo = self.flat.take(at)
        at += len(self.rows)
        width = self.flat.take(at)
        width -= lo
        return lo, width

    def slots(self, n: int, ids: np.ndarray) -> np.ndarray:
        """Cache slots of the ids; their hashes are those of the next position's order 1."""
        h = np.multiply(ids, _HASH[0], out=self.hashes[0, :n])
        at = (h >> np.uint32(32 - _CACHE)).astype(np.int64)
        at += self.cbase[:n]
        return at

    def learn(self, n: int, ids: np.ndarray, kind: np.ndarray, slot: np.ndarray) -> None:
        hit = self.p == ids
        fresh = (self.k < 2) > hit              # a weak entry that missed: the new id takes it
        step = hit.astype(np.int64)
        step <<= 4
        step += self.k
        self.e += _STEP.take(step)
        np.copyto(self.e, ids | np.uint32(1 << _CONF), where=fresh)
        self.table[self.at.reshape(-1)] = self.e.reshape(-1)
        w = self.w[1:, :n]
        change = hit * np.int32(4095)
        change -= w
        change >>= 5
        w += change
        w0 = self.w[0, :n]
        change = (kind == 2) * np.int32(3900)
        change -= w0
        change *= kind >= 2
        change >>= 5
        w0 += change
        self.cache[slot] = ids
        self.c2[:n] = self.c1[:n]
        self.c1[:n] = ids


def _quotient(v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``v // r`` of integers below 2**48, by floating point.

    It is exact: ``v / r`` is at least ``1 / r`` below the next integer ``q``, and doubles
    below ``q`` lie closer than that as ``q * r`` is less than 2**49."""
    # as signed integers, which convert faster
    return (v.view(np.int64) / r.view(np.int64)).astype(np.int64).view(np.uint64)


def _turned(a: np.ndarray) -> np.ndarray:
    """Rows as columns, copied a few rows at a time."""
    out = np.empty(a.shape[::-1], dtype=a.dtype)
    for i in range(0, len(a), 32):
        out[:, i:i + 32] = a[i:i + 32].T
    return out


def _carry(flat: np.ndarray, back: np.ndarray, lanes: int) -> None:
    """Add one to the words at ``back``; a full word passes it on to the one before it, ``lanes`` back."""
    while len(back):
        flat[back] += np.uint16(1)
        back = back[flat[back] == 0] - lanes


def encode_blocks(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, id_bits: int) -> list[bytes]:
    """Code the blocks ``ids[start:start+size]``; one byte string per block, header first."""
    order = np.argsort(-sizes, kind="stable")
    first, length = starts[order], sizes[order]
    lanes = len(order)
    steps = int(length[0]) if lanes else 0
    model = _Model(lanes)
    low = np.zeros(lanes, dtype=np.uint64)
    rng = np.full(lanes, (1 << 48) - 1, dtype=np.uint64)
    rows = np.zeros((lanes, steps), dtype=ids.dtype)
    for j, (a, n) in enumerate(zip(first.tolist(), length.tolist())):
        rows[j, :n] = ids[a:a + n]
    text = _turned(rows)
    del rows
    out = np.zeros((steps * 2 + 8, lanes), dtype=np.uint16)      # an id gives two words at most
    flat, where = out.reshape(-1), np.arange(lanes)              # where: of each lane's next word
    active = np.searchsorted(-length, -np.arange(steps), side="left")   # lanes with length > t
    full, bits = np.uint64(1 << 32), np.uint64(id_bits)
    total = np.uint64(_TOTAL + id_bits)
    shifts = np.array([id_bits, id_bits, id_bits - _CACHE, 0], dtype=np.uint64)   # by kind

    for t in range(steps):
        n = int(active[t])
        x = text[t, :n].astype(np.uint32)
        model.predict(n)
        slot = model.slots(n, x)
        b = model.bounds
        kind = 3 - ((model.cache.take(slot) == x) & (b[3, :n] > b[2, :n])).astype(np.int64)
        np.copyto(kind, 1, where=(model.p[0] == x) & ~model.same & (b[2, :n] > b[1, :n]))
        np.copyto(kind, 0, where=model.p[1] == x)
        lo, width = model.interval(n, kind)
        # a cached id takes its slot's part of the interval, a new id its own part
        width <<= shifts.take(kind)
        lo <<= bits
        part = x.astype(np.uint64)
        part *= kind == 3
        cached = np.flatnonzero(kind == 2)
        part[cached] = slot[cached] & ((1 << _CACHE) - 1)
        part *= width
        lo += part
        r = rng[:n] >> total
        lo *= r
        base = low[:n] + lo
        r *= width
        if (over := base > _LOW).any():
            _carry(flat, where[:n][over] - lanes, lanes)
            base &= _LOW
        # a word that is not yet due is written over later
        due = r < full
        flat[where[:n]] = (base >> np.uint64(32)).astype(np.uint16)
        where[:n] += due * np.int64(lanes)
        shift = due.astype(np.uint64) << np.uint64(4)
        r <<= shift
        base <<= shift
        base &= _LOW
        short = np.flatnonzero(r < full)
        while len(short):
            high, at = base[short], where[short]
            flat[at] = (high >> np.uint64(32)).astype(np.uint16)
            where[short] = at + lanes
            base[short] = (high << np.uint64(16)) & _LOW
            r[short] <<= np.uint64(16)
            short = short[r[short] < full]
        rng[:n], low[:n] = r, base
        model.learn(n, x, kind, slot)
    for shift in (32, 16, 0):
        flat[where] = ((low >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        where += lanes
    counts = (where // max(1, lanes)).tolist()
    words = _turned(out[:max(counts, default=0)]).astype("<u2", copy=False)
    coded: list[bytes] = [b""] * lanes
    for j, i in enumerate(order.tolist()):
        raw = ids[first[j]:first[j] + length[j]].astype("<u4")
        coded[i] = _HEAD.pack(MAGIC, length[j], counts[j], zlib.crc32(raw)) + words[j, :counts[j]].tobytes()
    return coded


def decode_blocks(blocks: list[bytes], id_bits: int) -> list[np.ndarray]:
    """Ids of every block (``<u4`` arrays); a damaged block raises ``ValueError``."""
    lanes = len(blocks)
    if not lanes:
        return []
    if min(map(len, blocks)) < HEADER.itemsize:
        raise ValueError("a block is cut short")
    heads = np.frombuffer(b"".join([b[:HEADER.itemsize] for b in blocks]), dtype=HEADER)
    if (heads["magic"] != MAGIC).any():
        raise ValueError("not a block")
    order = np.argsort(-heads["ids"].astype(np.int64), kind="stable")
    length, steps = heads["ids"].astype(np.int64)[order], int(heads["ids"].max())
    rows = np.zeros((lanes, int(heads["words"].max()) + 3), dtype=np.uint16)
    for j, i in enumerate(order.tolist()):
        w = np.frombuffer(blocks[i], dtype="<u2", offset=HEADER.itemsize)
        if len(w) != heads["words"][i]:
            raise ValueError("a block is cut short")
        rows[j, :len(w)] = w
    words = _turned(rows)
    del rows
    w64 = words[:3].astype(np.uint64)
    value = (w64[0] << np.uint64(32)) | (w64[1] << np.uint64(16)) | w64[2]
    flat, where = words.reshape(-1), np.arange(lanes) + 3 * lanes     # where: of each lane's next word
    rng = np.full(lanes, (1 << 48) - 1, dtype=np.uint64)
    model = _Model(lanes)
    text = np.zeros((steps, lanes), dtype=np.uint16 if id_bits <= 16 else np.uint32)
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    full, bits = np.uint64(1 << 32), np.uint64(id_bits)
    total = np.uint64(_TOTAL + id_bits)
    shifts = np.array([id_bits, id_bits, id_bits - _CACHE, 0], dtype=np.uint64)   # by kind

    for t in range(steps):
        n = int(active[t])
        model.predict(n)
        b = model.bounds
        r, v = rng[:n] >> total, value[:n]
        unit = r << bits
        kind = (v >= b[1, :n] * unit).astype(np.int64)
        kind += v >= b[2, :n] * unit
        kind += v >= b[3, :n] * unit
        lo, width = model.interval(n, kind)
        width <<= shifts.take(kind)
        lo *= unit
        v = v - lo
        r *= width
        # a new id, a cached id's slot; 0 for the predicted ones, whose interval is not cut further
        got = _quotient(v, r)
        v -= got * r
        x = got.astype(np.uint32)
        np.copyto(x, model.p[0], where=kind == 1)
        np.copyto(x, model.p[1], where=kind == 0)
        cached = np.flatnonzero(kind == 2)
        at = got.take(cached).astype(np.int64)
        at &= (1 << _CACHE) - 1
        at += model.cbase.take(cached)
        x[cached] = model.cache.take(at)
        due = r < full
        shift = due.astype(np.uint64) << np.uint64(4)
        v <<= shift
        v |= flat.take(where[:n], mode="clip") * due
        where[:n] += due * np.int64(lanes)
        r <<= shift
        short = np.flatnonzero(r < full)
        while len(short):
            at = where[short]
            v[short] = (v[short] << np.uint64(16)) | flat.take(at, mode="clip")
            where[short] = at + lanes
            r[short] <<= np.uint64(16)
            short = short[r[short] < full]
        value[:n], rng[:n] = v, r
        text[t, :n] = x
        model.learn(n, x, kind, model.slots(n, x))
    out = _turned(text)
    result: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * lanes
    for j, i in enumerate(order.tolist()):
        got = out[j, :length[j]].astype("<u4")
        if zlib.crc32(got) != heads["crc"][i]:
            raise ValueError("a block's checksum does not match")
        result[i] = got
    return result
