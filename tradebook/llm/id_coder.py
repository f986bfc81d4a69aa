"""Adaptive range coder for token ids: predictions of orders 0 to 2 are mixed, and blocks stand alone.

A block lists its distinct ids; inside the block an id is its rank in that list.
For each id the last successor of the two ids before it (order 2) or of the one
before it (order 1) is the candidate.  Three estimates of its probability, from
the record of either order and from the counts of the block so far (order 0),
are mixed in the logistic domain with weights that learn from every id; the
range coder codes "candidate or not" with the mix, and an id that isn't the
candidate with the order-0 counts.  Everything is integer arithmetic, so decoding
repeats encoding on any machine.

Blocks share nothing, so numpy works on many at once, one step of each block at a
time; a block decodes the same alone or among others.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import lru_cache

import numpy as np

BLOCK = 8192  # ids per block; the last block of a file may be shorter
LANES = 1024  # blocks that are worked on at once
HASHED = 4096  # contexts of order 2 per block
GAIN = 2  # what an occurrence adds to a count
_HEAD = struct.Struct("<IIIIII")  # ids, distinct ids, bytes of their list, words of the code, crc of ids, crc of body
_FULL, _LEAST = 63, np.uint64(1 << 31)


@lru_cache(1)
def _logistic() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """stretch of a 12-bit probability, squash to 12 bits of -2047..2047, and 256 ln of whole numbers."""
    stretch = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int32)
    squash = np.array([min(4080, max(16, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
    logs = np.array([0] + [round(256 * math.log(n)) for n in range(1, BLOCK * GAIN + BLOCK + 1)], np.int32)
    return stretch, squash, logs


_KEEP = np.array([(s >> 1) - s for s in range(8)] + [1] * 7 + [0], np.int32)  # change of confidence, by itself + 8 if right


class _State:
    """Models of a group of blocks, one lane each.  No step branches on data: lanes are chosen by multiplying with 0 or 1."""

    def __init__(self, distinct: np.ndarray):
        n, self.k = len(distinct), 1 << int(distinct.max()).bit_length()  # a power of two over the most distinct ids
        self.n = n
        self.row = np.arange(n) * self.k
        # tables of many cells are 16 bits wide: sums stay under GAIN * BLOCK + BLOCK, ranks under BLOCK
        self.counts = (np.arange(self.k)[None] < distinct[:, None]).astype(np.int16).ravel()
        self.sums = np.zeros(n * self.k, np.int16)
        self.one = np.zeros(n * self.k, np.uint16)  # candidate * 8 + confidence
        self.two = np.zeros(n * HASHED, np.uint16)
        self.right1, self.right2 = np.full(n * 16, 2048 << 4, np.int32), np.full(n * 8, 2048 << 4, np.int32)
        self.row16, self.row8, self.rowh = np.arange(n) * 16, np.arange(n) * 8, np.arange(n) * HASHED
        self.w0, self.w1, self.w2 = (np.full(n, w, np.int32) for w in (1 << 13, 1 << 14, 3 << 14))
        self.p1 = self.p2 = np.zeros(n, np.int32)
        self.stretch, self.squash, self.logs = _logistic()
        self.rebuild()

    def rebuild(self) -> None:
        """Sums of the counts before each rank; the last rank is never used, so its sum is the total."""
        s, c = self.sums.reshape(self.n, self.k), self.counts.reshape(self.n, self.k)
        np.cumsum(c[:, :-1], axis=1, dtype=np.int16, out=s[:, 1:])
        total = s[:, -1]
        self.total, self.log_total = total.astype(np.uint64), self.logs.take(total)

    def shrink(self, n: int) -> None:
        """The last lanes have ended."""
        if n == self.n:
            return
        for name in ("row", "total", "log_total", "row16", "row8", "rowh", "w0", "w1", "w2", "p1", "p2"):
            setattr(self, name, getattr(self, name)[:n])
        self.counts, self.sums, self.n = self.counts[: n * self.k], self.sums[: n * self.k], n

    def predict(self) -> None:
        """Candidate and the 12-bit probability that it is next."""
        self.at1 = self.row + self.p1
        self.at2 = self.rowh + ((self.p2 * 2713 + self.p1) & (HASHED - 1))
        self.said1, self.said2 = self.one.take(self.at1).astype(np.int32), self.two.take(self.at2).astype(np.int32)
        self.sure1, self.sure2 = self.said1 & 7, self.said2 & 7
        self.guess1, self.guess2 = self.said1 >> 3, self.said2 >> 3
        self.guess = self.guess1 + (self.guess2 - self.guess1) * (self.sure2 > 0)
        self.in1 = self.row16 + self.sure1 * 2 + (self.guess1 == self.guess)
        self.in2 = self.row8 + self.sure2
        self.rate1, self.rate2 = self.right1.take(self.in1), self.right2.take(self.in2)
        self.x1, self.x2 = self.stretch.take(self.rate1 >> 4), self.stretch.take(self.rate2 >> 4)
        self.x0 = self.logs.take(self.counts.take(self.row + self.guess)) - self.log_total
        dot = (self.w0 * self.x0 + self.w1 * self.x1 + self.w2 * self.x2) >> 16
        self.p = self.squash.take(dot + 2047, mode="clip")

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        off = (hit << 12) - self.p
        self.w0 = self.w0 + ((self.x0 * off) >> 12)
        self.w1 = self.w1 + ((self.x1 * off) >> 12)
        self.w2 = self.w2 + ((self.x2 * off) >> 12)
        aim = hit * 65520
        self.right1[self.in1] = self.rate1 + ((aim - self.rate1) >> 5)
        self.right2[self.in2] = self.rate2 + ((aim - self.rate2) >> 5)
        fresh = ids * 8 + 1
        self.one[self.at1] = _told(self.said1, self.sure1, self.guess1 == ids, fresh)
        self.two[self.at2] = _told(self.said2, self.sure2, self.guess2 == ids, fresh)
        at = self.row + ids
        self.counts[at] = self.counts.take(at) + GAIN
        self.p2, self.p1 = self.p1, ids


def _told(said: np.ndarray, sure: np.ndarray, right: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """A right candidate gains confidence, a wrong one loses half and goes when little is left."""
    kept = said + _KEEP.take(sure + right * 8)
    return kept + (fresh - kept) * ((sure <= 1) & ~right)


def _rebuilds(step: int) -> bool:
    return step % 256 == 0 or step >= 16 and step < 256 and step & (step - 1) == 0


# --- blocks to bytes and back ------------------------------------------------------------------------------


def _gaps(ids: np.ndarray) -> bytes:
    """Sorted distinct ids as gaps of one byte, or 255 and four bytes, deflated."""
    gaps = np.diff(ids.astype(np.int64), prepend=-1) - 1
    small = gaps < 255
    if small.all():
        raw = gaps.astype(np.uint8).tobytes()
    else:
        raw = b"".join(bytes([g]) if g < 255 else b"\xff" + struct.pack("<I", g) for g in gaps.tolist())
    return zlib.compress(raw, 6)


def _ids(raw: bytes) -> np.ndarray:
    data = zlib.decompress(raw)
    if b"\xff" not in data:
        gaps = np.frombuffer(data, np.uint8).astype(np.int64)
    else:
        out, at = [], 0
        while at < len(data):
            if data[at] < 255:
                out.append(data[at])
                at += 1
            else:
                out.append(struct.unpack_from("<I", data, at + 1)[0])
                at += 5
        gaps = np.array(out, np.int64)
    return np.cumsum(gaps + 1) - 1


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Blocks of ``block`` ids each, the last one shorter."""
    ids = np.ascontiguousarray(ids, "<u4")
    if not 0 < block <= BLOCK:
        raise ValueError(f"a block holds 1 to {BLOCK} ids")
    out: list[bytes] = []
    for at in range(0, len(ids), LANES * block):
        out += _encode_group(ids[at : at + LANES * block], block)
    return out


def _encode_group(ids: np.ndarray, block: int) -> list[bytes]:
    parts = [ids[i : i + block] for i in range(0, len(ids), block)]
    lengths = np.array([len(p) for p in parts])
    n, steps = len(parts), int(lengths[0])
    ranked, lists = np.zeros((steps, n), np.int16), []
    for k, p in enumerate(parts):
        distinct, ranked[: len(p), k] = np.unique(p, return_inverse=True)
        lists.append(distinct)
    s = _State(np.array([len(x) for x in lists]))
    low, size = np.zeros(n, np.uint64), np.full(n, 1 << (_FULL - 1), np.uint64)
    room = min(steps, 1024) + 4
    words, used = np.zeros((n, room), np.uint64), np.zeros(n, np.int64)
    flat, base = words.ravel(), np.arange(n) * room
    twelve, down, five, all33, full = (np.uint64(x) for x in (12, 31, 5, 33, (1 << 64) - 1))
    for t in range(steps):
        if t == lengths[-1]:
            s.shrink(n - 1)
        if _rebuilds(t):
            s.rebuild()
            if int(used.max()) + 260 > room:  # at most a word a step
                words = np.concatenate([words, np.zeros_like(words)], axis=1)
                room *= 2
                flat, base = words.ravel(), np.arange(n) * room
        a = s.n
        lo, sz, now = low[:a], size[:a], ranked[t, :a].astype(np.int32)
        s.predict()
        hit = now == s.guess
        cut = (sz >> twelve) * s.p.astype(np.uint64)
        here = s.row + now
        begin, end = s.sums.take(here).astype(np.uint64), s.sums.take(here + 1).astype(np.uint64)
        unit = (sz - cut) // s.total
        miss = (~hit).astype(np.uint64)
        lo += (cut + unit * begin) * miss
        other = unit * (end - begin)
        sz[:] = cut + (other - cut) * miss  # modulo 2^64, so right for either sign
        out = (sz < _LEAST).astype(np.uint64)
        flat[base[:a] + used[:a]] = lo >> down  # overwritten next time if nothing goes out
        used[:a] += out.astype(np.int64)
        shift = out << five
        lo &= full >> (out * all33)
        lo <<= shift
        sz <<= shift
        s.learn(now, hit.astype(np.int32))
    rest, up, one = np.uint64((1 << 31) - 1), np.uint64(32), np.uint64(1)
    every = np.arange(n)
    words[every, used] = low >> down
    words[every, used + 1] = (low & rest) << one
    used += 2
    carry = np.zeros(n, np.uint64)
    for t in range(int(used.max()) - 1, -1, -1):
        inside = (used > t).astype(np.uint64)
        w = words[:, t] + carry
        words[:, t] = w & np.uint64(0xFFFFFFFF)
        carry = (w >> up) * inside
    result = []
    for k in range(n):
        listed = _gaps(lists[k])
        body = listed + words[k, : used[k]].astype("<u4").tobytes()
        head = _HEAD.pack(len(parts[k]), len(lists[k]), len(listed), int(used[k]), zlib.crc32(parts[k].tobytes()), zlib.crc32(body))
        result.append(head + body)
    return result


def block_size(head: bytes) -> int:
    """Bytes of a block, from its first ``_HEAD.size`` bytes."""
    _, _, listed, words, _, _ = _HEAD.unpack(head)
    return _HEAD.size + listed + 4 * words


HEAD_SIZE = _HEAD.size


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks in a row; only the last may be shorter than the first.  Damage is an error."""
    out = [_decode_group(blocks[at : at + LANES]) for at in range(0, len(blocks), LANES)]
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _decode_group(blocks: list[bytes]) -> np.ndarray:
    heads = [_HEAD.unpack_from(b) for b in blocks]
    lists, codes = [], []
    for b, (_, k, listed, words, _, check) in zip(blocks, heads, strict=True):
        body = b[_HEAD.size :]
        if zlib.crc32(body) != check or len(body) != listed + 4 * words:
            raise ValueError("a block of ids is damaged")
        lists.append(_ids(body[:listed]))
        codes.append(np.frombuffer(body, "<u4", words, listed).astype(np.uint64))
    lengths = np.array([h[0] for h in heads])
    n, steps = len(blocks), int(lengths[0])
    if (lengths[:-1] != steps).any() or lengths[-1] > steps:
        raise ValueError("only the last block may be shorter")
    longest = max(len(c) for c in codes) + 2
    code = np.zeros((n, longest), np.uint64)
    for k, c in enumerate(codes):
        code[k, : len(c)] = c
    one, down = np.uint64(1), np.uint64(31)
    off = (code[:, 0] << down) | (code[:, 1] >> one)
    code[:, :-1] = ((code[:, :-1] & one) << down) | (code[:, 1:] >> one)  # what comes in after each shift
    code, base = code.ravel(), np.arange(n) * longest
    used = np.ones(n, np.int64)
    s = _State(np.array([len(x) for x in lists]))
    size = np.full(n, 1 << (_FULL - 1), np.uint64)
    ranked = np.zeros((steps, n), np.int16)
    twelve, five, zero = np.uint64(12), np.uint64(5), np.uint64(0)
    jumps = [s.k >> i for i in range(1, s.k.bit_length())]
    for t in range(steps):
        if t == lengths[-1]:
            s.shrink(n - 1)
        if _rebuilds(t):
            s.rebuild()
        a = s.n
        of, sz = off[:a], size[:a]
        s.predict()
        cut = (sz >> twelve) * s.p.astype(np.uint64)
        miss = of >= cut
        missed = miss.astype(np.uint64)
        rest = of - cut * missed
        unit = (sz - cut) // s.total
        want = np.minimum(rest // unit, s.total - one).astype(np.int16)
        at = s.row  # the last rank whose sum isn't above
        for jump in jumps:
            at = at + (s.sums.take(at + jump) <= want) * jump
        begin, end = s.sums.take(at).astype(np.uint64), s.sums.take(at + 1, mode="clip").astype(np.uint64)
        of[:] = rest - unit * begin * missed
        other = unit * (end - begin)
        sz[:] = cut + (other - cut) * missed
        now = s.guess + ((at - s.row).astype(np.int32) - s.guess) * miss
        out = (sz < _LEAST).astype(np.uint64)
        shift = out << five
        of[:] = (of << shift) | (code.take(base[:a] + used[:a], mode="clip") & (zero - out))
        used[:a] += out.astype(np.int64)
        sz <<= shift
        ranked[t, :a] = now
        s.learn(now, (~miss).astype(np.int32))
    result = []
    for k, (count, _, _, _, check, _) in enumerate(heads):
        ids = lists[k][ranked[:count, k]].astype("<u4")
        if zlib.crc32(ids.tobytes()) != check:
            raise ValueError("a block of ids doesn't decode to what it held")
        result.append(ids)
    return np.concatenate(result)
