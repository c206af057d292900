"""Array kernels over the UTF-8 bytes of a block of texts: word spans, word hashes, bit votes.

A block is (data, off): data are the bytes of some texts laid end to end, off[i]:off[i + 1] the i-th text.
Blocks stay small (BLOCK bytes, or one text), so that what a task holds doesn't follow the size of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, off) for runs of rows with about limit bytes. Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, where, body = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes within each text, and for each text its first run (one more at the end)."""
    n = len(member)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    cur = np.zeros(n + 1, bool)
    cur[:n] = member
    was = np.zeros(n + 1, bool)
    was[1:] = member
    starts = np.flatnonzero(cur & (~was | cut))
    ends = np.flatnonzero(was & (~cur | cut))
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _M1 + np.uint64(seed))
    if not len(starts):
        return h
    h = mix((h ^ (lanes[starts] & _MASK[np.minimum(left, 8)])) * _M1)
    at = np.flatnonzero(left > 8)
    step = 8
    while len(at):
        h[at] = mix((h[at] ^ (lanes[starts[at] + step] & _MASK[np.minimum(left[at] - step, 8)])) * _M1)
        step += 8
        at = at[left[at] > step]
    return h


def _spread() -> np.ndarray:
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    lanes = (bits.reshape(256, 2, 4).astype(np.uint64) << (np.arange(4, dtype=np.uint64) * np.uint64(16))).sum(-1, dtype=np.uint64)
    return np.ascontiguousarray(lanes.T)


_SPREAD, _FULL = _spread(), 60_000


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each segment's hashes have each of the 64 bits; first: the segments' starts, and the end."""
    size = np.diff(first)
    parts = np.maximum(1, -(-size // _FULL))
    owner = np.repeat(np.arange(len(size)), parts)
    cuts = first[:-1][owner] + _FULL * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    some = size[owner] > 0
    owner, cuts = owner[some], cuts[some]
    out = np.zeros((len(size), 64), np.int64)
    if not len(owner):
        return out
    part = np.empty((len(owner), 64), np.int64)
    for b in range(8):
        byte = ((h >> np.uint64(8 * b)) & np.uint64(255)).astype(np.intp)
        for half in range(2):
            lanes = np.add.reduceat(_SPREAD[half][byte], cuts)
            for j in range(4):
                part[:, 8 * b + 4 * half + j] = (lanes >> np.uint64(16 * j)) & np.uint64(0xFFFF)
    np.add.at(out, owner, part) if len(owner) != len(np.unique(owner)) else out.__setitem__(owner, part)
    return out


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 64-bit votes of each segment: a bit is 1 if more than half of the segment's hashes have it."""
    ones = 2 * bit_counts(h, first) > np.diff(first)[:, None]
    return (ones.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def votes(h: np.ndarray, first: np.ndarray, width: int = 32) -> np.ndarray:
    """The votes of each segment on the lowest `width` bits, in a fixed order of bits: four counts at a time, compared in place. A segment without hashes has none."""
    size = np.diff(first)
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    many = size[some]
    if many.max() > 16_000:
        return majority(h, first) & np.uint64((1 << width) - 1)
    cuts, ones, top = first[:-1][some], np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)
    bias = (0x7FFF - many).astype(np.uint64) * ones
    found = np.zeros(len(some), np.uint64)
    for b in range(width // 8):
        byte = ((h >> np.uint64(8 * b)) & np.uint64(255)).astype(np.intp)
        for half in range(2):
            x = (2 * np.add.reduceat(_SPREAD[half][byte], cuts) + bias) & top
            nibble = (x >> np.uint64(15) | x >> np.uint64(30) | x >> np.uint64(45) | x >> np.uint64(60)) & np.uint64(15)
            found |= nibble << np.uint64(8 * b + 4 * half)
    out[some] = found
    return out


def squeezed(data: np.ndarray, member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The member bytes, which are those of the spans, with one space after each span; where each now starts and ends."""
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[to + size] = False
    out[inside] = data[member]
    return out, to, to + size
