"""Array kernels over text: words, lines, hashes and SimHash without a Python loop per word.

A word is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII, after
lower-casing. Texts are handled in pieces of about PIECE bytes (a longer text is one piece); hashes are
made in windows of WINDOW bytes, so beyond the text itself a piece costs some bytes a word. Nulls are read
as empty texts.

A hash of bytes is a polynomial in a fixed base modulo the prime 2 ** 61 - 1, scrambled: two different
runs of n bytes share it with odds of about n * 2 ** -61. Runs of more than LONG_RUN bytes have the first
eight bytes of their BLAKE2b digest instead.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE, WINDOW, LONG_RUN, _BITS = 2 << 20, 1 << 18, 1 << 16, 1 << 14
U = np.uint64

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _lo, _hi in (("a", "z"), ("A", "Z"), ("0", "9")):
    _WORD[ord(_lo) : ord(_hi) + 1] = True

#: bytes other than white space, for words between spaces
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_P = (1 << 61) - 1
_BASE = 0x1A2F5C3B97D4E861 % _P
_M30, _M31 = U((1 << 30) - 1), U((1 << 31) - 1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        e = min(k, n - k)
        out[k : k + e] = out[:e] * U(pow(base, k, 2**64))
        k += e
    return out[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2 ** 61 - 1."""
    x = (x >> U(61)) + (x & U(_P))
    return np.where(x >= U(_P), x - U(_P), x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo 2 ** 61 - 1, of numbers below it."""
    x1, x0, y1, y0 = x >> U(31), x & _M31, y >> U(31), y & _M31
    mid, low = x1 * y0 + x0 * y1, x0 * y0
    return _reduced(_reduced((x1 * y1 << U(1)) + (mid >> U(30)) + ((mid & _M30) << U(31))) + _reduced(low))


def _prime_powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        e = min(k, n - k)
        out[k : k + e] = times(out[:e], np.full(e, pow(base, k, _P), np.uint64))
        k += e
    return out


class _Table:
    """Powers of the base, as halves of 31 bits, and of its inverse; made once a process."""

    def __init__(self) -> None:
        n = WINDOW + LONG_RUN + 1
        up = _prime_powers(_BASE, n)
        self.low, self.high, self.down = up & _M31, up >> U(31), _prime_powers(pow(_BASE, -1, _P), n)


def once(kind: str, key: object, make):
    """make(), kept for the next task of this worker; of each kind the latest only. This module's own globals
    travel with every task, so they can't hold it."""
    held = sys.modules.setdefault("_heronry_held", types.ModuleType("_heronry_held")).__dict__
    if kind not in held or held[kind][0] != key:
        held.pop(kind, None)
        held[kind] = (key, make())
    return held[kind][1]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end]; start ascends."""
    table, out = once("powers", 0, _Table), np.zeros(len(start), np.uint64)
    long = end - start > LONG_RUN
    some = np.flatnonzero(~long) if long.any() else None
    s, e = (start, end) if some is None else (start[some], end[some])
    at = 0
    while at < len(s):
        lo = int(s[at])
        to = int(np.searchsorted(s, lo + WINDOW))
        i, j = s[at:to] - lo, e[at:to] - lo
        d = data[lo : lo + int(j.max())].astype(np.uint64) + U(1)
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(d * table.low[: len(d)], out=sums[1:])
        low = sums[j] - sums[i]
        np.cumsum(d * table.high[: len(d)], out=sums[1:])
        high = sums[j] - sums[i]
        value = _reduced((high >> U(30)) + ((high & _M30) << U(31)) + _reduced(low))
        out[slice(at, to) if some is None else some[at:to]] = mix(times(value, table.down[i]))
        at = to
    for k in np.flatnonzero(long).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def equal(a: np.ndarray, start: np.ndarray, end: np.ndarray, b: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Whether the bytes a[start:end] are b[start_b:end_b], run by run."""
    ok = end - start == end_b - start_b
    size = np.where(ok, end - start, 0)
    a, b = (np.concatenate([x, np.zeros(8, np.uint8)]) for x in (a, b))
    wide_a, wide_b = (np.ndarray(len(x) - 7, np.dtype("<u8"), x, strides=(1,)) for x in (a, b))
    for at in range(0, int(size.max(initial=0)), 8):
        open_ = np.flatnonzero(ok & (size > at))
        differ = wide_a[start[open_] + at] ^ wide_b[start_b[open_] + at]
        left = np.minimum(size[open_] - at, 8).astype(np.uint64) * U(8)
        differ = np.where(left < U(64), differ & ((U(1) << (left & U(63))) - U(1)), differ)
        ok[open_[differ != 0]] = False
        if len(open_) < 64 and at > 64:  # a few long runs are compared at once
            for k in open_[differ == 0].tolist():
                ok[k] = np.array_equal(a[start[k] : end[k]], b[start_b[k] : end_b[k]])
            break
    return ok


def named(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one run of each kind of equal bytes, the kind of each run), given hashes of the runs. Bytes decide."""
    _, sample, which = np.unique(h, return_index=True, return_inverse=True)
    one = sample[which]
    wrong = np.flatnonzero(~equal(data, start, end, data, start[one], end[one]))
    more: dict[bytes, int] = {}
    for k in wrong.tolist():  # of equal hash, but other bytes
        which[k] = len(sample) + more.setdefault(data[start[k] : end[k]].tobytes(), len(more))
    if more:
        first = np.full(len(more), -1)
        first[which[wrong][::-1] - len(sample)] = wrong[::-1]
        sample = np.append(sample, first)
    return sample, which


@dataclass
class Piece:
    """Words of rows first .. first + n_rows of an array; row, start, end and hash have one entry per word."""

    first: int
    n_rows: int
    data: np.ndarray
    row_starts: np.ndarray  # n_rows + 1 byte offsets
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def prefix_hashes(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the first length bytes of some words, all of which are longer."""
        return hashes(self.data, self.start[words], self.start[words] + length)

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about limit bytes."""
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _changes(flags: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true flags begin and end; a run ends at each cut too."""
    n = len(flags)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = flags[1:] != flags[:-1]
    edge[cut] = True
    edge[0] = edge[n] = True
    at = np.flatnonzero(edge)
    inside = flags[at[:-1]]
    return at[:-1][inside], at[1:][inside]


def pieces(texts: pa.Array, limit: int = PIECE, lower: bool = True, word: np.ndarray = _WORD) -> Iterator[Piece]:
    """The words (runs of bytes that word tells) of every text, a piece at a time."""
    for first, data, offsets in _slices(lowered(texts) if lower else pc.fill_null(texts.cast(pa.large_string()), ""), limit):
        start, end = _changes(word[data], offsets)
        row = np.searchsorted(offsets, start, "right") - 1
        yield Piece(first, len(offsets) - 1, data, offsets, row, start, end, hashes(data, start, end))


def starts_of(sorted_ids: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_ids):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_ids[1:] != sorted_ids[:-1]) + 1])


def distinct(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (id, hash) pairs, ids as non-decreasing as they came."""
    _, first = np.unique(mix(hashes ^ mix(ids.astype(np.uint64), 11)), return_index=True)
    first.sort()
    return ids[first], hashes[first]


def simhash(hashes: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHash of the features of each of n segments; ids is non-decreasing. Bit b is set where
    more than half of the features have it; a segment without features gets 0."""
    acc = np.zeros((n, 64), np.int32)
    for lo in range(0, len(hashes), _BITS):
        part, seg = hashes[lo : lo + _BITS], ids[lo : lo + _BITS]
        runs = starts_of(seg)
        lengths = np.diff(np.append(runs, len(seg)))
        if lengths.max() > 255:  # a one-byte counter holds 255
            extra = -(-lengths // 255)
            runs = np.repeat(runs, extra) + 255 * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra))
            lengths = np.diff(np.append(runs, len(seg)))
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)  # eight one-byte counters each
        counts = np.add.reduceat(bits, runs, axis=0)
        signed = 2 * counts.view(np.uint8).reshape(len(runs), 64).astype(np.int32) - lengths[:, None].astype(np.int32)
        owner = seg[runs]
        heads = starts_of(owner)
        acc[owner[heads]] += np.add.reduceat(signed, heads, axis=0)
    return np.packbits(acc > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the connected group of each of n nodes, given edges a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
