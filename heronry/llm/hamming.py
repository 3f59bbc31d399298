"""Pairs of 64-bit fingerprints within a small Hamming distance, exactly.

Pigeonhole: cut the 64 bits into m blocks; two fingerprints at distance r or less agree in some block
up to r // m bits.
"""

from __future__ import annotations

import numpy as np

from heronry.llm.vectext import components, expand, starts_of

U = np.uint64


def block_edges(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m blocks that cover 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_values(fps: np.ndarray, m: int) -> list[np.ndarray]:
    return [((fps >> U(shift)) & U((1 << width) - 1)).astype(np.int64) for shift, width in block_edges(m)]


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, chunk: int = 1 << 21):
    """Index pairs (i, j) of left and right at Hamming distance radius or less, in pieces of bounded memory."""
    rows = max(1, chunk // max(1, len(right)))
    for at in range(0, len(left), rows):
        for to in range(0, len(right), chunk):
            i, j = np.nonzero(np.bitwise_count(left[at : at + rows, None] ^ right[None, to : to + chunk]) <= radius)
            if len(i):
                yield i + at, j + to


def segment_pairs(starts: np.ndarray, lengths: np.ndarray, limit: int = 1 << 21):
    """All index pairs i < j inside each segment, many segments at a time; a segment with more than limit
    pairs comes alone as (None, segment number)."""
    counts = lengths * (lengths - 1) // 2
    big = counts > limit
    for s in np.flatnonzero(big):
        yield None, s
    small = np.flatnonzero(~big & (counts > 0))
    cum = np.cumsum(counts[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + limit, "right")))
        segs = small[at:to]
        first = expand(starts[segs], lengths[segs])  # every member
        end = np.repeat(starts[segs] + lengths[segs], lengths[segs])
        after = end - first - 1
        yield np.repeat(first, after), expand(first + 1, after)
        at = to


def star_edges(n: int, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges node - smallest node of its group that connect what edges a - b connect."""
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = components(n, np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


__all__ = ["block_edges", "block_values", "close_pairs", "segment_pairs", "star_edges", "starts_of"]
