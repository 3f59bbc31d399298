"""Fuzzy line dedup.

A line is a part of a text between newlines; normalised, it is its words (see vectext) in lower case,
separated by single spaces. Lines with a word (MIN_WORDS) are compared, however short; blank ones always
stay. Two lines are linked iff the edit similarity of the normalised lines, 1 - Levenshtein / longer
length, is at least SIMILARITY. Of each connected group the first occurrence by (doc_id, line number) stays.

Candidates. Linked lines are looked for among those that share one of the KEYS overlapping character
n-grams of lowest hash (8 bytes for lines of under 64 bytes, 14 for others, both where lines of either
side may be similar) and whose two SimHashes differ in at most as many bits as GRAMS says: one is of 64 bits
over their words, each as often as it occurs, one of 64 bits over their 5-grams of bytes. Two lines that have a share J of their n-grams in common are missed with
odds of about (1 - J) ** KEYS; the README has the measured recall. Lines of fewer bytes than an n-gram are
compared by equality.

Plan. Equal lines collapse in one aggregation. Each line's SimHashes are sent to its KEYS, where pairs that share a
key are compared as arrays; a key sends back its members and a minimum spanning forest of its close pairs by
SimHash distance, so a family of n variants costs n pairs, not n * n, and most of its keys give the same ones. Each
distinct pair is verified by itself, with others of about its length, so neither a family nor a chain of candidates gathers in one task.
What is similar is connected; then the keys send the close pairs that are still in different groups, and these are
verified too. So every close pair that shares a key is verified unless it is connected already. A pair of the first
kind is first held to be similar by an alignment along common substrings, whose cost bounds the edit distance from above;
what is left is measured, many pairs at once, each until its limit can't be kept any more. Only lines that have a candidate have their texts fetched.

Cases: a null text stays null and has no lines in the result; an empty text has one, empty, line. A null
doc_id is compared like any other and comes last as an occurrence to keep. Rows that repeat doc_id and
text are treated alike, as one document: all stay or lose a line together. clean() keeps every column of its input, rewrites text (and n_chars, if there),
and drops a document all of whose lines were duplicates. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import scratch, vectext
from heronry.llm.groups import connected
from heronry.llm.hamming import segment_pairs
from heronry.llm.vectext import U, components, expand, starts_of

RADIUS, SIMILARITY, MIN_WORDS = 20, 0.8, 1
#: n-grams that are a line's keys; (bytes of an n-gram, for lines from so many bytes on, up to, bits of the first and second SimHash)
_PIECE = 1 << 18  # small enough for a processor's cache
KEYS, GRAMS = 6, ((8, 0, 64, 20, 17), (14, 64, 1 << 62, 16, 14))
_TOGETHER, _TABLE = 2048, 1 << 25  # pairs measured at once, and bytes of their tables
_MET = 1 << 18  # lines that a task remembers
_PRINT = np.dtype([("key", "<u8"), ("lh", "<u8"), ("sh", "<u8"), ("sh5", "<u8"), ("size", "<u2")])
_ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_JOIN_WORDS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def levenshtein_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance of a and b is at most limit (bit-parallel, after common ends are cut)."""
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b:
        return True
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < top - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if len(a) < len(b):  # a step for each character of the shorter one
        a, b = b, a
    m, n = len(a), len(b)
    if not n or m <= limit:
        return m <= limit
    where: dict[str, int] = {}
    bit = 1
    for ch in a:
        where[ch] = where.get(ch, 0) | bit
        bit <<= 1
    full, last, get = bit - 1, bit >> 1, where.get
    # left: the limit less the distance so far, were each character to come to take one off it; d0 and down may have a bit beyond full
    up, down, left = full, 0, limit + n - m
    for ch in b:
        x = get(ch, 0) | down
        d0 = (((x & up) + up) ^ up) | x
        hp = down | (full ^ (d0 | up))
        hn = up & d0
        if hp & last:
            left -= 2
            if left < 0:
                return False
        elif not hn & last:
            left -= 1
            if left < 0:
                return False
        hp = hp << 1 | 1
        down = hp & d0
        up = (hn << 1 | ~(d0 | hp)) & full
    return True


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:  # a[:lo] is common, a[:hi] isn't
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def distance_at_most(a: str, b: str) -> int:
    """An upper bound of the edit distance: the cost of one alignment, along substrings that both have."""
    todo, cost = [(a, b)], 0
    while todo:
        a, b = todo.pop()
        lo = _common(a, b)
        a, b = a[lo:], b[lo:]
        end = _common(a[::-1], b[::-1])
        a, b = a[: len(a) - end], b[: len(b) - end]
        m, n = len(a), len(b)
        for at in (m // 2, m // 4, 3 * m // 4) if min(m, n) >= 16 else ():
            to = b.find(a[at : at + 12], max(0, at - abs(m - n) - 32), at + abs(m - n) + 44)
            if to >= 0:
                todo += [(a[:at], b[:to]), (a[at:], b[to:])]
                break
        else:
            cost += max(m, n)
    return cost


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    limit = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    return distance_at_most(a, b) <= limit or levenshtein_within(a, b, limit)


def _measured(a: list[str], b: list[str], limits: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its limit. Bit-parallel as levenshtein_within is, 64 characters of
    a to a block, for all pairs at once and only in blocks that so few edits can reach; at step t block w is at character
    t - w of b, so the blocks of a step don't wait for one another. No b is longer than its a, or shorter by more than the
    limit, and a limit is 1 at least. Both get the same beginning, which leaves their distance alone, so that all a are of one length."""
    n, sizes, sizes_b = len(a), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    m, band = int(sizes.max()), int(limits.max())
    codes, codes_b = (np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    seen = np.zeros(int(max(codes.max(), codes_b.max())) + 1, bool)
    seen[codes] = True
    number = np.where(seen, np.cumsum(seen), 0)  # 0 is in no a
    kinds = int(seen.sum()) + 2
    own = np.arange(n)[:, None] * kinds
    before = m - sizes
    to = before + sizes_b
    most = int(to.max())

    def placed(numbers: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((n, width), np.int64)
        out[np.arange(width) < before[:, None]] = kinds - 1
        out.ravel()[expand(np.arange(n) * width + before, lengths)] = numbers
        out += own
        return np.ascontiguousarray(out.T)

    blocks = (m + 63) // 64
    where = np.zeros((blocks, n * kinds), np.uint64)
    for i, chars in enumerate(placed(number[codes], sizes, m)):
        where[i >> 6][chars] |= U(1 << (i & 63))
    where, base = where.ravel(), np.arange(blocks)[:, None] * (n * kinds)
    chars = np.ascontiguousarray(placed(number[codes_b], sizes_b, most)[::-1])
    up, down = np.full((blocks, n), ~U(0)), np.zeros((blocks, n), np.uint64)
    # row w + 1: whether the last row of block w went up or down; above the first one it goes up
    both = np.zeros((2, blocks + 1, n), np.uint64)
    plus, minus = both
    plus[0] = 1
    work, index = np.zeros((5, blocks, n), np.uint64), np.zeros((blocks, n), np.int64)
    top, end, last, held = np.array(63, np.uint64), np.array((m - 1) & 63, np.uint64), min(blocks - 1, band // 64), -1
    score, who, ok, low = np.full(n, min(m, 64 * last + 64)), np.arange(n), np.zeros(n, bool), int(to.min())
    for t in range(1, most + blocks):
        lo, hi = max(0, -((band + 64 - t) // 65), t - most), min(blocks - 1, (t + band - 1) // 65, t - 1)
        if hi > last:
            score += (minus[hi] - plus[hi]).view(np.int64) + (min(m, 64 * hi + 64) - 64 * hi)
            last = hi
        if lo and lo == held:  # the block above has ended
            plus[lo], minus[lo] = 1, 0
        held = lo
        u, d = up[lo : hi + 1], down[lo : hi + 1]
        room = work[:, : hi + 1 - lo]
        xh, eq, hp, hn, xv = room
        shifted, rows = room[:2], room[2:4]
        at = index[: hi + 1 - lo]
        np.add(chars[most - t + lo : most - t + hi + 1], base[lo : hi + 1], out=at)
        where.take(at, out=eq, mode="clip")
        np.bitwise_or(eq, d, out=xv)
        np.bitwise_or(eq, minus[lo : hi + 1], out=eq)
        np.bitwise_and(eq, u, out=xh)
        np.add(xh, u, out=xh)
        np.bitwise_xor(xh, u, out=xh)
        np.bitwise_or(xh, eq, out=xh)
        np.bitwise_or(xh, u, out=hp)
        np.invert(hp, out=hp)
        np.bitwise_or(hp, d, out=hp)
        np.bitwise_and(u, xh, out=hn)
        if hi == last == blocks - 1:
            score += (hp[-1] >> end & U(1)).view(np.int64)
            score -= (hn[-1] >> end & U(1)).view(np.int64)
            if t - last >= low:
                done = to == t - last
                ok[who[done]] = score[done] <= limits[done]
        np.add(rows, rows, out=shifted)
        np.bitwise_or(shifted, both[:, lo : hi + 1], out=shifted)
        np.right_shift(rows, top, out=both[:, lo + 1 : hi + 2])
        np.bitwise_or(xv, xh, out=u)
        np.invert(u, out=u)
        np.bitwise_or(u, eq, out=u)
        np.bitwise_and(xh, xv, out=d)
        if hi == last < blocks - 1:
            score += plus[hi + 1].view(np.int64)
            score -= minus[hi + 1].view(np.int64)
        if t % 32 or hi < last or t - last >= low:
            continue
        # every alignment passes one of the step's places, or one beside them; those of a block are below its last row's by the rows that go up
        lower, known = score + 1, score
        for w in range(hi, lo - 1, -1):
            ups, downs = up[w], down[w]
            if w == blocks - 1:
                inside = U((2 << ((m - 1) & 63)) - 1)
                ups, downs = ups & inside, downs & inside
            ups, downs = np.bitwise_count(ups).astype(np.int64), np.bitwise_count(downs)
            np.minimum(lower, known - ups, out=lower)
            known = known - ups + downs + plus[w].view(np.int64) - minus[w].view(np.int64)
        open_ = lower - 1 <= limits
        n = int(np.count_nonzero(open_))
        if not n:
            break
        if n < 0.9 * len(open_):
            score, who, to, limits = score[open_], who[open_], to[open_], limits[open_]
            up, down, chars, both = up[:, open_], down[:, open_], chars[:, open_], np.ascontiguousarray(both[:, :, open_])
            plus, minus = both
            work, index, low = np.zeros((5, blocks, n), np.uint64), np.zeros((blocks, n), np.int64), int(to.min())
    return ok


def all_similar(one: list[str], two: list[str], similarity: float = SIMILARITY, likely: bool = True) -> np.ndarray:
    """similar() of each pair; likely tells whether most pairs are, which decides what is tried first."""
    ok, todo = np.zeros(len(one), bool), []
    for k, (a, b) in enumerate(zip(one, two)):
        limit = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
        if abs(len(a) - len(b)) > limit:
            continue
        if likely and distance_at_most(a, b) <= limit:
            ok[k] = True
            continue
        lo = _common(a, b)
        a, b = a[lo:], b[lo:]
        end = _common(a[::-1], b[::-1])
        a, b = a[: len(a) - end], b[: len(b) - end]
        if max(len(a), len(b)) <= limit:
            ok[k] = True
        elif a and b and limit:
            todo.append((k, limit, a, b) if len(a) >= len(b) else (k, limit, b, a))
    todo.sort(key=lambda x: len(x[2]))
    while todo:
        # the longest, and what isn't much shorter, or somewhat if these are few; a few pairs, or pairs of so many characters that tables are large, one by one
        m = len(todo[-1][2])
        blocks = min(m, 2 * max(x[1] for x in todo[-_TOGETHER:])) // 64 + 2
        some = [x for k, x in enumerate(todo[-_TOGETHER:][::-1]) if len(x[2]) * (5 if k * blocks >= _TOGETHER else 10) >= m * 4 - 64][::-1]
        kinds = len(set().union(*(x[2] for x in some))) + 2
        some = some[-max(1, _TABLE // (m * (kinds // 8 + 16))) :]
        del todo[-len(some) :]
        if len(some) < 16:
            for k, limit, a, b in some:
                ok[k] = levenshtein_within(a, b, limit)
        else:
            ks, limits, a, b = zip(*some)
            ok[list(ks)] = _measured(a, b, np.array(limits))
    return ok


def normalise(line: bytes) -> str:
    """line in lower case already."""
    return b" ".join(line.translate(_JOIN_WORDS).split()).decode("utf-8", "replace")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text")


def _whole(p: vectext.Piece, line: np.ndarray, n_lines: int, seed: int = 21) -> np.ndarray:
    """A hash of the words of each line; line tells the line of each word."""
    out = np.zeros(n_lines, np.uint64)
    if len(line):
        heads = starts_of(line)
        place = np.arange(len(line)) - np.repeat(heads, np.diff(np.append(heads, len(line))))
        # of each word and its place a scrambled value, so that no arithmetic of one word undoes another's
        out[line[heads]] = vectext.mix(np.add.reduceat(vectext.mix(p.hash ^ vectext.mix(place.astype(np.uint64), seed + 2), seed), heads))
    return out


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, sig, line_no, lh, check) of every line: two hashes of the normalised line; null if it is too short."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            doc, sig = batch.column(0), batch.column(1)
            present = np.asarray(texts.is_valid())
            for p in vectext.pieces(texts):
                breaks = np.flatnonzero(p.data == 10)
                at = np.sort(np.concatenate([p.row_starts[:-1], breaks + 1]), kind="stable")
                # a break that ends a row makes a last, empty line of that row, before the next row's first
                row = np.sort(np.concatenate([np.arange(p.n_rows), np.searchsorted(p.row_starts, breaks, "right") - 1]), kind="stable")
                first = np.searchsorted(row, np.arange(p.n_rows))
                number = np.arange(len(row)) - first[row]
                line = first[p.row] + np.searchsorted(breaks, p.start) - np.searchsorted(breaks, p.row_starts)[p.row]
                n_words = np.bincount(line, minlength=len(row))
                hashes = _whole(p, line, len(row)), _whole(p, line, len(row), 61)
                short = n_words < min_words
                keep = present[p.first : p.first + p.n_rows][row]
                take = pa.array((row + p.first)[keep])
                yield pa.RecordBatch.from_arrays(
                    [doc.take(take), sig.take(take), pa.array(number[keep].astype(np.int32)), *(pa.array(x.view(np.int64)[keep], mask=short[keep]) for x in hashes)], ["doc_id", "sig", "line_no", "lh", "check"]
                )

    return _identified(docs).mapInArrow(run, "doc_id long, sig long, line_no int, lh long, check long")


def keys(p: vectext.Piece, line: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, ...]:
    """(key, line) of the lines of p, then (line, characters, SimHash of 5-grams) of each; line tells the line of
    each word. A key's last bit tells which of GRAMS it is."""
    size = p.end - p.start
    at = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), 32, np.uint8)
    text[expand(at, size)] = p.data[expand(p.start, size)]
    chars = np.append(0, np.cumsum(text & 0xC0 != 0x80))
    heads = starts_of(line)
    begin, end = at[heads], np.append(at[heads[1:]], len(text))[: len(heads)] - 1
    length, found = end - begin, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    # eight bytes from each place on, as numbers
    wide = np.ndarray(len(text) + 8, np.dtype("<u8"), np.append(text, np.zeros(16, np.uint8)), strides=(1,))

    def hashes(start: np.ndarray | slice, n: int) -> np.ndarray:
        if n <= 8:
            return vectext.mix((wide[start] & U((1 << 8 * n) - 1)) * _ODD[0], n)
        rest = slice(start.start + n - 8, start.stop + n - 8) if isinstance(start, slice) else start + (n - 8)
        return vectext.mix(wide[start] * _ODD[0] + wide[rest] * _ODD[1], n)

    def runs(some: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n-grams of some lines, one after another."""
        if 2 * int(length[some].sum()) < len(text) or not len(text):
            return hashes(expand(begin[some], length[some] - n + 1), n)
        edge = np.zeros(len(text) + 1, np.int8)
        edge[begin[some]] += 1
        edge[end[some] - n + 1] -= 1
        return hashes(slice(0, len(text)), n)[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]

    for kind, (n, least, most, *_) in enumerate(GRAMS):
        some = np.flatnonzero((length >= n) & (length / similarity >= least) & (length * similarity < most))
        if not len(some):
            continue
        grams = length[some] - n + 1
        h = runs(some, n)
        # of a long line only the lowest hashes, about 4 * KEYS, have to be ordered
        low = (np.minimum(1.0, 4.0 * KEYS / grams) * (2.0**63)).astype(np.uint64)
        use = np.flatnonzero(h >> U(1) <= np.repeat(low, grams))
        h, who = h[use], np.repeat(line[heads[some]], grams)[use]
        nth = np.repeat(np.arange(len(some), dtype=np.uint64), grams)[use]
        order = np.argsort(nth << U(44) | h >> U(20))  # hashes of a line that are equal so far may stand in any order
        h, who = h[order], who[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
        h, who = h[new], who[new]
        firsts = starts_of(who)
        rank = np.arange(len(who)) - np.repeat(firsts, np.diff(np.append(firsts, len(who))))
        found.append((h[rank < KEYS] & ~U(1) | U(kind), who[rank < KEYS]))
    some = np.flatnonzero(length >= 5)
    five = runs(some, 5)
    print_ = np.zeros(len(heads), np.uint64)
    print_[some] = vectext.simhash(five, np.repeat(np.arange(len(some)), length[some] - 4), len(some))
    return *(np.concatenate(x) for x in zip(*found)), line[heads], chars[end] - chars[begin], print_


def _close(records: np.ndarray, radius: int, similarity: float):
    """Index pairs i < j, in pieces, of records, ordered by key, that share a key and are close."""
    sh, sh5, size, kind = records["sh"], records["sh5"], records["size"].astype(np.int64), (records["key"] & U(1)).astype(np.int64)
    most = np.array([(min(radius, g[3]), g[4]) for g in GRAMS])

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.bitwise_count(sh5[i] ^ sh5[j]) <= most[kind[i], 1]
        i, j = i[ok], j[ok]
        long = np.maximum(size[i], size[j])
        ok = (np.bitwise_count(sh[i] ^ sh[j]) <= most[kind[i], 0]) & ((np.abs(size[i] - size[j]) <= long * (1 - similarity) + 1e-9) | (long == 65535))
        return i[ok], j[ok]

    heads = starts_of(records["key"])
    lengths = np.diff(np.append(heads, len(records)))
    for i, j in segment_pairs(heads, lengths):
        if i is not None:
            yield near(i, j)
            continue
        lo, n = int(heads[j]), int(lengths[j])
        step = max(1, (1 << 21) // n)
        for at in range(lo, lo + n, step):
            x, y = np.nonzero(np.bitwise_count(sh5[at : min(at + step, lo + n), None] ^ sh5[None, at : lo + n]) <= most[kind[at], 1])
            ahead = x < y
            yield near(x[ahead] + at, y[ahead] + at)


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The edges i - j of the minimum spanning forest of n nodes; ranks are distinct weights."""
    label, chosen, left = np.arange(n), [np.zeros(0, np.int64)], np.arange(len(i))
    while True:
        x, y = label[i[left]], label[j[left]]
        left = left[x != y]
        if not len(left):
            return np.concatenate(chosen)
        x, y = label[i[left]], label[j[left]]
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, x, rank[left])
        np.minimum.at(best, y, rank[left])
        take = left[(best[x] == rank[left]) | (best[y] == rank[left])]
        chosen.append(take)
        label = components(n, label[i[take]], label[j[take]])[label]


def candidates(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """Of each key with close lines: its members (key, lh, sh, sh5, size) and, with key null, pairs (lh, mate), lh < mate,
    a minimum spanning forest of the close ones by SimHash distance."""

    def sent(batches):
        met: set[int] = set()  # lines whose records went already
        for batch in batches:
            for p in vectext.pieces(batch.column(0), _PIECE):
                breaks = np.flatnonzero(p.data == 10)
                line = p.row + np.searchsorted(breaks, p.start)  # ascends by rows and by breaks
                if not len(line):
                    continue
                n_lines = p.n_rows + len(breaks)
                whole = _whole(p, line, n_lines)
                new = np.zeros(n_lines, bool)
                for k, lh in zip(starts_of(line).tolist(), whole[line[starts_of(line)]].tolist()):
                    if lh not in met:
                        met.add(lh)
                        new[line[k]] = True
                if len(met) > _MET:
                    met.clear()
                fresh = new[line]
                if not fresh.any():
                    continue
                if not fresh.all():
                    p, line = replace(p, row=p.row[fresh], start=p.start[fresh], end=p.end[fresh], hash=p.hash[fresh]), line[fresh]
                h, who, lines_, chars, fives = keys(p, line, similarity)
                use = np.bincount(line, minlength=n_lines)[line] >= min_words
                print_ = vectext.simhash(vectext.mix(p.hash[use], 22), line[use], n_lines)
                there = np.zeros(n_lines, bool)
                there[line[use]] = True
                h, who = h[there[who]], who[there[who]]
                out = np.zeros(len(h), _PRINT)
                own = np.searchsorted(lines_, who)
                out["key"], out["lh"], out["size"] = h, whole[who], np.minimum(chars[own], 65535)
                out["sh"], out["sh5"] = print_[who], fives[own]
                yield out

    def emit(batches):
        held, size = [], 0
        for out in sent(batches):
            held.append(out)
            size += len(out)
            if size > 1 << 18:
                out = _distinct(np.concatenate(held))
                yield vectext.mix(out["key"], 5), out
                held, size = [], 0
        if held:
            out = _distinct(np.concatenate(held))
            yield vectext.mix(out["key"], 5), out

    def reduce(records):
        records = _distinct(records)
        records = records[np.argsort(records["key"])]
        a, b = records["lh"], np.zeros(0, np.int64)
        i = j = b
        member = np.zeros(len(records), bool)
        for x, y in _close(records, radius, similarity):
            member[x] = member[y] = True
            i, j = np.concatenate([i, x]), np.concatenate([j, y])
            weight = np.bitwise_count(records["sh"][i] ^ records["sh"][j]).astype(np.int64) + np.bitwise_count(records["sh5"][i] ^ records["sh5"][j])
            rank = np.empty(len(i), np.int64)
            rank[np.lexsort((np.maximum(a[i], a[j]), np.minimum(a[i], a[j]), weight))] = np.arange(len(i))
            keep = spanning_forest(len(records), i, j, rank)
            i, j = i[keep], j[keep]
        told = records[member]
        one, two = np.unique(np.stack([np.minimum(a[i], a[j]), np.maximum(a[i], a[j])]), axis=1)
        none = pa.nulls(len(one), pa.int64())
        names = ["key", "lh", "sh", "sh5", "size", "mate"]
        yield pa.RecordBatch.from_arrays([*(pa.array(told[x].view(np.int64)) for x in names[:4]), pa.array(told["size"].astype(np.int64)), pa.nulls(len(told), pa.int64())], names)
        yield pa.RecordBatch.from_arrays([none, pa.array(one.view(np.int64)), none, none, none, pa.array(two.view(np.int64))], names)

    return scratch.shuffle(docs.select("text"), emit, _PRINT, reduce, "key long, lh long, sh long, sh5 long, size long, mate long")


def _distinct(records: np.ndarray) -> np.ndarray:
    """One record of each key and line, in any order."""
    both = vectext.mix(records["key"] ^ vectext.mix(records["lh"], 51), 52)
    by = np.argsort(both)  # records of one key and line are equal, so any of them will do
    return records[by[starts_of(both[by])]]


def _still_apart(members: DataFrame, groups: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Close pairs (lh, mate) of lines that share a key and are in different groups."""
    known = members.join(groups.select(F.col("node").alias("k"), "root"), F.col("lh") == F.col("k"), "left").select("key", "lh", "sh", "sh5", "size", F.coalesce("root", "lh").alias("root"))
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
    n = scratch.n_parts(members.sparkSession)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        records = np.zeros(t.num_rows, _PRINT)
        for k, name in enumerate(("key", "lh", "sh", "sh5", "size")):
            records[name] = t.column(k).to_numpy().view(np.uint64)
        root = t.column(5).to_numpy()
        by = np.lexsort((records["lh"], records["key"]))
        records, root = records[by], root[by]
        for i, j in _close(records, radius, similarity):
            apart = root[i] != root[j]
            x, y = records["lh"][i[apart]].view(np.int64), records["lh"][j[apart]].view(np.int64)
            a, b = records["lh"][i[apart]], records["lh"][j[apart]]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, x, y)), pa.array(np.where(a < b, y, x))], ["lh", "mate"])

    met = known.join(mixed, F.col("key") == F.col("k"), "left_semi").repartition(n, "key")
    return met.mapInArrow(run, "lh long, mate long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, likely: bool = True) -> DataFrame:
    """Edges (a, b) of the pairs (lh, mate) that are similar."""

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in chain(batches, [None]):
            if held and (batch is None or rows >= 8 * _TOGETHER or size >= _TABLE):
                t = pa.Table.from_batches(held).combine_chunks()
                ok = pa.array(all_similar(t.column(2).to_pylist(), t.column(3).to_pylist(), similarity, likely))
                yield from t.select([0, 1]).filter(ok).rename_columns(["a", "b"]).to_batches()
                held, rows, size = [], 0, 0
            if batch is not None and batch.num_rows:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes

    left, right = texts.select(F.col("lh").alias("k1"), F.col("line").alias("one")), texts.select(F.col("lh").alias("k2"), F.col("line").alias("two"))
    # by the second line first: a line that is the first of many pairs then carries its text last
    both = pairs.join(right, F.col("mate") == F.col("k2")).join(left, F.col("lh") == F.col("k1"))
    # pairs of about one length meet, in more tasks where there are more partitions
    n = scratch.n_parts(pairs.sparkSession)
    length = F.floor(3 * F.log2(F.greatest(F.length("one"), F.length("two")) + 1))
    met = both.select("lh", "mate", "one", "two").repartition(n, length, F.pmod(F.xxhash64("lh", "mate"), F.lit(max(1, n // 8))))
    return met.mapInArrow(run, "a long, b long")


def decisions(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, sig, line_no, kept, leader_doc_id, leader_line_no) of every line."""
    every = scratch.table(lines(docs, min_words))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "sig")
    kinds = scratch.table(every.where("lh is not null").groupBy("lh", "check").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    told = scratch.table(candidates(docs, radius, similarity, min_words))
    pairs = scratch.table(told.where("key is null").select("lh", "mate").distinct())
    members = told.where("key is not null")
    asked = members.select(F.col("lh").alias("k")).distinct()
    places = kinds.join(asked, F.col("lh") == F.col("k"), "left_semi").groupBy("lh").agg(F.min("first").alias("first"))
    wanted = places.groupBy(F.col("first.doc_id").alias("want_id"), F.col("first.sig").alias("want_sig")).agg(F.collect_list(F.struct("first.line_no", "lh")).alias("wanted"))
    held = _identified(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("sig") == F.col("want_sig"))).select("text", "wanted")

    def fetch(batches):
        for batch in batches:
            low = vectext.lowered(batch.column(0))
            out: list[list] = [[], []]
            for text, wanted_ in zip(low, batch.column(1)):
                parts = text.as_buffer().to_pybytes().split(b"\n")
                for w in wanted_.as_py():
                    out[0].append(w["lh"])
                    out[1].append(normalise(parts[w["line_no"]]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["lh", "line"])

    # rows that repeat a document bring its lines again
    texts = scratch.table(held.mapInArrow(fetch, "lh long, line string").groupBy("lh").agg(F.any_value("line").alias("line")))
    linked = scratch.table(_verified(pairs, texts, similarity))
    more = _still_apart(members, connected(linked), radius, similarity).join(pairs, ["lh", "mate"], "left_anti")
    teams = scratch.table(connected(linked.unionByName(_verified(more, texts, similarity, False))).select(F.col("node").alias("lh2"), F.col("root").alias("team")))
    led = kinds.join(teams, F.col("lh") == F.col("lh2")).groupBy("team").agg(F.min("first").alias("lead"))
    teams = teams.join(led, "team").select("lh2", "lead")
    leaders = kinds.join(teams, F.col("lh") == F.col("lh2"), "left").select(F.col("lh").alias("k1"), F.col("check").alias("k2"), F.coalesce("lead", "first").alias("lead"), "n", F.col("lh2").isNotNull().alias("in_team"))
    leaders = leaders.where("n > 1 or in_team").drop("n", "in_team")  # any other line leads itself
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "sig")
    joined = every.join(leaders, (F.col("lh") == F.col("k1")) & (F.col("check") == F.col("k2")), "left").withColumn("lead", F.coalesce("lead", own))
    same = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("line_no") == F.col("lead.line_no")) & (F.col("sig") == F.col("lead.sig"))
    return joined.select("doc_id", "sig", "line_no", same.alias("kept"), F.col("lead.doc_id").alias("leader_doc_id"), F.col("lead.line_no").alias("leader_line_no"))


def line_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, line_no, kept, leader_doc_id, leader_line_no): the result of the query."""
    return decisions(docs, **parameters).drop("sig")


def clean(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the lines that repeat; all columns as they were but text and, if there, n_chars."""
    gone = decisions(docs, **parameters).where("not kept").groupBy(F.col("doc_id").alias("_id"), F.col("sig").alias("_sig")).agg(F.collect_set("line_no").alias("gone"))
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("k"), F.xxhash64("row.text").alias("s"))
    joined = keyed.join(gone, keyed.k.eqNullSafe(gone._id) & (keyed.s == gone._sig), "left")
    left = F.filter(F.split("row.text", "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    cut = joined.select("row", F.col("gone").isNotNull().alias("changed"), F.when(F.col("gone").isNotNull(), left).alias("left"))
    cut = cut.where("not changed or size(left) > 0")
    text = F.when(F.col("changed"), F.array_join("left", "\n")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("changed"), F.length(text)).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None)}
    return cut.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
