"""Document fingerprints: prefix polynomial hashes.

A text's words (see vectext) x0, x1, ... give the prefix array P[k] = x0 + x1 * B + ... + x(k-1) * B ** (k-1)
modulo two primes near 2 ** 31. The words i .. i + n of one text and j .. j + n of another are equal iff
(P[i + n] - P[i]) * B ** j = (Q[j + n] - Q[j]) * B ** i modulo both (a chance hit has odds of 2 ** -61),
so any span equality takes constant time and the longest common extension a binary search.

spans() fingerprints every document, names the first document with the same words (copy_of; besides the prefix
hash a sum of scrambled words has to be equal, 126 bits in all), and finds
all maximal spans of MIN_WORDS words or more that it shares with a benchmark text: where a window of
MIN_WORDS words has the hash of one in the benchmark and the words before it differ, the longest common
extension gives the span. The benchmark's arrays are broadcast while they take at most BROADCAST_WORDS
words, and by slices of that size beyond, a pass over the documents each.

Cases: null and empty texts have no words, are no copies (copy_of is null) and share nothing; texts and
items shorter than MIN_WORDS share nothing; an item without item_id is listed as null, first; a null doc_id is compared like any other and never named as
copy_of unless it is alone with those words; repeated rows give a row each; benchmark rows that repeat
count once; other columns are ignored; empty tables give an empty result or no spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import scratch, vectext
from heronry.llm.vectext import expand

MIN_WORDS, BROADCAST_WORDS = 13, 4_000_000
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525)
U = np.uint64


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        e = min(k, n - k)
        out[k : k + e] = out[:e] * U(pow(base, k, prime)) % U(prime)
        k += e
    return out


class Prefixes:
    """Prefix arrays of one sequence of word hashes under each prime."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.up, self.down, self.sums = [], [], []
        for prime, base in zip(PRIMES, BASES):
            up = _powers(base, prime, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(words % U(prime) * up[: self.n] % U(prime), out=sums[1:])  # below 2 ** 63 for 2 ** 32 words
            self.up.append(up)
            self.down.append(_powers(pow(base, -1, prime), prime, self.n + 1))
            self.sums.append(sums % U(prime))

    def span(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[k][end] + U(PRIMES[k]) - self.sums[k][start]) % U(PRIMES[k])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 62-bit hash of each span that does not depend on where it is."""
        one, two = (self.span(k, start, end) * self.down[k][start] % U(PRIMES[k]) for k in (0, 1))
        return one << U(31) | two


def spans_equal(a: Prefixes, i: np.ndarray, b: Prefixes, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a's n words from i on are b's from j on."""
    low = np.minimum(i, j)
    out = np.ones(len(i), bool)
    for k in (0, 1):
        p = U(PRIMES[k])
        longer = a if a.n >= b.n else b
        out &= a.span(k, i, i + n) * longer.up[k][j - low] % p == b.span(k, j, j + n) * longer.up[k][i - low] % p
    return out


def common_extension(a: Prefixes, i: np.ndarray, b: Prefixes, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of a from i and b from j, at most limit, by binary search."""
    lo, hi = np.zeros(len(i), np.int64), limit.astype(np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = spans_equal(a, i, b, j, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


class Benchmark:
    """The items one after another, and the hashes of their windows, sorted."""

    def __init__(self, items: list[tuple[int | None, str]], min_words: int) -> None:
        parts = [p for p in vectext.pieces(pa.array([t for _, t in items], pa.string()), 1 << 40)]
        words = parts[0].hash if parts else np.zeros(0, np.uint64)
        self.ids = [k for k, _ in items]
        self.words = words
        self.row = parts[0].row if parts else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.row, np.arange(len(items) + 1))
        self.prefixes = Prefixes(words)
        start = np.arange(max(0, len(words) - min_words + 1))
        start = start[self.row[start] == self.row[start + min_words - 1]] if len(start) else start
        hashes = self.prefixes.hashes(start, start + min_words)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.start = hashes[order], start[order]


def _shared(p: vectext.Piece, doc: Prefixes, first: np.ndarray, bench: Benchmark, min_words: int):
    """(row, start in the text, item, start in the item, words) of each maximal shared span."""
    n = len(p.hash)
    none = (np.zeros(0, np.int64),) * 5
    if n < min_words or not len(bench.hashes):
        return none
    start = np.arange(n - min_words + 1)
    start = start[p.row[start] == p.row[start + min_words - 1]]
    hashes = doc.hashes(start, start + min_words)
    lo = np.searchsorted(bench.hashes, hashes)
    hit = bench.hashes[np.minimum(lo, len(bench.hashes) - 1)] == hashes
    start, lo = start[hit], lo[hit]
    many = np.searchsorted(bench.hashes, hashes[hit], "right") - lo
    i, j = np.repeat(start, many), bench.start[expand(lo, many)]
    row, item = p.row[i], bench.row[j]
    inner = (i > first[row]) & (j > bench.first[item])
    begins = ~inner | (p.hash[i - 1] != bench.words[j - 1])
    i, j, row, item = i[begins], j[begins], row[begins], item[begins]
    limit = np.minimum(first[row + 1] - i, bench.first[item + 1] - j)
    length = common_extension(doc, i, bench.prefixes, j, limit)
    return row, i - first[row], item, j - bench.first[item], length


def spans(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, n_words, copy_of, n_spans, longest_span, spans) of every row; spans lists
    item:start in the text:start in the item:words, in that order, separated by spaces."""
    spark = docs.sparkSession
    slices: list[list] = []
    room = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("k"), "text").where("text is not null").distinct().orderBy("k", "text").toLocalIterator():
        size = len(r.text) // 2 + 1  # words at most
        if not slices or size > room:
            slices.append([])
            room = broadcast_words
        slices[-1].append((r.k, r.text))
        room -= size

    def passed(frame: DataFrame, items: list, last: bool) -> DataFrame:
        held = scratch.share(spark, Benchmark(items, min_words))

        def run(batches):
            bench = scratch.shared(held)
            for batch in batches:
                size = batch.num_rows
                n_words, print_, check, found = *np.zeros((3, size), np.int64), [[] for _ in range(size)]
                for p in vectext.pieces(batch.column(1)):
                    doc = Prefixes(p.hash)
                    first = np.searchsorted(p.row, np.arange(p.n_rows + 1))
                    rows = slice(p.first, p.first + p.n_rows)
                    n_words[rows] = np.diff(first)
                    print_[rows] = doc.hashes(first[:-1], first[1:]).view(np.int64)
                    sums = np.append(U(0), np.cumsum(vectext.mix(p.hash ^ vectext.mix((np.arange(len(p.hash)) - first[p.row]).astype(np.uint64), 41), 42)))
                    check[rows] = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
                    for row, i, item, j, n in zip(*(x.tolist() for x in _shared(p, doc, first, bench, min_words))):
                        found[row + p.first].append((bench.ids[item], i, j, n))
                new = [[{"item": a, "i": b, "j": c, "n": d} for a, b, c, d in x] for x in found]
                lists = [(old or []) + now for old, now in zip(batch.column(2).to_pylist(), new)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1) if not last else pa.nulls(size, pa.string()), pa.array(lists, _SPAN), *map(pa.array, (n_words, print_, check))], ["doc_id", "text", "found", "n_words", "print", "check"])

        return frame.mapInArrow(run, "doc_id long, text string, found array<struct<item:long,i:long,j:long,n:long>>, n_words long, print long, check long")

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr("cast(null as array<struct<item:long,i:long,j:long,n:long>>)").alias("found"))
    todo = slices or [[]]
    for k, items in enumerate(todo):
        frame = passed(frame.select("doc_id", "text", "found"), items, k == len(todo) - 1)
    found = scratch.table(frame.drop("text"))
    # of texts that repeat the first is found before the shuffle, and met by a join, so thousands of copies gather nowhere
    firsts = found.where("n_words > 0").groupBy(F.col("print").alias("p"), F.col("check").alias("q"), F.col("n_words").alias("size")).agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"))
    first = F.when(F.col("n_words") > 0, F.when(F.col("copies") > 1, F.col("copy_of")).otherwise(F.col("doc_id")))
    frame = found.join(firsts.where("copies > 1"), (F.col("print") == F.col("p")) & (F.col("check") == F.col("q")) & (F.col("n_words") == F.col("size")), "left")
    listed = F.array_join(F.transform(F.array_sort("found"), lambda s: F.concat_ws(":", F.coalesce(s["item"].cast("string"), F.lit("null")), s["i"].cast("string"), s["j"].cast("string"), s["n"].cast("string"))), " ")
    return frame.select("doc_id", "n_words", first.alias("copy_of"), F.size("found").cast("long").alias("n_spans"), F.coalesce(F.array_max(F.transform("found", lambda s: s["n"])), F.lit(0)).alias("longest_span"), listed.alias("spans"))


_SPAN = pa.list_(pa.struct([("item", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("n", pa.int64())]))

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id AS item, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dt AS (SELECT rid, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
bt AS (SELECT item, w, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM b),
hit AS (SELECT rid, item, w, i, j, i - row_number() OVER (PARTITION BY rid, item, w, i - j ORDER BY i) AS island FROM dt JOIN bt USING (word)),
run AS (SELECT rid, item, min(i) AS i, min(j) AS j, count(*) AS n FROM hit GROUP BY rid, item, w, i - j, island HAVING count(*) >= {MIN_WORDS}),
listed AS (SELECT rid, count(*) AS n_spans, max(n) AS longest, string_agg(coalesce(item::VARCHAR, 'null') || ':' || i || ':' || j || ':' || n, ' ' ORDER BY item NULLS FIRST, i, j, n) AS spans FROM run GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) END AS copy_of,
  coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(longest, 0)::BIGINT AS longest_span, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)
"""
