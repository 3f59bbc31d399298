"""SimHash near-dedup with BK-trees.

Fingerprint: two independent 64-bit SimHashes of the set of a document's words of four bytes or more
(of all words, if none is so long; of the text itself, if it has no word). Words count once: counted as
often as they occur, the few commonest ones would make long documents of a language look alike.
Two documents are near copies iff both fingerprints together differ in at most BOTH bits (RADIUS, the
limit of the first alone, is no further limit). Groups are the connected groups of that relation; the document with the
smallest doc_id of a group stays.

Search. Near copies differ in at most BOTH // 2 bits of one of the fingerprints, so both are searched at that
radius. There a BK-tree over whole fingerprints follows nearly every edge. So the 64 bits of each are cut into BLOCKS shards, and one
BK-tree a shard holds the values that occur in it (children keyed by integer distance to the parent).
By the pigeonhole principle near copies agree in some shard up to BOTH // 2 // BLOCKS bits: every
fingerprint asks each shard's tree for the values within that radius, following only edges between
distance - radius and distance + radius, and meets their holders in a shuffle by (shard, value). Nothing
is missed. The trees are broadcast; a shard has at most 2 ** 11 values, whatever the number of documents. With six
shards of 64 bits the radius in a shard is 1, so a fingerprint asks for a dozen values at most and the shuffle grows
as the documents; five shards, at radius 2, ask for up to 92. What meets in one value is compared, so comparisons grow
as the square of the distinct fingerprints, at about 0.04 of all pairs; no exact search at 20 of 128 bits that grows
less is known to us. Values are 2 * 6 * 2 ** 11 at most, and so are tasks that can share this work.

Cases: null and blank texts have no fingerprint, are no copies and stay. A null doc_id is compared like
any other and comes last as a candidate to stay. Rows that repeat doc_id and text are one document and
one row of the result. Other columns are ignored by groups() and carried along by dedup(). An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry.llm import scratch, vectext
from heronry.llm.groups import connected
from heronry.llm.hamming import block_edges, block_values, star_edges
from heronry.llm.vectext import U, expand, starts_of

RADIUS, BOTH, BLOCKS, LONG_WORD = 20, 20, 6, 4
#: key: shard and value, and in the last bit whether the fingerprint asks or holds the value
_NODE = np.dtype([("key", "<u4"), ("h1", "<u8"), ("h2", "<u8")])


class BKTree:
    """A BK-tree over distinct integers under Hamming distance, in arrays: the children of node i are
    child[first[i] : first[i + 1]], ordered by edge, the distance to i. Built and searched level by level."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values).astype(np.uint64)
        n = len(self.values)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        at, rest = np.zeros(max(0, n - 1), np.int64), np.arange(1, n)
        while len(rest):
            d = np.bitwise_count(self.values[rest] ^ self.values[at]).astype(np.int64)
            order = np.lexsort((rest, d, at))
            rest, at, d = rest[order], at[order], d[order]
            heads = starts_of(at * 65 + d)
            parent[rest[heads]], edge[rest[heads]] = at[heads], d[heads]
            down = np.repeat(rest[heads], np.diff(np.append(heads, len(rest))))
            stays = np.ones(len(rest), bool)
            stays[heads] = False
            rest, at = rest[stays], down[stays]
        order = np.lexsort((edge, parent))
        self.child = order[1:] if n else order
        self.edge = edge
        self.first = np.searchsorted(parent[self.child], np.arange(n + 1))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, value) for all values within radius of each query."""
        queries = queries.astype(np.uint64)
        found_q, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        q, node = (np.arange(len(queries)), np.zeros(len(queries), np.int64)) if len(self.values) else (np.zeros(0, np.int64),) * 2
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_v.append(self.values[node[hit]])
            lengths = self.first[node + 1] - self.first[node]
            kids = self.child[expand(self.first[node], lengths)]
            q, d = np.repeat(q, lengths), np.repeat(d, lengths)
            follow = np.abs(self.edge[kids] - d) <= radius
            q, node = q[follow], kids[follow]
        return np.concatenate(found_q), np.concatenate(found_v)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, h1, h2) of every row; sig is a hash of the text. h1 and h2 are null without a word or sign."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            n = len(texts)
            h = np.zeros((2, n), np.uint64)
            none = np.ones(n, bool)
            for p in vectext.pieces(texts):
                rows = slice(p.first, p.first + p.n_rows)
                long = p.end - p.start >= LONG_WORD
                without = np.bincount(p.row[long], minlength=p.n_rows) == 0
                use = long | without[p.row]
                row, words = vectext.distinct(p.row[use], p.hash[use])
                for k in (0, 1):
                    h[k, rows] = vectext.simhash(vectext.mix(words, k + 1), row, p.n_rows)
                none[rows] = np.bincount(row, minlength=p.n_rows) == 0
            signs = np.flatnonzero(none & ~np.asarray(batch.column(3)))
            sig = batch.column(1).to_numpy().view(np.uint64)
            for k in (0, 1):
                h[k, signs] = vectext.mix(sig[signs], k + 7)
            none[signs] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x.view(np.int64), mask=none) for x in h)], ["doc_id", "sig", "h1", "h2"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text", F.coalesce(~F.col("text").rlike(r"\S"), F.lit(True)).alias("blank"))
    return cols.mapInArrow(run, "doc_id long, sig long, h1 long, h2 long")


def _node(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return vectext.mix(h1 ^ vectext.mix(h2, 3), 4).view(np.int64)


def near_edges(prints: DataFrame, radius: int = RADIUS, both: int = BOTH, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly what near-copy pairs of distinct (h1, h2) connect."""
    spark: SparkSession = prints.sparkSession
    reach, shapes = both // 2 // blocks, block_edges(blocks)
    if max(width for _, width in shapes) > 16:
        raise ValueError("too few blocks: a shard's tree would not stay small enough to broadcast")
    prints = prints.select("h1", "h2").where("h1 is not null")
    shard_values = prints.select(F.explode(F.array(*(F.shiftrightunsigned(h, shift).bitwiseAND((1 << width) - 1) + (k << 20) for k, (h, (shift, width)) in enumerate((h, x) for h in ("h1", "h2") for x in shapes)))).alias("v")).distinct()
    values = np.array([r.v for r in shard_values.collect()], np.int64)  # at most 2 * blocks * 2 ** 16, whatever the input
    trees = scratch.share(spark, [BKTree(values[values >> 20 == k] & 0xFFFFF) for k in range(2 * blocks)])

    def emit(batches):
        forest = scratch.shared(trees)
        for batch in batches:
            h1, h2 = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            for k, own in enumerate(block_values(h1, blocks) + block_values(h2, blocks)):
                distinct, inverse = np.unique(own, return_inverse=True)
                q, near = forest[k].within(distinct, reach)
                near = near.astype(np.int64)
                ahead = near > distinct[q]
                q, near = q[ahead], near[ahead]
                order = np.argsort(q, kind="stable")
                q, near = q[order], near[order]
                first = np.searchsorted(q, np.arange(len(distinct) + 1))
                lengths = (first[1:] - first[:-1])[inverse]
                who = np.concatenate([np.arange(len(h1)), np.repeat(np.arange(len(h1)), lengths)])
                out = np.zeros(len(who), _NODE)
                at = np.concatenate([own, near[expand(first[:-1][inverse], lengths)]]) | k << 20
                out["key"] = at << 1
                out["key"][len(h1) :] |= 1
                out["h1"], out["h2"] = h1[who], h2[who]
                yield vectext.mix(at.astype(np.uint64), 5), out

    def reduce(records):
        records = records[np.argsort(records["key"], kind="stable")]  # of a value, holders come first
        nodes, index = np.unique(_node(records["h1"], records["h2"]), return_inverse=True)
        heads = starts_of(records["key"] >> 1)
        ends = np.append(heads[1:], len(records))
        holders = np.add.reduceat(1 - (records["key"] & 1).astype(np.int64), heads)
        a, b, held = [], [], 0
        for at, to, n in zip(heads.tolist(), ends.tolist(), holders.tolist()):
            rows = max(1, (1 << 20) // max(1, to - at))
            for lo in range(at, at + n, rows):
                hi = min(lo + rows, at + n)
                d = np.bitwise_count(records["h1"][lo:hi, None] ^ records["h1"][None, at:to])
                i, j = np.nonzero(d <= min(radius, both))
                i, j = i + lo, j + at
                ok = (i < j) & (np.bitwise_count(records["h1"][i] ^ records["h1"][j]) + np.bitwise_count(records["h2"][i] ^ records["h2"][j]) <= both)
                a.append(index[i[ok]])
                b.append(index[j[ok]])
                held += int(ok.sum())
                if held > 1 << 22:
                    x, y = star_edges(len(nodes), a, b)
                    a, b, held = [x], [y], 0
        x, y = star_edges(len(nodes), a, b)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])

    # a few bytes a fingerprint, but much to search: as many tasks as partitions, however small they are
    spread = prints.repartition(scratch.n_parts(spark), "h1", "h2").distinct()
    return scratch.shuffle(spread, emit, _NODE, reduce, "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS, both: int = BOTH, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, sig, group_id, kept) of every distinct document; group_id is the doc_id that stays of its group."""
    prints = scratch.table(fingerprints(docs).distinct())
    roots = connected(near_edges(prints, radius, both, blocks))

    def name(batches):
        for batch in batches:
            h1, h2 = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_node(h1, h2), mask=batch.column(2).is_null().to_numpy(zero_copy_only=False))], [*batch.schema.names, "node"])

    named = prints.mapInArrow(name, "doc_id long, sig long, h1 long, h2 long, node long")
    owned = named.join(roots, "node", "left").select("doc_id", "sig", F.coalesce("root", "node", F.xxhash64("doc_id", "sig")).alias("root"), F.col("node").isNull().alias("alone"))
    w = W.partitionBy("root", "alone")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sig")).over(w)
    return owned.withColumn("first", first).select("doc_id", "sig", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("group_id"), (F.col("alone") | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sig") == F.col("first.sig")))).alias("kept"))


def near_duplicates(docs: DataFrame, **parameters: int) -> DataFrame:
    """(doc_id, group_id, kept): the result of the query."""
    return groups(docs, **parameters).select("doc_id", "group_id", "kept")


def dedup(docs: DataFrame, **parameters: int) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns; of rows that repeat doc_id and text, one."""
    kept = groups(docs, **parameters).where("kept").select(F.col("doc_id").alias("_id"), F.col("sig").alias("_sig"))
    row = docs.select(F.struct("*").alias("row"))
    keyed = row.select("row", F.col("row.doc_id").cast("long").alias("k"), F.xxhash64("row.text").alias("s"))
    stays = keyed.join(kept, keyed.k.eqNullSafe(kept._id) & (keyed.s == kept._sig), "left_semi")
    return stays.withColumn("copy", F.row_number().over(W.partitionBy("k", "s").orderBy("k"))).where("copy = 1").select("row.*")
