"""Cost-balanced packing.

A document of n tokens costs LINEAR * n + QUADRATIC * n * n (attention). Documents are assigned in
descending order of cost to the sequence of lowest cost that has room for them; a tie goes to the
lower sequence number, and a new sequence is opened if none has room. A document longer than a
sequence is cut into pieces of CAPACITY tokens and a last, shorter one; each piece is packed by itself.

Pieces are spread by a hash of doc_id, tokens, place and, among rows that repeat these, a number, over shards of about
SHARD_TOKENS tokens, and each shard is packed by itself, beginning with as many sequences as its tokens fill. A
shard is the unit of work: its size is fixed, so any number of documents, also without doc_id, needs no more
memory a task.

Tokens of a text: as in mixing. Null and empty texts have none and are in no sequence. A null doc_id
is packed as any other; repeated rows are packed each; ties go by doc_id, nulls last, then piece. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import scratch
from heronry.llm.mixing import n_tokens
from heronry.llm.vectext import starts_of

CAPACITY, LINEAR, QUADRATIC, SHARD_TOKENS, RUN = 4096, 4096, 1, 1 << 22, 1 << 16
_OUT = "doc_id long, piece long, n_tokens long, shard long, sequence long, sequence_tokens long, sequence_cost long"


def pack(lengths: list[int], capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC) -> list[int]:
    """Sequence of each length; lengths are positive, at most capacity and in the order of assignment."""
    n = -(-sum(lengths) // capacity)
    room, heap, out = [capacity] * n, [(0, k) for k in range(n)], []
    for length in lengths:
        passed = []
        while heap and room[heap[0][1]] < length:
            passed.append(heapq.heappop(heap))
        if heap:
            cost, k = heapq.heappop(heap)
        else:
            cost, k = 0, len(room)
            room.append(capacity)
        room[k] -= length
        if room[k]:
            heapq.heappush(heap, (cost + linear * length + quadratic * length * length, k))
        for x in passed:
            heapq.heappush(heap, x)
        out.append(k)
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, linear: int = LINEAR, quadratic: int = QUADRATIC, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, piece, n_tokens, shard, sequence, sequence_tokens, sequence_cost) of every piece."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_tokens(F.col("text")).alias("n")).where("n > 0")
    # rows that repeat are numbered, not gathered; the numbers are made in runs, so no array is long
    times = scratch.table(narrow.groupBy("doc_id", "n").agg(F.count("*").alias("times")))
    shards = max(1, -(-(times.agg(F.sum(F.col("n") * F.col("times"))).first()[0] or 0) // shard_tokens))
    runs = times.select("doc_id", "n", "times", F.explode(F.expr(f"sequence(0L, (times - 1) div {RUN})")).alias("run"))
    copies = runs.select("doc_id", "n", F.explode(F.expr(f"sequence(run * {RUN}, least(run * {RUN} + {RUN}, times) - 1)")).alias("copy"))
    pieces = copies.select("doc_id", "n", "copy", F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})")).alias("piece"))
    shard = F.pmod(F.xxhash64("doc_id", "n", "copy", "piece"), F.lit(shards))
    sized = pieces.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"), shard.alias("shard"))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        null = t.column(0).is_null().to_numpy(zero_copy_only=False)
        doc = t.column(0).fill_null(0).to_numpy()
        piece, n, shard = (t.column(k).to_numpy() for k in (1, 2, 3))
        cost = linear * n + quadratic * n * n
        order = np.lexsort((piece, doc, null, -cost, shard))
        doc, null, piece, n, shard, cost = (x[order] for x in (doc, null, piece, n, shard, cost))
        heads = starts_of(shard)
        for at, to in zip(heads.tolist(), np.append(heads[1:], len(shard)).tolist()):
            seq = np.array(pack(n[at:to].tolist(), capacity, linear, quadratic))
            tokens = np.zeros(seq.max() + 1, np.int64)
            costs = tokens.copy()
            np.add.at(tokens, seq, n[at:to])
            np.add.at(costs, seq, cost[at:to])
            yield pa.RecordBatch.from_arrays([pa.array(doc[at:to], mask=null[at:to]), *map(pa.array, (piece[at:to], n[at:to], shard[at:to], seq, tokens[seq], costs[seq]))], ["doc_id", "piece", "n_tokens", "shard", "sequence", "sequence_tokens", "sequence_cost"])

    n = scratch.n_parts(spark)
    return sized.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).mapInArrow(run, _OUT)
