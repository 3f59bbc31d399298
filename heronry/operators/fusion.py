"""Dense search, reciprocal rank fusion, and the trace of a hybrid search."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from heronry.functions import text as T
from heronry.operators.best import UNIT, Best, units
from heronry.operators.lexical import Index, top
from heronry.operators.lexical import search as bm25_search

RRF_K, DENSE_K, BM25_K, POOL, K = 60, 50, 50, 30, 8
#: vectors in a block
BLOCK = 2048
#: queries that are broadcast, at most; queries of a group, at most; numbers of the products that are measured at a time
FEW, GROUP, PRODUCTS = 4096, 32_768, 1 << 21


def _width(df: DataFrame) -> type:
    return np.float32 if df.schema["vector"].dataType.elementType == FloatType() else np.float64


def _blocks(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """(scope, ids, ords, vectors) of rows (scope, id, ord, vector): as many as size a row, vectors in bytes, as wide as they come."""
    width = _width(df)

    def pack(batches):
        for batch in batches:
            scope, ids, ords, vectors = batch.columns
            kinds = scope.dictionary_encode(null_encoding="encode")
            codes = kinds.indices.to_numpy(zero_copy_only=False)
            for code in range(len(kinds.dictionary)):
                every = np.flatnonzero(codes == code)
                for at in range(0, len(every), size):
                    take = pa.array(every[at : at + size])
                    flat = vectors.take(take).flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(width)
                    ends = pa.array([0, len(take)], pa.int32())
                    yield pa.RecordBatch.from_arrays([kinds.dictionary.slice(code, 1), pa.ListArray.from_arrays(ends, ids.take(take)), pa.ListArray.from_arrays(ends, ords.take(take)), pa.array([flat.tobytes()], pa.binary())], ["scope", "ids", "ords", "vectors"])

    kind = {c: df.schema[c].dataType.simpleString() for c in ("scope", "id", "ord")}
    return df.select("scope", "id", "ord", "vector").where("vector is not null").mapInArrow(pack, f"scope {kind['scope']}, ids array<{kind['id']}>, ords array<{kind['ord']}>, vectors binary")


def _normed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms in double precision, and single vectors of length 1; of length 0 where there is none."""
    norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
    unit = np.divide(v, norm[:, None], out=np.zeros(v.shape), where=norm[:, None] > 0)
    return norm, np.nan_to_num(unit, nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)


class _Nearest:
    """The k nearest records of queries given as blocks (scope, ids, vectors), while blocks of records go by. Products of
    single vectors leave out what can't be among the k best; what is left is measured in double precision."""

    def __init__(self, blocks: list[tuple], k: int) -> None:
        coded = pa.concat_arrays([ids for _, ids, _ in blocks]).dictionary_encode(null_encoding="encode")
        numbers, self.ids, self.k, self.sides = coded.indices.to_numpy().astype(np.int64), coded.dictionary, k, {}
        self.best, first = Best(len(self.ids), k), 0
        for scope, ids, v in blocks:
            self.sides.setdefault(scope, []).append((numbers[first : first + len(ids)], v, *_normed(v)))
            first += len(ids)

    def meet(self, scope, ids: pa.Array, ords: pa.Array, a: np.ndarray) -> None:
        if scope not in self.sides:
            return
        best, n, (a_norm, a_unit) = self.best, len(ids), _normed(a)
        slack = (a.shape[1] + 8) * 2.0**-22
        for numbers, v, v_norm, unit in self.sides[scope]:
            sims = unit @ a_unit.T
            floor = best.floor[numbers]
            bar = np.where(floor < -UNIT, -2.0, (floor - 0.5) / UNIT - slack).astype(np.float32)
            ok = sims >= bar[:, None]
            if n > self.k and np.count_nonzero(ok) > 4 * self.k * len(numbers):
                # k records of the block are this near; rounded scores differ from products by half a unit and the slack
                kth = np.partition(sims, n - self.k, axis=1)[:, n - self.k]
                ok = sims >= np.maximum(bar, kth - np.float32(2 * slack + 1.01 / UNIT))[:, None]
            cell = np.flatnonzero(ok)
            for at in range(0, len(cell), step := max(1, PRODUCTS // a.shape[1])):
                q, r = np.divmod(cell[at : at + step], n)
                norm = v_norm[q] * a_norm[r]
                score = units(np.divide(np.einsum("ij,ij->i", v[q], a[r], dtype=np.float64), norm, out=np.zeros_like(norm), where=norm > 0))
                keep = score >= best.floor[numbers[q]]
                best.offer(numbers[q[keep]], r[keep], score[keep], ids, ords)


def _array(batch: pa.RecordBatch, column: int, row: int, width: type, n: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), width).reshape(n, -1)


def dense(records: DataFrame, queries: DataFrame, k: int = DENSE_K, scoped: bool = False, few: int = FEW) -> DataFrame:
    """(query_id, id, score, rank): the exact k nearest of records (id, ord, embedding) to queries (query_id,
    vector) by cosine, to 4 decimals, ties by ord. With scoped, only records of the query's scope.

    Both sides are packed into blocks of vectors, which are multiplied as matrices; a task keeps the k best of each of its
    queries. A few queries (their number is checked) are broadcast to the records. More are cut into groups by a hash of query_id,
    of GROUP queries at most; records are sent to the tasks of each group, several where there are fewer groups than cores.
    Where one task has all records of a group, its k best are the result, in order."""
    scope = F.col("scope") if scoped else F.lit(0)
    r_rows = records.select(scope.alias("scope"), "id", (F.col("ord") if "ord" in records.columns else F.col("id")).alias("ord"), F.col("embedding").alias("vector"))
    q_rows = queries.select(scope.alias("scope"), F.col("query_id").alias("id"), F.col("query_id").alias("ord"), "vector")
    r_width, q_width = _width(r_rows), _width(q_rows)
    kind = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": r_rows.schema["id"].dataType.simpleString(), "ord": r_rows.schema["ord"].dataType.simpleString(), "score": "double", "rank": "long"}
    names, shape = list(kind), ", ".join(f"{c} {t}" for c, t in kind.items())

    def pairs(batches):
        held: dict[int, _Nearest] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ords, q_ids = (batch.column(c)[row].values for c in (0, 1, 4))
                if (key := batch.column(3)[row].as_py()) not in held:
                    held[key] = _Nearest([(0, q_ids, _array(batch, 5, row, q_width, len(q_ids)))], k)
                held[key].meet(0, ids, ords, _array(batch, 2, row, r_width, len(ids)))
        for near in held.values():
            yield from near.best.batches(near.ids, names)

    def groups(batches):
        blocks, near = [], None
        for batch in batches:
            for row in range(batch.num_rows):
                scope, q_ids, ids, ords = batch.column(1)[row].as_py(), *(batch.column(c)[row].values for c in (2, 3, 4))
                if not batch.column(0)[row].as_py():
                    blocks.append((scope, q_ids, _array(batch, 5, row, q_width, len(q_ids))))
                elif blocks:
                    near = near or _Nearest(blocks, k)
                    near.meet(scope, ids, ords, _array(batch, 5, row, r_width, len(ids)))
        if near is not None:
            yield from near.best.batches(near.ids, names)

    r = _blocks(r_rows)
    if (n := queries.count()) <= few:
        q = _blocks(q_rows).select(F.col("scope").alias("q_scope"), F.monotonically_increasing_id().alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
        met = r.join(F.broadcast(q), F.col("scope").eqNullSafe(F.col("q_scope"))) if scoped else r.crossJoin(F.broadcast(q))
        found, slices = met.select("ids", "ords", "vectors", "block", "q_ids", "q_vectors").mapInArrow(pairs, shape), 0
    else:
        tasks = 2 * records.sparkSession.sparkContext.defaultParallelism
        cut = -(-n // min(max(-(-n // tasks), GROUP // 4), GROUP))
        slices = -(-tasks // cut)
        group = lambda c: F.pmod(F.xxhash64(c), F.lit(cut)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = _blocks(q_rows.repartitionById(cut, group("id"))).withColumn("slice", each(slices)).withColumn("part", group(F.col("ids")[0]) * slices + F.col("slice"))
        q = q.select("part", F.lit(False).alias("record"), "scope", F.col("ids").alias("q_ids"), F.lit(None).cast(r.schema["ids"].dataType).alias("ids"), F.lit(None).cast(r.schema["ords"].dataType).alias("ords"), "vectors")
        r = r.withColumn("group", each(cut)).withColumn("part", F.col("group") * slices + F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
        r = r.select("part", F.lit(True).alias("record"), "scope", F.lit(None).cast(q.schema["q_ids"].dataType).alias("q_ids"), "ids", "ords", "vectors")
        met = q.unionByName(r).repartitionById(cut * slices, F.col("part")).sortWithinPartitions("record")
        found = met.select("record", "scope", "q_ids", "ids", "ords", "vectors").mapInArrow(groups, shape)
    if slices != 1:
        found = top(found.drop("rank"), k, F.desc("score"), F.col("ord"), F.col("id"))
    return found.select("query_id", "id", "score", "rank")


def hashed(records: DataFrame, dim: int = 128) -> DataFrame:
    """(id, embedding) of records (id, text): as functions.text.hashed_vector() by md5, but each distinct token of a batch is hashed once."""

    def spread(batches):
        for batch in batches:
            tokens = batch.column(1)
            n, coded = len(tokens), tokens.flatten().dictionary_encode()
            slots = np.array([int(md5(t.encode()).hexdigest()[:8], 16) % dim for t in coded.dictionary.to_pylist()], np.int64)
            sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((n, dim), np.float32)
            out[np.repeat(np.arange(n), sizes), slots[coded.indices.to_numpy()]] = 1
            out[sizes == 0] = 1e-6
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["id", "embedding"])

    return records.select("id", T.tokens(F.col("text"))).mapInArrow(spread, f"id {records.schema['id'].dataType.simpleString()}, embedding array<float>")


def rankings(**lists: DataFrame) -> DataFrame:
    """(query_id, retriever, id, score, rank) of any number of ranked lists (query_id, id, score, rank)."""
    out = None
    for name, df in lists.items():
        one = df.select("query_id", F.lit(name).alias("retriever"), "id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no rankings")
    return out


def rrf(ranked: DataFrame, names: list[str], k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf, a score and a rank for each retriever, rank): the sum of 1 / (k + rank + 1), to 5 decimals. Equal
    sums keep the order of first mention: the first retriever's ranking, then what only later ones found."""
    one = ranked.groupBy("query_id", "id").agg(
        F.round(F.sum(1 / (k + F.col("rank") + 1)), 5).alias("rrf"),
        *(F.max(F.when(F.col("retriever") == n, F.col("score"))).alias(n) for n in names),
        *(F.max(F.when(F.col("retriever") == n, F.col("rank"))).alias(f"{n}_rank") for n in names),
    )
    order = [F.desc("rrf"), *(F.asc_nulls_last(f"{n}_rank") for n in names), F.col("id")]
    place = (F.row_number().over(W.partitionBy("query_id").orderBy(*order)) - 1).cast("long")
    return one.withColumn("rank", place)


def gate(fused: DataFrame, k: int, mode: str) -> DataFrame:
    """(query_id, candidates, rerank): a query is reranked iff reranking is on and it has more than k candidates."""
    return fused.groupBy("query_id").agg(F.count("*").alias("candidates")).withColumn("rerank", (F.col("candidates") > k) & F.lit(mode != "off"))


_LONG = ["query_id", "stage", "rank", "id", "score", "dense", "bm25", "rrf", "rerank"]


def _stage(name: str, rank: Column, score: Column, when: Column, keep: tuple[str, ...]) -> Column:
    values = [(F.col(c) if c in keep else F.lit(None)).cast("double").alias(c) for c in _LONG[5:]]
    return F.when(when, F.struct(F.lit(name).alias("stage"), rank.cast("long").alias("rank"), "id", score.cast("double").alias("score"), *values))


def _stages(df: DataFrame, *stages: Column) -> DataFrame:
    listed = df.select("query_id", F.explode(F.filter(F.array(*stages), lambda s: s.isNotNull())).alias("s"))
    return listed.select("query_id", "s.*")


def trace(dense_hits: DataFrame, bm25_hits: DataFrame, k: int = K, mode: str = "off", pool: int = POOL, reranker=None, extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every stage of a hybrid search in long form: (query_id, stage, rank, id, score, dense, bm25, rrf, rerank).

    Each hit of a retriever is a row of the fusion, with its score and rank there, so all stages are unfolded from
    one table and each retriever runs once. reranker takes candidates (query_id, id, rrf, dense, bm25, rank) below
    the pool size and returns them with a new rank and a rerank score. Scores stay those of the fusion; the order
    is rank. A query is reranked iff it has more than k candidates. Further retrievers' hits come as extra, by name;
    each has its stage and its share in the fusion."""
    extra = extra or {}
    fused = rrf(rankings(dense=dense_hits, bm25=bm25_hits, **extra), ["dense", "bm25", *extra])
    reranking = mode != "off" and reranker is not None
    opened = (F.count("*").over(W.partitionBy("query_id")) > k) & F.lit(reranking)
    fused = fused.withColumn("opened", opened)
    rank, rrf_ = F.col("rank"), F.col("rrf")
    out = _stages(
        fused,
        _stage("dense", F.col("dense_rank"), F.col("dense"), F.col("dense_rank").isNotNull(), ("dense",)),
        _stage("bm25", F.col("bm25_rank"), F.col("bm25"), F.col("bm25_rank").isNotNull(), ("bm25",)),
        *(_stage(name, F.col(f"{name}_rank"), F.col(name), F.col(f"{name}_rank").isNotNull(), ()) for name in extra),
        _stage("fused", rank, rrf_, F.lit(True), ("dense", "bm25", "rrf")),
        _stage("final", rank, rrf_, (rank < k) & ~F.col("opened"), ("dense", "bm25", "rrf")),
    )
    if not reranking:
        return out
    reranked = reranker(fused.where("opened").where(rank < pool).select("query_id", "id", "rrf", "dense", "bm25", "rank"))
    every = ("dense", "bm25", "rrf", "rerank")
    return out.unionByName(_stages(reranked, _stage("reranked", rank, rrf_, F.lit(True), every), _stage("final", rank, rrf_, rank < k, every)))


def hybrid(records: DataFrame, index: Index, queries: DataFrame, k: int = K, dense_k: int = DENSE_K, bm25_k: int = BM25_K, scoped: bool = False, **how) -> DataFrame:
    """The trace of queries (query_id, query, vector) over records (id, ord, embedding) and their index."""
    return trace(dense(records, queries, dense_k, scoped), bm25_search(index, queries, bm25_k), k, **how)


def scores_map(hits: DataFrame) -> DataFrame:
    """hits with their stage scores as one map, without those a stage didn't give."""
    entries = F.map_from_arrays(F.array(*map(F.lit, _LONG[5:])), F.array(*map(F.col, _LONG[5:])))
    return hits.select(*_LONG[:5], F.map_filter(entries, lambda _, v: v.isNotNull()).alias("scores"))
