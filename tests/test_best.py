"""Searches that keep the k best in each task: the same rows as joins give, and nothing shuffled but these."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.operators import fusion, lexical
from heronry.operators.best import Best


def shuffles(df) -> list[str]:
    """What a plan that has not run yet shuffles by."""
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def corpus(spark, n=300):
    rng = random.Random(5)
    words = ["ice", "hill", "stone", "mer", "été", "a", "the", "of", "down", "x_1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(n)]
    texts += texts[:40] + [None]
    return spark.createDataFrame([(k, t, rng.choice(["a", "b", None])) for k, t in enumerate(texts)], "id long, text string, source string").repartition(5)


def test_best_keeps_the_order_of_score_ord_and_id(monkeypatch):
    from heronry.operators import best as module

    monkeypatch.setattr(module, "WAIT", 7)
    rng, held, want = random.Random(3), Best(4, 5), {}
    for _ in range(30):
        rows = [(rng.randrange(4), rng.randrange(6), rng.randrange(9), rng.randrange(1000)) for _ in range(rng.randrange(12))]
        for q, s, o, i in rows:
            want.setdefault(q, []).append((-s, o, i))
        q, s, o, i = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        held.offer(q, np.arange(len(q)), s, pa.array(i), pa.array(o))
    got = {}
    for batch in held.batches(pa.array(range(4)), ["query_id", "id", "ord", "score", "rank"], 3):
        for r in batch.to_pylist():
            assert r["rank"] == len(got.setdefault(r["query_id"], []))
            got[r["query_id"]].append((-round(r["score"] * 1e4), r["ord"], r["id"]))
    assert got == {q: sorted(rows)[:5] for q, rows in want.items()}


@pytest.mark.parametrize("scoped", [False, True])
def test_bm25_scores_where_documents_are_read(spark, scoped):
    docs = corpus(spark)
    asked = [(0, "a", "ice on the hill"), (1, "b", "ice ice été"), (2, "b", ""), (3, "none", "stone"), (4, "a", "x_1 of the mer"), (5, None, "ice")]
    queries = spark.createDataFrame(asked, "query_id long, scope string, query string")
    queries = queries if scoped else queries.drop("scope")
    index = lexical.build(docs, F.col("source")) if scoped else lexical.build(docs)
    found = lexical.search(index, queries, 20)
    # only the k best of each query and task: not postings, not pairs of query and document
    assert shuffles(found) == ["query_id"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found) == rows(lexical.search(index, queries, 20, broadcast_terms=0)) and found.count() >= 60


def test_bm25_in_small_pieces(spark, monkeypatch):
    index, queries = lexical.build(corpus(spark)), spark.createDataFrame([(0, "ice on the hill"), (1, "été of"), (2, "a a x_1")], "query_id long, query string")
    asked = lexical._measured(index.documents, lexical._collected(lexical.query_terms(queries), F.lit(0)))
    table = index.documents.toArrow().combine_chunks()
    names = ["query_id", "id", "ord", "score", "rank"]
    scan = lambda: pa.Table.from_batches(lexical._scan(table.to_batches(max_chunksize=70), asked, 9, 1.5, 0.75, names)).to_pylist()
    whole = scan()
    for tokens, cells in ((1, 1), (50, 7), (1 << 20, 20)):
        monkeypatch.setattr(lexical, "TOKENS", tokens)
        monkeypatch.setattr(lexical, "CELLS", cells)
        assert scan() == whole and len(whole) == 27


def test_hashed_vectors_are_those_of_the_expression(spark):
    docs = corpus(spark)
    want = {r.id: r.v for r in docs.select("id", T.hashed_vector(F.col("text"), hashed="md5").alias("v")).collect()}
    assert {r.id: r.embedding for r in fusion.hashed(docs).collect()} == want and len(want) == 341


@pytest.mark.parametrize("scoped", [False, True])
def test_dense_in_groups_of_queries(spark, scoped):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 6)).round(1)
    v[::7] = v[3]
    v[5] = 0
    rows = [(k, None if k % 5 == 4 else k % 5, x) for k, x in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, "id long, scope long, embedding array<float>").repartition(3)
    q = df.select(F.col("id").alias("query_id"), "scope", F.col("embedding").alias("vector"))
    a = v.astype(np.float32).astype(np.float64)
    norm = np.sqrt((a * a).sum(axis=1))
    sims = np.floor(np.divide(a @ a.T, np.outer(norm, norm), out=np.zeros((700, 700)), where=np.outer(norm, norm) > 0) * 1e4 + 0.5) / 1e4
    for few in (0, 4096):
        found = fusion.dense(df, q, 12, scoped, few=few)
        assert [c for c in shuffles(found) if c == "query_id"] == ["query_id"]
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
            assert r.rank == len(got.setdefault(r.query_id, []))
            got[r.query_id].append((r.id, r.score))
        for k in range(700):
            own = [i for i in range(700) if not scoped or i % 5 == k % 5]
            want = sorted(own, key=lambda i: (-sims[k, i], i))[:12]
            assert [s for _, s in got[k]] == [sims[k, i] for i in want] and [i for i, _ in got[k]] == want


@pytest.mark.parametrize("name", ["rerank_listing", "answer_prompt"])
def test_texts_of_hits_are_not_shuffled(spark, name):
    from heronry.plans import catalogue

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by = shuffles(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert by and "id" not in by and "chunk_id" not in by and "doc_id" not in by
