"""RET, WN, SO, JN: BM25, dense search, fusion, reranking, answers, evaluation against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heronry.operators import answer, evaluate, fusion, lexical, rerank, segment
from heronry.sources import documents
from heronry.sources.providers import Offline

DOCS = ["the ice moves", "ice ice and stones", "stones roll down the hill", "", "a hill of ice", "Été à la mer"]


def bm25(docs, query, k1=1.5, b=0.75):
    toks = [re.findall(r"\w+", d.lower()) for d in docs]
    avg = sum(map(len, toks)) / len(toks) or 1
    df = Counter(t for ts in toks for t in set(ts))
    out = []
    for k, ts in enumerate(toks):
        tf = Counter(ts)
        s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / avg)) for t in re.findall(r"\w+", query.lower()) if tf[t])
        if s > 0:
            out.append((k, round(s, 4)))
    return sorted(out, key=lambda x: -x[1])


def frame(spark, docs=DOCS):
    return spark.createDataFrame([(k, t, "even" if k % 2 == 0 else "odd") for k, t in enumerate(docs)], "id long, text string, source string")


@pytest.mark.parametrize("limit", [1000, 0])
def test_bm25(spark, limit):
    asked = ["ice on the hill", "ice ice stones", "été", "nothing here", ""]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in lexical.search(lexical.build(frame(spark)), q, 50, broadcast_terms=limit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for k, text in enumerate(asked):
        assert got.get(k, []) == bm25(DOCS, text)


def test_scoped_bm25_has_its_own_statistics(spark):
    q = spark.createDataFrame([(0, "even", "ice on the hill"), (1, "odd", "ice on the hill")], "query_id long, scope string, query string")
    got = {(r.query_id, r.id): r.score for r in lexical.search(lexical.build(frame(spark), F.col("source")), q, 50).collect()}
    want = {}
    for k in (0, 1):
        own = [i for i in range(len(DOCS)) if i % 2 == k]
        want |= {(k, own[i]): s for i, s in bm25([DOCS[i] for i in own], "ice on the hill")}
    assert got == want


def test_empty_corpus(spark):
    q = spark.createDataFrame([(0, "ice")], "query_id long, query string")
    assert lexical.search(lexical.build(frame(spark).limit(0)), q, 5).collect() == []


def test_dense_is_exact(spark):
    rng = random.Random(1)
    rows = [(k, k % 3, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [(60, 0, [0.0] * 8), (61, 1, rng and [1.0] * 8), (62, 1, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, scope long, embedding array<float>")
    cos = lambda a, b: 0.0 if not any(a) or not any(b) else sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for scoped in (False, True):
        got = {}
        for r in fusion.dense(df, df.select(F.col("id").alias("query_id"), "scope", F.col("embedding").alias("vector")), 5, scoped).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.score))
        for q, scope, v in rows:
            want = sorted(((i, math.floor(cos(v, w) * 1e4 + 0.5) / 1e4) for i, s, w in rows if not scoped or s == scope), key=lambda x: (-x[1], x[0]))[:5]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=1.1e-4)
    assert fusion.dense(df.limit(0), df.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 5).collect() == []


def test_fusion_order_is_a_stable_sort(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for q in range(30):
        lists = [rng.sample(range(40), rng.randint(0, 25)) for _ in range(2)]
        sums: dict[int, float] = {}
        for name, ids in zip(("dense", "bm25"), lists):
            for r, i in enumerate(ids):
                rows.append((q, name, i, 0.5, r))
                sums[i] = sums.get(i, 0.0) + 1 / (61 + r)
        want[q] = sorted(sums, key=lambda i: -round(sums[i], 5))
    ranked = spark.createDataFrame(rows, "query_id long, retriever string, id long, score double, rank long")
    got: dict = {}
    for r in fusion.rrf(ranked, ["dense", "bm25"]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert all(got.get(q, []) == w for q, w in want.items())


def test_trace_with_reranking_keeps_every_candidate(spark):
    texts = [f"ice number {k} " + "hill " * (k % 5) for k in range(12)]
    records = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "id long, text string, embed_text string")
    provider = Offline()
    q = spark.createDataFrame([(0, "ice hill"), (1, "number 3")], "query_id long, query string")
    index = lexical.build(records)
    vec = records.withColumn("embedding", provider.embed_column(F.col("text")))
    asked = q.withColumn("vector", provider.embed_column(F.col("query")))
    hits = fusion.hybrid(vec, index, asked, 3, mode="llm", reranker=rerank.model_reranker(q, records, provider)).cache()
    stages = {(r.query_id, r.stage): r["count"] for r in hits.groupBy("query_id", "stage").count().collect()}
    assert {s for _, s in stages} == {"dense", "bm25", "fused", "reranked", "final"}
    assert all(stages[k, "reranked"] == stages[k, "fused"] and stages[k, "final"] == 3 for k in (0, 1))
    # the offline reply is the identity order
    order = lambda stage: [r.id for r in hits.where(F.col("stage") == stage).orderBy("query_id", "rank").collect()]
    assert order("reranked") == order("fused")
    closed = fusion.hybrid(vec, index, asked, 12, mode="llm", reranker=rerank.model_reranker(q, records, provider))
    assert closed.where("stage = 'reranked'").count() == 0 and closed.where("stage = 'final' and query_id = 0").count() == 12
    one = fusion.scores_map(hits).where("stage = 'final'").first().scores
    assert set(one) >= {"rrf", "rerank"}
    with pytest.raises(ValueError):
        rerank.model_reranker(q, records, provider, "maybe")


def test_replies_and_endpoint(spark):
    pool = spark.createDataFrame([(0, f"c{k}", k) for k in range(3)], "query_id long, id string, rank long")
    replies = spark.createDataFrame([(0, "I say 2, 7, 2 then 99999999999999999999 and 0")], "query_id long, reply string")
    got = [(r.id, r.rerank) for r in rerank.by_reply(pool, replies).orderBy("rank").collect()]
    assert got == [("c2", 1.0), ("c0", 0.5), ("c1", None)]
    payload = '{"results":[{"index":2,"relevance_score":0.9},{"index":99,"relevance_score":0.8},{"index":-1,"relevance_score":0.7},{"index":0,"relevance_score":0.1}]}'
    got = [(r.id, r.rerank) for r in rerank.by_endpoint(pool, spark.createDataFrame([(0, payload)], "query_id long, response string")).orderBy("rank").collect()]
    assert got == [("c2", 0.9), ("c0", 0.1), ("c1", None)]


def test_answers_cite_the_original_text(spark):
    chunks = spark.createDataFrame([("d::0", "d", [2], "Ice moves."), ("d::1", "d", [], "Stones roll.")], "chunk_id string, doc_id string, pages array<int>, text string")
    hits = spark.createDataFrame([(0, 0, "d::1"), (0, 1, "d::0")], "query_id long, rank long, id string")
    q = spark.createDataFrame([(0, "What moves?"), (1, "Nothing?")], "query_id long, query string")
    prompted = {r.query_id: r for r in answer.prompts(q, answer.sources(hits, chunks)).collect()}
    assert "[S1] (source: d)\nStones roll.\n\n[S2] (source: d, p.2)\nIce moves.\n\nQuestion: What moves?" in prompted[0].prompt
    assert prompted[0].sources == ["d::1", "d::0"] and prompted[1].prompt is None
    said = {r.query_id: r for r in answer.answers(answer.prompts(q, answer.sources(hits, chunks)), Offline()).collect()}
    assert "[S1]" in said[0].text and said[1].text == answer.NOTHING and said[1].sources == []


def test_pass_at_k_on_generated_reports(spark):
    chunks = segment.chunk(documents.synthetic_reports(spark), target=60, overlap_tokens=0, min_tokens=0).cache()
    asked = documents.synthetic_questions(spark)
    named = chunks.select(F.col("chunk_id").alias("id"), F.concat_ws("\n\n", F.regexp_replace("doc_id", "-", " "), "text").alias("text"))
    rate = {}
    for kind, records in (("named", named), ("bare", chunks.select(F.col("chunk_id").alias("id"), "text"))):
        hits = lexical.search(lexical.build(records), asked)
        rate[kind] = {r.k: r.rate for r in evaluate.pass_at_k(hits, evaluate.gold_chunks(asked, chunks), asked).collect()}
    assert rate["named"][5] > rate["bare"][5] and rate["named"][5] > 0.9 and rate["named"][1] <= rate["named"][3]
