"""The facade: ingest documents, search them, ask questions. Questions come one by one or as a DataFrame."""

from __future__ import annotations

import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators import answer, fusion, lexical, rerank, segment, situate
from heronry.settings import get_settings
from heronry.sources import documents
from heronry.sources.corpus import Store
from heronry.sources.providers import Offline


class Retrieval:
    def __init__(self, spark: SparkSession, collection: str = "default", path: str | None = None, rerank_mode: str | None = None, provider=None) -> None:
        self.spark, self.store = spark, Store(spark, collection, path)
        self.provider = provider or Offline()
        self._mode = rerank_mode
        self._held: tuple[str | None, DataFrame, lexical.Index] | None = None

    @property
    def rerank_mode(self) -> str:
        """The one given, or that of the settings at the time of the query."""
        return self._mode if self._mode is not None else get_settings().retrieval_rerank

    # --- ingestion

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Chunks, situates, embeds and stores documents (doc_id, and markdown or page_markdown); gives a report."""
        settings = get_settings()
        if "markdown" not in docs.columns:
            docs = docs.withColumn("markdown", F.array_join("page_markdown", "\n\n"))
        chunks = segment.chunk(docs, domain_id=self.store.domain_id)
        prompted = situate.prompts(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "markdown"), chunks, settings.context_doc_cap, settings.context_part_tokens)
        placed = situate.situate(prompted, self.provider, settings.context_concurrency)
        # models are asked once: the store and the report read what was written
        held = placed.withColumn("embedding", self.provider.embed_column(F.col("embed_text"))).persist()
        try:
            self.store.add(held)
            return self.spark.createDataFrame(situate.report(held).collect(), situate.report(held).schema)  # a row a document of one batch
        finally:
            held.unpersist()

    def ingest_markdown(self, markdown: str, doc_id: str) -> DataFrame:
        return self.ingest(self.spark.createDataFrame([(doc_id, markdown)], "doc_id string, markdown string"))

    def ingest_parsed(self, parsed: DataFrame) -> DataFrame:
        return self.ingest(parsed)

    def ingest_file(self, source: bytes | str | Path, filename: str | None = None) -> DataFrame:
        name, data = documents.one_file(source, filename)
        files = self.spark.createDataFrame([(name, bytearray(data))], "doc_id string, data binary")
        return self.ingest(documents.parse(files, self.provider))

    # --- search

    def _corpus(self) -> tuple[DataFrame, lexical.Index]:
        """Records and index of the current version, kept until there is another."""
        version = self.store.version()
        if self._held is None or self._held[0] != version:
            if self._held is not None:
                for df in (self._held[1], self._held[2].documents):
                    df.unpersist()
            records = self.store.records().select(F.col("chunk_id").alias("id"), F.struct("doc_id", "index").alias("ord"), F.col("doc_id").alias("scope"), "doc_id", "chunk_id", "embed_text", "text", "context", "section", "pages", "embedding").persist()
            index = lexical.build(records.select("id", "ord", F.col("embed_text").alias("text")))
            self._held = version, records, replace(index, documents=index.documents.persist())
        return self._held[1], self._held[2]

    def _queries(self, query: str | DataFrame) -> DataFrame:
        q = self.spark.createDataFrame([("q", query)], "query_id string, query string") if isinstance(query, str) else query.select("query_id", "query")
        return q.withColumn("vector", self.provider.embed_column(F.col("query")))

    def _parts(self, query: str | DataFrame, doc_id: str | None):
        records, index = self._corpus()
        if doc_id:
            records = records.where(F.col("doc_id") == doc_id)
            index = lexical.build(records.select("id", "ord", F.col("embed_text").alias("text")))
        return records, index, self._queries(query)

    def _reranker(self, queries: DataFrame, records: DataFrame, top_k: int | None):
        return None if self.rerank_mode == "off" else rerank.model_reranker(queries, records, self.provider, self.rerank_mode, top_k)

    def search_trace(self, query: str | DataFrame, k: int = 8, doc_id: str | None = None, dense_k: int = fusion.DENSE_K, bm25_k: int = fusion.BM25_K, rerank_pool: int = fusion.POOL, rerank_top_k: int | None = None, extra: dict[str, DataFrame] | None = None) -> DataFrame:
        """Every stage of the search; statistics of a search in one document are those of that document. extra has
        hits (query_id, id, score, rank) of further retrievers, by name."""
        records, index, queries = self._parts(query, doc_id)
        return fusion.hybrid(records, index, queries, k, dense_k, bm25_k, mode=self.rerank_mode, pool=rerank_pool, reranker=self._reranker(queries, records, rerank_top_k), extra=extra)

    def timed_trace(self, query: str | DataFrame, k: int = 8, doc_id: str | None = None, dense_k: int = fusion.DENSE_K, bm25_k: int = fusion.BM25_K, rerank_pool: int = fusion.POOL) -> tuple[DataFrame, dict[str, float]]:
        """The trace and the milliseconds that dense search, lexical search and the rest (fusion, and reranking if on) took.
        Stages are run one after another for it, over all questions, so it is slower than search_trace()."""
        records, index, queries = self._parts(query, doc_id)
        took: dict[str, float] = {}

        def run(name: str, df: DataFrame) -> DataFrame:
            began = time.perf_counter()
            held = df.persist()
            held.count()
            took[name] = (time.perf_counter() - began) * 1000
            return held

        queries = run("embed", queries)
        one, two = run("dense", fusion.dense(records, queries, dense_k, False)), run("bm25", lexical.search(index, queries, bm25_k))
        out = run("fusion" if self.rerank_mode == "off" else "fusion_rerank", fusion.trace(one, two, k, self.rerank_mode, rerank_pool, self._reranker(queries, records, None)))
        for held in (queries, one, two):
            held.unpersist()
        return out, took

    def search(self, query: str | DataFrame, k: int = 8, doc_id: str | None = None, **how) -> DataFrame:
        """The final hits with their records, in order of (query_id, rank); how is as in search_trace()."""
        hits = self.search_trace(query, k, doc_id, **how).where("stage = 'final'").drop("stage")
        return hits.join(self._corpus()[0].drop("ord", "scope", "embedding"), "id").orderBy("query_id", "rank")

    def ask(self, query: str | DataFrame, k: int = 6, doc_id: str | None = None, **how) -> DataFrame:
        """(query_id, text, sources)."""
        records, _ = self._corpus()
        hits = self.search_trace(query, k, doc_id, **how).where("stage = 'final'")
        queries = self._queries(query).select("query_id", "query")
        return answer.answers(answer.prompts(queries, answer.sources(hits, records)), self.provider)

    # --- the collection

    def count(self) -> int:
        return self.store.count()

    def doc_ids(self) -> set[str]:
        return {r.doc_id for r in self.store.doc_ids().collect()}

    def reset(self) -> None:
        self.store.reset()
