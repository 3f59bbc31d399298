"""Reranking: listings for a model, replies read back, and the order that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry.functions import text as T

MODES, SNIPPET = ("llm", "endpoint", "off"), 350


def listings(candidates: DataFrame) -> DataFrame:
    """(query_id, listing) of candidates (query_id, rank, embed_text): a line "[i] snippet" each, by rank."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("embed_text", 1, SNIPPET))
    return candidates.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("listing"))


def prompt(query, listing):
    return F.concat(F.lit("Question: "), query, F.lit("\n\nPassages:\n"), listing, F.lit("\n\nOrder the passages by how well they answer the question. Reply with their numbers, best first, separated by commas."))


def mentions(replies: DataFrame) -> DataFrame:
    """(query_id, rank, at): for each number in a reply (query_id, reply), where it is mentioned first."""
    return replies.select("query_id", F.posexplode(T.rank_numbers(F.col("reply"))).alias("at", "rank")).groupBy("query_id", "rank").agg(F.min("at").cast("long").alias("at"))


def reorder(candidates: DataFrame, mentioned: DataFrame, stamped: bool = False, top_k: int | None = None) -> DataFrame:
    """candidates (query_id, rank, ...) in the order of mentioned (query_id, rank, at, and rerank if stamped).
    Numbers of no candidate are ignored, candidates that aren't mentioned follow in their order; mentioned ones
    get 1 / place as rerank, to 4 decimals, unless they come with a score. Of each query the first top_k stay, all if it is 0 or None."""
    m = mentioned.select("query_id", "rank", "at", *(["rerank"] if stamped else []))
    joined = candidates.join(m, ["query_id", "rank"], "left")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.asc_nulls_last("at"), F.col("rank")))
    out = joined.withColumn("place", place)
    score = F.col("rerank") if stamped else F.when(F.col("at").isNotNull(), F.round(1 / F.col("place"), 4))
    keep = [c for c in candidates.columns if c != "rank"]
    if top_k:
        out = out.where(F.col("place") <= top_k)
    return out.select(*keep, (F.col("place") - 1).cast("long").alias("rank"), score.alias("rerank"))


def by_reply(candidates: DataFrame, replies: DataFrame, top_k: int | None = None) -> DataFrame:
    return reorder(candidates, mentions(replies), top_k=top_k)


RESPONSE = "struct<results:array<struct<index:bigint,relevance_score:double>>>"


def by_endpoint(candidates: DataFrame, responses: DataFrame, top_k: int | None = None) -> DataFrame:
    """The order of a reranking service's JSON responses (query_id, response): by relevance, none counting 0;
    an index that comes twice keeps its first place and its last score."""
    rows = responses.select("query_id", F.posexplode(F.from_json("response", RESPONSE)["results"]).alias("pos", "r")).select("query_id", "pos", F.col("r.index").alias("rank"), F.coalesce("r.relevance_score", F.lit(0.0)).alias("relevance")).where("rank is not null")
    placed = rows.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "pos")))
    first = placed.groupBy("query_id", "rank").agg(F.min("at").cast("long").alias("at"), F.round(F.max_by("relevance", "at"), 4).alias("rerank"))
    return reorder(candidates, first, stamped=True, top_k=top_k)


def model_reranker(queries: DataFrame, chunks: DataFrame, provider, mode: str = "llm", top_k: int | None = None):
    """A reranker for fusion.trace(): asks the provider once a query; queries (query_id, query), chunks (id, embed_text).
    Without a configured service, mode "endpoint" asks the chat model."""
    if mode not in MODES:
        raise ValueError(f"unknown rerank mode {mode!r}; one of {', '.join(MODES)}")

    def run(candidates: DataFrame) -> DataFrame:
        seen = candidates.join(chunks.select("id", "embed_text"), "id")
        asked = queries.select("query_id", "query")
        if mode == "endpoint" and provider.reranks():
            lists = seen.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "embed_text"))), lambda x: x["embed_text"]).alias("documents"))
            ask = lists.join(asked, "query_id").select("query_id", provider.rerank_column(F.col("query"), F.col("documents")).alias("response"))
            return by_endpoint(candidates, ask, top_k)
        ask = listings(seen).join(asked, "query_id").select("query_id", prompt(F.col("query"), F.col("listing")).alias("prompt"))
        return by_reply(candidates, ask.select("query_id", provider.chat_column(F.col("prompt")).alias("reply")), top_k)

    return run
