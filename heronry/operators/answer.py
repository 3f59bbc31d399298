"""Grounded answers: numbered sources, the prompt, and the reply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions import text as T

NOTHING = "No indexed passage answers this question."
RULES = "Answer from the numbered sources only. Cite each statement by its source's mark, such as [S1]. If the sources don't have the answer, say so."


def sources(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, mark, doc_id, chunk_id, citation, text): the ORIGINAL text of each hit, in order of rank."""
    c = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "chunk_id", "pages", "text")
    return hits.select("query_id", "rank", "id").join(c, "id").select("query_id", "rank", F.concat(F.lit("[S"), (F.col("rank") + 1).cast("string"), F.lit("]")).alias("mark"), "doc_id", "chunk_id", T.citation(F.col("doc_id"), F.col("pages")).alias("citation"), "text")


def prompts(queries: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, prompt, sources): null prompts where a query has no source, so no model is asked."""
    block = F.concat(F.col("mark"), F.lit(" (source: "), F.col("citation"), F.lit(")\n"), F.col("text"))
    listed = cited.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block"), "chunk_id"))).alias("s"))
    blocks = F.array_join(F.transform("s", lambda x: x["block"]), "\n\n")
    return queries.select("query_id", "query").join(listed, "query_id", "left").select("query_id", F.when(F.col("s").isNotNull(), F.concat(F.lit(RULES + "\n\nSources:\n"), blocks, F.lit("\n\nQuestion: "), F.col("query"))).alias("prompt"), F.transform("s", lambda x: x["chunk_id"]).alias("sources"))


def answers(prompted: DataFrame, provider) -> DataFrame:
    """(query_id, text, sources)."""
    asked = prompted.where("prompt is not null").select("query_id", provider.chat_column(F.col("prompt")).alias("text"), "sources")
    none = prompted.where("prompt is null").select("query_id", F.lit(NOTHING).alias("text"), F.array().cast("array<string>").alias("sources"))
    return asked.unionByName(none)
