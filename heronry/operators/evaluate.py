"""Pass@k of ranked results against gold sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id): the chunks of a question's document whose section has its keyword."""
    q = questions.select("query_id", "gold_doc_id", "section_keyword")
    return q.join(chunks.select(F.col("chunk_id").alias("id"), "doc_id", "section"), F.col("gold_doc_id") == F.col("doc_id")).where(F.contains("section", "section_keyword")).select("query_id", "id")


def pass_at_k(hits: DataFrame, gold: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(k, hits, questions, rate): the share of questions with a gold chunk among their first k."""
    best = hits.join(gold, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("best"))
    per = questions.select("query_id").distinct().join(best, "query_id", "left")
    counted = per.agg(F.count("*").alias("questions"), *(F.count_if(F.col("best") < k).alias(f"h{k}") for k in ks))
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("hits"), F.col("questions"), F.coalesce(F.try_divide(F.col(f"h{k}"), F.col("questions")), F.lit(0.0)).alias("rate")) for k in ks))
    return counted.select(F.inline(rows))
