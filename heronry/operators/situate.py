"""Situating chunks in their documents: prompts, excerpts of documents that are too long, and blurbs.

A document of at most doc_cap tokens goes whole into the prompt of each of its chunks. Of a longer one,
consecutive chunks share an excerpt: the head of the document, and a region around them. Excerpt bounds are
plain window expressions over prefix sums of token counts; only the greedy cut into ranges carries state.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from heronry.functions import text as T

DOC_CAP, PART_TOKENS = 250_000, 48_000
HEAD, MARGIN, MIN_SPAN = 6_000, 4_000, 8_000


@dataclass(frozen=True)
class Anatomy:
    """Tokens of an excerpt's parts."""

    head: int
    margin: int
    span: int


def anatomy(part_tokens: int = PART_TOKENS) -> Anatomy:
    """The parts of an excerpt; all shrink alike if the budget is below their sum."""
    whole = HEAD + 2 * MARGIN + MIN_SPAN
    head, margin, least = HEAD, MARGIN, MIN_SPAN
    if part_tokens < whole:
        head, margin, least = (max(1, int(x * (part_tokens / whole))) for x in (head, margin, least))
    return Anatomy(head, margin, max(least, part_tokens - head - 2 * margin))


def document_mode(text: Column, doc_cap: int = DOC_CAP) -> Column:
    return F.when(T.token_count(text) <= doc_cap, "whole").otherwise("excerpt")


def whole_prompt(document: Column, chunk: Column) -> Column:
    return F.concat(F.lit("<document>\n"), document, F.lit("\n</document>\n\nOne part of it:\n<chunk>\n"), chunk, F.lit("\n</chunk>\n\nSay in one or two sentences where this part belongs in the document, so that a search finds it. Reply with these sentences only."))


def excerpt_prompt(excerpt: Column, chunk: Column) -> Column:
    return F.concat(F.lit("<excerpt>\n"), excerpt, F.lit("\n</excerpt>\n\nThe excerpt is from a longer document. One part of it:\n<chunk>\n"), chunk, F.lit("\n</chunk>\n\nSay in one or two sentences where this part belongs in the document, so that a search finds it. Reply with these sentences only."))


def sized(chunks: DataFrame) -> DataFrame:
    """chunks with tok, upto (tokens up to and with this chunk) and n, the chunks of the document."""
    tok = F.when(F.coalesce(F.col("token_count"), F.lit(0)) == 0, T.token_count(F.col("text"))).otherwise(F.col("token_count")).cast("long")
    w = W.partitionBy("doc_id")
    return chunks.withColumn("tok", tok).withColumn("upto", F.sum("tok").over(w.orderBy("index").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.count("*").over(w))


def head_ends(chunks: DataFrame, head: int) -> DataFrame:
    """(doc_id, head_end): the number of first chunks that have head tokens together, or all."""
    return sized(chunks).groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("upto") >= head, F.col("index") + 1)), F.max("n")).cast("long").alias("head_end"))


def batch_ranges(chunks: DataFrame, span: int) -> DataFrame:
    """(doc_id, start, end) of runs of chunks that share an excerpt: a run ends where the next chunk would not
    fit, or where a top section ends and the run is half full."""

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        starts, used, before = [], 0, None
        for k, (tok, top) in enumerate(zip(frame["tok"].tolist(), frame["top"].tolist())):
            if not starts or used + tok > span or (top != before and used >= span // 2):
                starts.append(k)
                used = 0
            used += tok
            before = top
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[0], "start": starts, "end": starts[1:] + [len(frame)]})

    top = F.coalesce(F.try_element_at("header_path", F.lit(1)), F.lit(""))
    narrow = sized(chunks).select("doc_id", "index", "tok", top.alias("top"))
    return narrow.groupBy("doc_id").applyInPandas(cut, f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, start long, end long")


def excerpt_bounds(chunks: DataFrame, ranges: DataFrame, head: int, margin: int) -> DataFrame:
    """(doc_id, start, end, head_end, lo, hi): the excerpt of a range is chunks below head_end, and lo to hi."""
    c = sized(chunks)
    upto = F.transform(F.sort_array(F.collect_list(F.struct("index", "upto"))), lambda x: x["upto"])
    per_doc = c.groupBy("doc_id").agg(F.concat(F.array(F.lit(0).cast("long")), upto).alias("p"), F.max("n").alias("n"), F.coalesce(F.min(F.when(F.col("upto") >= head, F.col("index") + 1)), F.max("n")).cast("long").alias("h"))
    r = ranges.join(per_doc, "doc_id").withColumn("lo0", F.greatest("h", "start")).withColumn("hi0", F.greatest("h", "end"))
    at = lambda i: F.element_at("p", (i + 1).cast("int"))
    lo = F.array_max(F.filter(F.sequence("h", "lo0"), lambda j: at(F.col("lo0")) - at(j) >= margin))
    hi = F.array_min(F.filter(F.sequence("hi0", "n"), lambda j: at(j) - at(F.col("hi0")) >= margin))
    return r.select("doc_id", "start", "end", F.col("h").alias("head_end"), F.coalesce(lo, "h").alias("lo"), F.coalesce(hi, "n").alias("hi"))


def excerpts(chunks: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, start, end, excerpt)."""
    texts = chunks.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]).alias("t"))
    one = F.concat(F.slice("t", F.lit(1), F.col("head_end").cast("int")), F.when(F.col("lo") > F.col("head_end"), F.array(F.lit(T.GAP_MARK))).otherwise(F.array().cast("array<string>")), F.slice("t", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    return bounds.join(texts, "doc_id").select("doc_id", "start", "end", F.array_join(one, "\n\n").alias("excerpt"))


def prompts(docs: DataFrame, chunks: DataFrame, doc_cap: int = DOC_CAP, part_tokens: int = PART_TOKENS) -> DataFrame:
    """chunks with prompt, prefix_group and excerpted. Chunks of a group share what the prompt begins with."""
    parts = anatomy(part_tokens)
    modes = docs.select("doc_id", "markdown", document_mode(F.col("markdown"), doc_cap).alias("mode"))
    whole = chunks.join(modes.where("mode = 'whole'"), "doc_id").select(*(chunks[c] for c in chunks.columns), whole_prompt(F.col("markdown"), F.col("text")).alias("prompt"), F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("prefix_group"), F.lit(False).alias("excerpted"))
    long = chunks.join(modes.where("mode = 'excerpt'").select("doc_id"), "doc_id", "left_semi")
    shared = excerpts(long, excerpt_bounds(long, batch_ranges(long, parts.span), parts.head, parts.margin))
    cut = long.alias("c").join(shared.alias("e"), (F.col("c.doc_id") == F.col("e.doc_id")) & (F.col("index") >= F.col("start")) & (F.col("index") < F.col("end")))
    cut = cut.select(*(F.col(f"c.{c}") for c in chunks.columns), excerpt_prompt(F.col("excerpt"), F.col("text")).alias("prompt"), F.concat(F.col("c.doc_id").cast("string"), F.lit("#"), F.col("start").cast("string")).alias("prefix_group"), F.lit(True).alias("excerpted"))
    return whole.unionByName(cut)


def situate(prompted: DataFrame, provider, concurrency: int = 4) -> DataFrame:
    """Adds context, embed_text and token accounting by a provider's chat. A group's first prompt goes alone, so
    that it fills the provider's prefix cache, and the others side by side."""
    schema = StructType([*prompted.schema.fields, StructField("reply", StringType()), *(StructField(c, LongType()) for c in ("prompt_tokens", "completion_tokens", "cached_tokens"))])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from concurrent.futures import ThreadPoolExecutor

        frame = frame.sort_values("index").reset_index(drop=True)
        ask = frame["prompt"].tolist()
        replies = [provider.chat(ask[0], temperature=0.0)]
        if concurrency > 1 and len(ask) > 2:
            with ThreadPoolExecutor(concurrency) as pool:
                replies += pool.map(lambda p: provider.chat(p, temperature=0.0), ask[1:])
        else:
            replies += [provider.chat(p, temperature=0.0) for p in ask[1:]]
        for column, name in (("reply", "text"), ("prompt_tokens", "prompt_tokens"), ("completion_tokens", "completion_tokens"), ("cached_tokens", "cached_tokens")):
            frame[column] = [getattr(r, name) for r in replies]
        return frame

    got = prompted.groupBy("prefix_group").applyInPandas(run, schema)
    context = T.clean_context(F.col("reply"))
    return got.withColumn("context", context).withColumn("embed_text", T.embed_text(F.col("context"), F.col("text"))).drop("reply", "prompt")


def report(situated: DataFrame) -> DataFrame:
    """(doc_id, chunks, context_tokens, cached_tokens, excerpted)."""
    return situated.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("context_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.bool_or("excerpted").alias("excerpted"))


def cache_ratio(reported: DataFrame) -> DataFrame:
    """A report with cache_ratio, the share of its tokens that came from the provider's cache."""
    return reported.withColumn("cache_ratio", F.col("cached_tokens") / F.greatest(F.lit(1), F.col("context_tokens")))


def situate_one(spark: SparkSession, document: str, chunk: str, provider, doc_cap: int = DOC_CAP) -> dict:
    """Context, embed_text and tokens of one chunk of a document. A document beyond doc_cap tokens is shown as what
    is around the chunk, doc_cap tokens at most."""
    limit = doc_cap * 4
    if len(document) > limit:
        at = max(0, document.find(chunk))
        start = max(0, min(at + len(chunk) // 2 - limit // 2, len(document) - limit))
        shown, prompt = document[start : start + limit], excerpt_prompt
    else:
        shown, prompt = document, whole_prompt
    row = spark.createDataFrame([(shown, chunk)], "document string, text string")
    reply = provider.chat(row.select(prompt(F.col("document"), F.col("text"))).first()[0], temperature=0.0)
    said = spark.createDataFrame([(reply.text, chunk)], "reply string, text string").select(T.clean_context(F.col("reply")).alias("context"), "text")
    out = said.select("context", T.embed_text(F.col("context"), F.col("text")).alias("embed_text")).first().asDict()
    return {**out, "prompt_tokens": reply.prompt_tokens, "completion_tokens": reply.completion_tokens, "cached_tokens": reply.cached_tokens}
