"""Documents from files, tables and parsers, as (doc_id, markdown) or (doc_id, page_markdown, pages, routes)."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators import pagetext
from heronry.settings import get_settings


class ParseError(ValueError):
    """A document that can't be parsed."""


def _name(path):
    return F.element_at(F.split(path, "/"), -1)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, markdown) of whole text files; the file's name is doc_id."""
    return spark.read.text(path, wholetext=True).select(_name(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("markdown"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, data) of files of any kind."""
    return spark.read.format("binaryFile").load(path).select(_name(F.col("path")).alias("doc_id"), F.col("content").alias("data"))


def one_file(source: bytes | str | Path, filename: str | None = None) -> tuple[str, bytes]:
    """(name, bytes) of a path, or of bytes, which need a name."""
    if isinstance(source, bytes):
        if not filename:
            raise ValueError("bytes need a filename")
        return filename, source
    return filename or Path(source).name, Path(source).read_bytes()


#: name -> function from (doc_id, data) to (doc_id, page, text, figure, image), a row a page
_page_readers: dict[str, Callable[[DataFrame], DataFrame]] = {}
#: name -> function from (doc_id, data) to (doc_id, markdown, pages): one text a document, without page texts
_layout_readers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_page_reader(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    _page_readers[name] = reader


def register_layout_reader(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    _layout_readers[name] = reader


PROMPT = "Write this page as Markdown: its text in reading order, headings, tables and formulas, and a short description of each figure."


def pages_to_documents(pages: DataFrame, provider, max_pages: int | None = None, mode: str = "auto") -> DataFrame:
    """(doc_id, page_markdown, pages, total_pages, routes, markdown, model, prompt_tokens, completion_tokens) of pages (doc_id, page, text, figure, image).
    Clean prose without figures comes from the text layer; other pages, or all with mode 'vision', from the
    provider. Pages after max_pages are left out."""
    if mode not in ("auto", "vision"):
        raise ValueError(f"unknown mode {mode!r}")
    total = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_pages"))
    held = pages if max_pages is None else pages.where(F.col("page") <= max_pages)
    route = F.lit("vision") if mode == "vision" else pagetext.route(F.col("text"), F.col("figure"))
    routed = held.withColumn("route", route).withColumn("id", F.struct("doc_id", "page"))
    plain = pagetext.to_markdown(routed.where("route = 'text'").select("id", "text")).select("id", "markdown")

    def read(batches):
        for frame in batches:
            replies = [provider.transcribe(bytes(x or b""), PROMPT) for x in frame["image"]]
            for column, name in (("markdown", "text"), ("model", "model"), ("prompt_tokens", "prompt_tokens"), ("completion_tokens", "completion_tokens")):
                frame[column] = [getattr(r, name) for r in replies]
            yield frame[["doc_id", "page", "markdown", "model", "prompt_tokens", "completion_tokens"]]

    seen = routed.where("route = 'vision'").select("doc_id", "page", "image")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("doc_id", "page")}
    seen = seen.mapInPandas(read, f"doc_id {kinds['doc_id']}, page {kinds['page']}, markdown string, model string, prompt_tokens long, completion_tokens long")
    none = [F.lit("").alias("model"), *(F.lit(0).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens"))]
    both = plain.select("id.doc_id", "id.page", "markdown", *none, F.lit("text").alias("route")).unionByName(seen.withColumn("route", F.lit("vision")))
    ordered = F.sort_array(F.collect_list(F.struct("page", "markdown", "route")))
    used = [F.max("model").alias("model"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")]
    docs = both.groupBy("doc_id").agg(ordered.alias("p"), *used).select("doc_id", "model", "prompt_tokens", "completion_tokens", F.transform("p", lambda x: x["markdown"]).alias("page_markdown"), F.transform("p", lambda x: x["route"]).alias("routes"))
    return docs.join(total, "doc_id").select("doc_id", "page_markdown", F.size("page_markdown").alias("pages"), "total_pages", "routes", F.array_join("page_markdown", "\n\n").alias("markdown"), "model", "prompt_tokens", "completion_tokens")


def parse(files: DataFrame, provider, parser: str | None = None, **options) -> DataFrame:
    """Parsed documents of files (doc_id, data) by the parser of the settings."""
    parser = parser or get_settings().parser
    if parser in _page_readers:
        return pages_to_documents(_page_readers[parser](files), provider, **options)
    if parser in _layout_readers:
        read = _layout_readers[parser](files)
        return read.select("doc_id", F.array("markdown").alias("page_markdown"), "pages", F.col("pages").alias("total_pages"), F.array(F.lit(parser)).alias("routes"), "markdown", F.lit("").alias("model"), *(F.lit(0).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")))
    raise ParseError(f"no reader is registered for {parser!r}")


def profile(parsed: DataFrame) -> DataFrame:
    """(doc_id, chars, vision_pages, text_pages) of parsed documents."""
    n = lambda kind: F.size(F.filter("routes", lambda r: r == kind)).cast("long")
    return parsed.select("doc_id", F.length("markdown").cast("long").alias("chars"), n("vision").alias("vision_pages"), n("text").alias("text_pages"))


COMPANIES, QUARTERS = ["Aurora Foods", "Borealis Air", "Cobalt Labs"], ["Q1", "Q2", "Q3", "Q4"]
TOPICS = {"Revenue": "What was the revenue of {c} in {q}?", "Operating margin": "How high was the operating margin of {c} in {q}?", "Headcount": "How many people did {c} employ at the end of {q}?"}


def synthetic_reports(spark: SparkSession) -> DataFrame:
    """(doc_id, markdown): quarterly reports that differ in names and figures only."""
    c = spark.createDataFrame(list(enumerate(COMPANIES)), "ci int, company string")
    q = spark.createDataFrame(list(enumerate(QUARTERS)), "qi int, quarter string")
    both = c.crossJoin(q)
    figures = {"growth": 4 + 8 * F.col("ci") + 2 * F.col("qi"), "revenue": 420 + 140 * F.col("ci") + 35 * F.col("qi"), "margin": 18 + 4 * F.col("ci") + F.col("qi"), "hires": 40 + 45 * F.col("ci") + 10 * F.col("qi"), "headcount": 2600 + 900 * F.col("ci") + 60 * F.col("qi"), "guidance": 3 + 4 * F.col("ci") + F.col("qi")}
    body = [
        ("# {company} {quarter} report", []),
        ("## Summary\nThe quarter went as planned. Revenue grew by %d percent over the year before.", ["growth"]),
        ("## Revenue\nRevenue reached %d million, an increase of %d percent.", ["revenue", "growth"]),
        ("## Operating margin\nThe operating margin came to %d percent.", ["margin"]),
        ("## Headcount\nThe company hired %d people and had %d at the end of the quarter.", ["hires", "headcount"]),
        ("## Outlook\nManagement expects growth of %d percent in the next quarter.", ["guidance"]),
    ]
    parts = [F.concat(F.lit("# "), "company", F.lit(" "), "quarter", F.lit(" report"))] + [F.format_string(t, *(figures[f] for f in fs)) for t, fs in body[1:]]
    return both.select(F.concat(F.regexp_replace(F.lower("company"), " ", "-"), F.lit("-"), F.lower("quarter")).alias("doc_id"), F.concat_ws("\n\n", *parts).alias("markdown"))


def synthetic_questions(spark: SparkSession) -> DataFrame:
    """(query_id, query, gold_doc_id, section_keyword) for synthetic_reports()."""
    rows = [(f"{c}|{q}|{t}", text.format(c=c, q=q), f"{c.lower().replace(' ', '-')}-{q.lower()}", t) for c in COMPANIES for q in QUARTERS for t, text in TOPICS.items()]
    return spark.createDataFrame(rows, "query_id string, query string, gold_doc_id string, section_keyword string")


__all__ = ["ParseError", "binary_files", "markdown_files", "one_file", "pages_to_documents", "parse", "profile", "register_layout_reader", "register_page_reader", "synthetic_questions", "synthetic_reports"]
