"""Text layers of pages: which can be trusted, and their lines as light Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry.functions import text as T

MIN_IMAGE_AREA, MAX_PATHS = 0.03, 15


def lines(texts: DataFrame) -> DataFrame:
    """(id, line_no, line) of texts (id, text), lines stripped."""
    split = F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", -1)
    return texts.select("id", F.posexplode(split).alias("line_no", "line")).select("id", F.col("line_no").cast("long").alias("line_no"), T.strip(F.col("line")).alias("line"))


def to_markdown(texts: DataFrame) -> DataFrame:
    """(id, markdown): title-like lines become headings, other lines between blank ones one paragraph. Paragraphs
    are islands of lines, numbered by a running sum within a text."""
    marked = lines(texts).withColumn("title", T.heading_like(F.col("line"))).withColumn("blank", F.col("line") == "")
    w = W.partitionBy("id").orderBy("line_no")
    stop = F.col("title") | F.col("blank")
    part = marked.withColumn("part", F.sum((stop | F.coalesce(F.lag(stop).over(w), F.lit(True))).cast("long")).over(w)).where("not blank")
    blocks = part.groupBy("id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"), F.bool_or("title").alias("title"))
    block = F.when(F.col("title"), F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    joined = blocks.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("markdown"))
    return texts.select("id").join(joined, "id", "left").select("id", F.coalesce("markdown", F.lit("")).alias("markdown"))


def figures(objects: DataFrame) -> DataFrame:
    """(page, figure) of page objects (page, kind, area, page_area): much image area, or many vector paths. An
    image of unknown size counts as MIN_IMAGE_AREA."""
    share = F.when(F.col("kind") == "image", F.coalesce(F.try_divide("area", "page_area"), F.lit(MIN_IMAGE_AREA)))
    return objects.groupBy("page").agg(((F.coalesce(F.sum(share), F.lit(0.0)) >= MIN_IMAGE_AREA) | (F.count_if(F.col("kind") == "path") >= MAX_PATHS)).alias("figure"))


def route(text: Column, figure: Column) -> Column:
    """Where a page goes: its text layer, or a vision model."""
    return F.when(T.clean_prose(text) & ~F.coalesce(figure, F.lit(False)), "text").otherwise("vision")
