"""SF, PRJ, CTX6, SNK5, PG2-PG6: expressions and page text."""

import zlib

import pytest
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.operators import pagetext
from heronry.sources.corpus import collection_name
from heronry.sources.providers import Offline


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]


def test_tokens(spark):
    assert column(spark, ["L'Été x_1 №5", "", None], T.tokens) == [["l", "été", "x_1", "5"], [], []]


@pytest.mark.parametrize(
    "raw,clean",
    [("Here is the succinct context: From the Methods.", "From the Methods."), ("Context: a", "a"), ("The context is set in 2020", "set in 2020"), ("Here is the context", "Here is the context"), ('"quoted"', "quoted"), ("```\ninside\n```", "inside"), ("  Ce passage est clair. ", "Ce passage est clair."), ("Here is some context: z", "Here is some context: z"), ("``", ""), ("````", ""), (None, "")],
)
def test_clean_context(spark, raw, clean):
    assert column(spark, [raw], T.clean_context) == [clean]


def test_names(spark):
    ids = ["default", "my corpus!", "corpus.", "x..y", "é", "a b", "a_b", "c" * 600]
    got = column(spark, ids, T.collection_name)
    assert got == [collection_name(x) for x in ids] and len(set(got)) == len(ids)
    assert got[0] == "domain_default" and all(len(g) <= 512 and g[-1].isalnum() and ".." not in g for g in got)


def test_citation_and_embed_text(spark):
    df = spark.createDataFrame([("d", [2, 3], "c", "t"), ("d", [], "", "t"), ("d", None, None, "t")], "doc_id string, pages array<int>, context string, text string")
    got = df.select(T.citation(F.col("doc_id"), F.col("pages")), T.embed_text(F.col("context"), F.col("text"))).collect()
    assert [tuple(r) for r in got] == [("d, p.2-3", "c\n\nt"), ("d", "t"), ("d", "t")]


def test_hashed_vector_is_the_offline_embedder(spark):
    texts = ["Ice moves slowly", "", "ice ICE"]
    assert column(spark, texts, T.hashed_vector) == [pytest.approx(v) for v in Offline().embed(texts)]
    assert column(spark, ["ice"], T.hashed_vector)[0].index(1.0) == zlib.crc32(b"ice") % 128


def test_prose_gate(spark):
    prose = "The glacier moves a little each day and nobody sees it move. " * 5
    got = column(spark, [prose, prose + " ∑", prose[:100], prose + "$", "7" * 300, None], T.clean_prose)
    assert got == [True, False, False, False, False, False]


def test_heading_like(spark):
    lines = ["Results and Discussion", "results", "- item", "2. Methods", "He said \"tomorrow.\"", "A line that has far too many words to be a title", "1850 1851 1852", "", None, "«Été»"]
    assert column(spark, lines, T.heading_like) == [True, False, False, False, False, False, False, False, False, True]


def test_text_layer_to_markdown(spark):
    raw = "Results\nthe ice went\r\nback a lot.\n\n\nand more\nOutlook\nNext"
    df = spark.createDataFrame([(1, raw), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.markdown for r in pagetext.to_markdown(df).collect()} == {1: "# Results\n\nthe ice went back a lot.\n\nand more\n\n# Outlook\n\n# Next", 2: "", 3: ""}


def test_figures_and_route(spark):
    rows = [(1, "image", 5.0, 100.0), (2, "image", 1.0, 100.0), (3, "image", None, 100.0)] + [(4, "path", 0.0, 100.0)] * 15 + [(5, "path", 0.0, 100.0)] * 14
    got = {r.page: r.figure for r in pagetext.figures(spark.createDataFrame(rows, "page int, kind string, area double, page_area double")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
