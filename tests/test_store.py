"""SNK, SRC, ST2, RET16, CF: settings, the store, parsing, the facade and streaming."""

import pytest
from pyspark.sql import functions as F

from heronry import settings
from heronry.plans.rag import Retrieval
from heronry.sources import documents, providers
from heronry.sources.corpus import Store
from heronry.streaming import ingest

PAPER_A = "# Aurora\n\nThe Aurora project measures ice.\n\n## Results\n\nThe ice lost forty metres in a year."
PAPER_B = "# Borealis\n\nThe Borealis project measures stones.\n\n## Results\n\nThe stones moved nine metres in a year."


@pytest.fixture(autouse=True)
def clean(monkeypatch, tmp_path):
    for field in settings.Settings.__dataclass_fields__:
        monkeypatch.delenv(field.upper(), raising=False)
    for name in ("OPENAI_API_KEY", "OPENAI_BASE_URL"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.chdir(tmp_path)
    settings.reset_settings()
    yield
    settings.reset_settings()


def test_settings(monkeypatch, tmp_path):
    assert settings.get_settings() == settings.Settings()
    settings.reset_settings()
    (tmp_path / ".env").write_text("CHAT_MODEL='from file'\nPARSER=docintel\n# no\n")
    monkeypatch.setenv("PARSER", " Vision ")
    monkeypatch.setenv("CONTEXT_DOC_CAP", "")
    assert (settings.get_settings().chat_model, settings.get_settings().parser, settings.get_settings().context_doc_cap) == ("from file", "vision", 250_000)
    assert settings.configure(chat_model="code").chat_model == "code"
    before = settings.get_settings()
    for wrong in ({"parser": "x"}, {"retrieval_rerank": "y"}):
        with pytest.raises(settings.ConfigError):
            settings.configure(**wrong)
    with pytest.raises(TypeError):
        settings.configure(nothing=1)
    assert settings.get_settings() is before
    settings.reset_settings()
    monkeypatch.setenv("CONTEXT_CONCURRENCY", "many")
    with pytest.raises(settings.ConfigError, match="CONTEXT_CONCURRENCY"):
        settings.get_settings()


def test_adapted_arguments():
    seen = []

    def call(**a):
        seen.append(a)
        if "max_tokens" in a or "temperature" in a:
            raise ValueError("max_tokens" if "max_tokens" in a else "temperature")
        return providers.Reply("ok")

    assert providers.adapted(call, {"max_tokens": 5, "temperature": 0.0}, lambda e: str(e)).text == "ok"
    assert seen[-1] == {"max_completion_tokens": 5}
    with pytest.raises(settings.ConfigError):
        providers.provider("none")
    assert providers.provider("offline") is providers.provider("offline")


def test_store_versions(spark, tmp_path):
    store = Store(spark, "x y", str(tmp_path))
    other = Store(spark, "x_y", str(tmp_path))
    assert store.count() == 0 and store.version() is None
    rows = lambda *r: spark.createDataFrame(r, "chunk_id string, doc_id string, text string, pages array<int>")
    store.add(rows(("a::0", "a", "one", [1]), ("a::1", "a", "two", None), ("b::0", "b", "three", [])))
    held = store.records()
    store.add(rows(("a::0", "a", "new", None)))
    assert {(r.chunk_id, r.text) for r in store.records().collect()} == {("a::0", "new"), ("b::0", "three")}
    assert held.count() == 3  # an older version stays readable
    store.add(rows(("b::1", "b", "four", None)), whole_documents=False)
    assert store.count() == 3 and other.count() == 0
    one = store.get("a::0").first()
    assert (one.pages, one.context, one.section, one.embed_text) == ([], "", "", "new")
    docs = spark.createDataFrame([("a",), ("c",)], "doc_id string")
    assert [r.doc_id for r in store.missing(docs).collect()] == ["c"]
    store.vacuum()
    assert store.count() == 3
    store.reset()
    assert store.count() == 0
    store.add(rows(("z::0", "z", "t", None)))
    assert store.count() == 1
    store.drop()
    store.drop()
    assert store.count() == 0


def test_facade(spark, tmp_path):
    rag = Retrieval(spark, "tour", str(tmp_path), rerank_mode="off")
    report = rag.ingest(spark.createDataFrame([("a.md", PAPER_A), ("b.md", PAPER_B)], "doc_id string, markdown string"))
    assert {r.doc_id: r.chunks for r in report.collect()} == {"a.md": 2, "b.md": 2}
    assert rag.doc_ids() == {"a.md", "b.md"} and rag.count() == 4
    first = rag.search("How many metres did the ice of Aurora lose?", k=2).collect()
    assert first[0].doc_id == "a.md" and len(first) == 2 and "Aurora" in first[0].context
    assert {r.doc_id for r in rag.search("metres in a year", doc_id="b.md").collect()} == {"b.md"}
    said = rag.ask("What moved?", doc_id="b.md").first()
    assert "[S1]" in said.text and all(s.startswith("b.md::") for s in said.sources)
    rag.ingest_markdown(PAPER_A, "a.md")
    assert rag.count() == 4
    many = rag.search(spark.createDataFrame([("x", "ice"), ("y", "stones")], "query_id string, query string"), k=1).collect()
    assert {r.query_id: r.doc_id for r in many} == {"x": "a.md", "y": "b.md"}
    rag.reset()
    assert rag.search("ice").collect() == [] and rag.ask("ice").first().sources == []
    with pytest.raises(ValueError):
        rag.ingest_file(b"bytes")


def test_parsing_pages(spark):
    prose = "The glacier moves a little each day and nobody sees it move. " * 5
    rows = [("d", 1, prose, False, b""), ("d", 2, "x = ∑", False, b"# Formula"), ("d", 3, prose, True, b"# Figure"), ("e", 1, prose, None, b"")]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string, figure boolean, image binary")
    got = {r.doc_id: r for r in documents.pages_to_documents(pages, providers.Offline()).collect()}
    assert got["d"].routes == ["text", "vision", "vision"] and got["d"].page_markdown[1] == "# Formula" and got["e"].routes == ["text"]
    cut = documents.pages_to_documents(pages, providers.Offline(), max_pages=1, mode="vision").where("doc_id = 'd'").first()
    assert (cut.pages, cut.total_pages, cut.routes) == (1, 3, ["vision"])
    assert documents.profile(documents.pages_to_documents(pages, providers.Offline())).where("doc_id = 'd'").first().vision_pages == 2
    with pytest.raises(documents.ParseError):
        documents.parse(pages, providers.Offline(), parser="unheard of")


def test_files_and_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.md").write_text(PAPER_A)
    assert documents.markdown_files(spark, str(inbox)).first().doc_id == "a.md"
    assert bytes(documents.binary_files(spark, str(inbox)).first().data) == PAPER_A.encode()
    rag = Retrieval(spark, "stream", str(tmp_path / "store"), rerank_mode="off")
    run = lambda: ingest.ingest_stream(rag, ingest.incoming(rag, str(inbox)), str(tmp_path / "check")).awaitTermination(120)
    run()
    assert rag.doc_ids() == {"a.md"}
    (inbox / "b.md").write_text(PAPER_B)
    run()
    assert rag.doc_ids() == {"a.md", "b.md"} and rag.count() == 4


def test_stream_events():
    events = list(providers.Offline().stream("Sources:\n[S1]\n\nQuestion: x"))
    assert [k for k, _ in events].count("usage") == 1 and events[-1][0] == "usage" and "".join(x for k, x in events if k == "delta") == events[-1][1].text


def test_catalogue_has_an_oracle_for_each_query():
    from heronry.plans import catalogue

    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"hashed_embedding", "pass_at_k"}
    assert F.lit(1) is not None


def test_store_writers_and_readers(spark, tmp_path):
    import pytest

    from heronry.sources.corpus import WriteConflict

    rows = lambda *r: spark.createDataFrame(r, "chunk_id string, doc_id string, text string")
    store = Store(spark, "shared", str(tmp_path))
    store.add(rows(*((f"d{k}::0", f"d{k}", "old") for k in range(40))))
    before, folders = store._number(), store._folders(store._number())
    store.add(rows(("d3::0", "d3", "new")))
    after = store._folders(store._number())
    assert sum(after[b] != folders[b] for b in folders) == 1 and after.keys() == folders.keys()  # one bucket is rewritten
    assert store.count() == 40 and store.get("d3::0").first().text == "new"
    with pytest.raises(WriteConflict):  # a writer that began before that
        store._publish(folders, before)
    assert store.get("d3::0").first().text == "new"
    number = store._number()
    (tmp_path / store.root.rsplit("/", 1)[1] / f"CURRENT.{number + 1}").touch()  # a writer that died, or hasn't written yet
    assert store._number() == number and store.count() == 40
    with pytest.raises(WriteConflict):
        store.reset()
    store.vacuum()
    store.reset()
    assert store.count() == 0


def test_facade_knobs(spark, tmp_path):
    from pyspark.sql import functions as F

    rag = Retrieval(spark, "knobs", str(tmp_path), rerank_mode="llm")
    rag.ingest(spark.createDataFrame([("a.md", PAPER_A), ("b.md", PAPER_B)], "doc_id string, markdown string"))
    stages = lambda df: {r.stage: r["count"] for r in df.groupBy("stage").count().collect()}
    got = stages(rag.search_trace("metres of ice in a year", k=2, dense_k=3, bm25_k=1, rerank_pool=3))
    assert got["dense"] == 3 and got["bm25"] == 1 and got["reranked"] == 3 and got["final"] == 2
    assert stages(rag.search_trace("metres of ice in a year", k=2, rerank_top_k=1))["final"] == 1
    mine = rag.store.records().limit(1).select(F.lit("q").alias("query_id"), F.col("chunk_id").alias("id"), F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    assert stages(rag.search_trace("metres", k=2, extra={"mine": mine}))["mine"] == 1
    out, took = rag.timed_trace("metres of ice in a year", k=2)
    assert stages(out)["final"] == 2 and set(took) == {"embed", "dense", "bm25", "fusion_rerank"} and all(x > 0 for x in took.values())


def test_pdf_pages_by_a_stand_in():
    import types

    import pytest

    from heronry.sources import pdf

    class Page:
        images = []

        def extract_text(self):
            return "Some text."

    good = types.SimpleNamespace(PdfReader=lambda held: types.SimpleNamespace(pages=[Page(), Page()]))
    assert [p[:3] for p in pdf.read_pages(b"x", good)] == [(1, "Some text.", False), (2, "Some text.", False)]

    def broken(held):
        raise RuntimeError("no")

    with pytest.raises(documents.ParseError):
        pdf.read_pages(b"x", types.SimpleNamespace(PdfReader=broken))


def test_exact_counts():
    import pickle

    from heronry.functions.tokens import ExactCounter

    count = pickle.loads(pickle.dumps(ExactCounter("/opt/tokenizers/byte_bpe_50k.tiktoken")))
    assert count("") == 0 and 1 <= count("hello world") <= 11
    assert ExactCounter("/nowhere")("four" * 4) == 4
