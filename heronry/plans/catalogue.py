"""The catalogue: each operator as a query over whole tables, with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.operators import answer, evaluate, fusion, lexical, pagetext, rerank, segment, situate
from heronry.sources import documents as sources
from heronry.sources.corpus import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chunks: a turn is a chunk under its role."""
    c = _read(spark, sf_dir, "conversations")
    index = (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")
    text = F.coalesce("text", F.lit(""))
    return c.select(F.col("conv_id").alias("doc_id"), index.alias("index"), text.alias("text"), F.array("role").alias("header_path"), "role", "turn", T.token_count(text).alias("token_count"))


class _Template(str):
    """SQL with @ where an expression goes."""

    def of(self, expression: str) -> str:
        return self.replace("@", expression)


_TOK = _Template(r"regexp_extract_all(lower(coalesce(@, '')), '[\p{L}\p{N}_]+')")
_COUNT = _Template("(CASE WHEN coalesce(length(@), 0) = 0 THEN 0 ELSE greatest(1, round_even(length(@) / 4.0, 0)) END)::BIGINT")
_SPACES = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v"
_STRIP = _Template(f"regexp_replace(@, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')")
_SENTENCES = _Template(r"list_filter(string_split(regexp_replace(@, '([.!?])[\s\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[^" + _SPACES + r"]'))")


# --- text


@query(f"SELECT doc_id, {_COUNT.of('text')} AS n_tokens FROM documents")
def token_count_heuristic(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(f"SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({_TOK.of('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_tf(spark, sf_dir):
    return lexical.term_frequencies(_docs(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, len({_TOK.of('text')})::BIGINT AS dl FROM documents")
def doc_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("dl"))


@query(f"SELECT count(*)::BIGINT AS n, round(avg(len({_TOK.of('text')})), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return lexical.build(_records(spark, sf_dir)).totals.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOK.of('text')}) AS term FROM documents) SELECT term, count(*)::BIGINT AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term")
def df_idf(spark, sf_dir):
    index = lexical.build(_records(spark, sf_dir))
    return index.terms.join(index.total(), "scope").select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"SELECT doc_id, (ord - 1)::BIGINT AS ord, sentence FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS ord FROM (SELECT doc_id, {_SENTENCES.of('text')} AS s FROM documents WHERE text IS NOT NULL))")
def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ord", "sentence")).withColumn("ord", F.col("ord").cast("long"))


_PIECES = f"""
s0 AS (SELECT doc_id, {_SENTENCES.of("text")} AS s FROM docs0),
s AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(0, len(s))) AS ord FROM s0),
z AS (SELECT *, {_COUNT.of("sentence")} AS size FROM s),
walk(doc_id, ord, grp, used) AS (
  SELECT doc_id, ord, 0, CASE WHEN size > TARGET THEN TARGET + 1 ELSE size END FROM z WHERE ord = 0
  UNION ALL
  SELECT z.doc_id, z.ord, CASE WHEN z.size > TARGET OR used + z.size > TARGET THEN grp + 1 ELSE grp END, CASE WHEN z.size > TARGET THEN TARGET + 1 WHEN used + z.size > TARGET THEN z.size ELSE used + z.size END
  FROM walk JOIN z ON z.doc_id = walk.doc_id AND z.ord = walk.ord + 1),
g AS (SELECT z.doc_id, grp, string_agg(sentence, ' ' ORDER BY z.ord) AS run, max(size) AS biggest, max(length(sentence)) AS n FROM walk JOIN z USING (doc_id, ord) GROUP BY z.doc_id, grp),
cut AS (SELECT doc_id, grp, 0 AS part, run AS text FROM g WHERE biggest <= TARGET
  UNION ALL
  SELECT doc_id, grp, part, substr(run, part * step + 1, step) AS text FROM (SELECT doc_id, grp, run, step, unnest(range(0, ((length(run) - 1) // step + 1)::BIGINT)) AS part FROM (SELECT *, greatest(1, floor(length(run) / greatest(1, biggest)::DOUBLE * TARGET))::BIGINT AS step FROM g WHERE biggest > TARGET))),
pieces AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp, part) - 1)::BIGINT AS piece, text FROM cut)
"""


@query("WITH RECURSIVE docs0 AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)," + _PIECES.replace("TARGET", "128") + "SELECT * FROM pieces")
def sentence_pack(spark, sf_dir):
    return segment.sentence_packs(_docs(spark, sf_dir), 128)


@query(f"SELECT doc_id, (part)::BIGINT AS piece, substr(text, part * step + 1, step) AS slice FROM (SELECT *, unnest(range(0, ((length(text) - 1) // step + 1)::BIGINT)) AS part FROM (SELECT doc_id, text, greatest(1, floor(length(text) / greatest(1, {_COUNT.of('text')})::DOUBLE * 128))::BIGINT AS step FROM documents WHERE length(text) > 0))")
def hard_split(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.length("text") > 0).select("doc_id", F.posexplode(T.hard_split(F.col("text"), 128)).alias("piece", "slice")).withColumn("piece", F.col("piece").cast("long"))


@query(r"SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0::DOUBLE ELSE round(length(regexp_replace(text, '[^\p{L}\s\v]', '', 'g')) / length(text)::DOUBLE, 6) END AS legibility FROM documents")
def legibility(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.legibility(F.col("text")), 6).alias("legibility"))


_CLEAN = _Template(r"(length(@) >= 200 AND length(regexp_replace(@, '[^\p{L}\s\v]', '', 'g')) / greatest(1, length(@))::DOUBLE >= 0.85 AND NOT regexp_matches(@, '[∑∫√≤≥≠±×÷∞∂∇°·]|\\[a-zA-Z]+|\$|\^\{|_\{'))")


@query("SELECT doc_id, CASE WHEN " + _CLEAN.of(_STRIP.of("coalesce(text, '')")) + " THEN 'text' ELSE 'vision' END AS route FROM documents")
def clean_prose_route(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", pagetext.route(F.col("text"), F.lit(False)).alias("route"))


_LINES = r"string_split(regexp_replace(coalesce(text, ''), '\r\n|[\n\v\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10))"
_HEADING = r"""(s <> '' AND length(s) <= 64 AND len(list_filter(regexp_split_to_array(s, '[\s\v]+'), lambda w: w <> '')) <= 9 AND NOT regexp_matches(s, '^([-*+]|\d+[.)])[\s\v]')
  AND NOT regexp_matches(s, '^[^\p{L}\p{N}]*\p{Ll}') AND NOT regexp_matches(regexp_replace(s, '["''”’»)\]}]+$', ''), '[.!?,;:]$') AND length(regexp_replace(s, '[^\p{L}]', '', 'g')) * 2 >= length(s))"""
_MARKED = f"""l0 AS (SELECT doc_id, {_LINES} AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS raw FROM l0),
l2 AS (SELECT doc_id, line_no, {_STRIP.of("raw")} AS s FROM l1),
l3 AS (SELECT *, {_HEADING} AS title FROM l2)"""


@query(f"WITH {_MARKED} SELECT doc_id, line_no::BIGINT AS line_no, s AS line FROM l3 WHERE title")
def heading_like_lines(spark, sf_dir):
    lines = pagetext.lines(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))
    return lines.where(T.heading_like(F.col("line"))).select(F.col("id").alias("doc_id"), "line_no", "line")


@query(f"""WITH {_MARKED},
l4 AS (SELECT *, (title OR s = '') AS stop FROM l3),
l5 AS (SELECT *, stop OR coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS begins FROM l4),
l6 AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM l5),
b AS (SELECT doc_id, part, string_agg(s, ' ' ORDER BY line_no) AS t, bool_or(title) AS title FROM l6 WHERE s <> '' GROUP BY ALL)
SELECT doc_id, coalesce(md, '') AS markdown FROM documents LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN title THEN '# ' || t ELSE t END, chr(10) || chr(10) ORDER BY part) AS md FROM b GROUP BY doc_id) USING (doc_id)""")
def textlayer_to_markdown(spark, sf_dir):
    return pagetext.to_markdown(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("doc_id"), "markdown")


# --- retrieval

_BM25 = f"""
tok AS (SELECT doc_id, source, unnest({_TOK.of("text")}) AS term FROM documents),
dl AS (SELECT doc_id, source, len({_TOK.of("text")})::DOUBLE AS dl FROM documents),
tf AS (SELECT doc_id, source, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
qf AS (SELECT query_id, term, count(*)::DOUBLE AS qf FROM (SELECT item_id AS query_id, unnest({_TOK.of("text")}) AS term FROM benchmark) GROUP BY ALL)
"""
_PART = "qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END))"
_RANKED = f"""{_BM25},
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id AS id, round(sum({_PART}), 4) AS score FROM qf JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sc WHERE score > 0)
"""


@query(f"WITH {_RANKED} SELECT query_id, id, score, rank::BIGINT AS rank FROM bm WHERE rank < 50")
def bm25_topk(spark, sf_dir):
    return lexical.search(lexical.build(_records(spark, sf_dir)), _questions(spark, sf_dir))


@query(f"""WITH {_BM25},
st AS (SELECT source, count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl GROUP BY source),
df AS (SELECT source, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id || ':' || source AS query_id, doc_id AS id, round(sum({_PART}), 4) AS score FROM qf JOIN df USING (term) JOIN tf USING (source, term) JOIN dl USING (source, doc_id) JOIN st USING (source) GROUP BY ALL)
SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::BIGINT AS rank FROM sc WHERE score > 0 QUALIFY rank < 10""")
def bm25_scoped_by_source(spark, sf_dir):
    records = _records(spark, sf_dir)
    scopes = records.select(F.col("source").alias("scope")).distinct()
    asked = _questions(spark, sf_dir).crossJoin(F.broadcast(scopes)).select(F.concat_ws(":", F.col("query_id").cast("string"), "scope").alias("query_id"), "scope", "query")
    return lexical.search(lexical.build(records, F.col("source")), asked, 10)


def _vectors(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), "embedding"), e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("vector"))


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4)"


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score, (row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) - 1)::BIGINT AS rank FROM embeddings a, embeddings b QUALIFY rank < 50")
def dense_topk(spark, sf_dir):
    return fusion.dense(*_vectors(spark, sf_dir))


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score, (row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) - 1)::BIGINT AS rank FROM embeddings a JOIN embeddings b USING (label) QUALIFY rank < 10")
def dense_scoped_by_label(spark, sf_dir):
    return fusion.dense(*_vectors(spark, sf_dir), k=10, scoped=True)


@query()
def hashed_embedding(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.hashed_vector(F.col("text")).alias("embedding"))


def _hybrid(spark, sf_dir, **how):
    records = _records(spark, sf_dir)
    asked = _questions(spark, sf_dir).withColumn("vector", T.hashed_vector(F.col("query"), hashed="md5"))
    return fusion.hybrid(fusion.hashed(records), lexical.build(records), asked, **how)


_SLOT = "('0x' || substr(md5(term), 1, 8))::BIGINT % 128"
_FUSED = f"""{_RANKED},
ds AS (SELECT DISTINCT doc_id, {_SLOT} AS slot FROM tok UNION ALL SELECT doc_id, unnest(range(0, 128)) FROM dl WHERE dl = 0),
qs AS (SELECT DISTINCT query_id, {_SLOT} AS slot FROM qf),
dn AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY ALL), qn AS (SELECT query_id, count(*) AS m FROM qs GROUP BY ALL),
ov AS (SELECT query_id, doc_id, count(*) AS c FROM qs JOIN ds USING (slot) GROUP BY ALL),
de AS (SELECT query_id, doc_id AS id, round(coalesce(c, 0) / (sqrt(m::DOUBLE) * sqrt(n::DOUBLE)), 4) AS score FROM qn CROSS JOIN dn LEFT JOIN ov USING (query_id, doc_id)),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM de QUALIFY rank < 50),
b50 AS (SELECT * FROM bm WHERE rank < 50),
fu AS (SELECT query_id, id, round(coalesce(1 / (60 + d.rank + 1)::DOUBLE, 0) + coalesce(1 / (60 + b.rank + 1)::DOUBLE, 0), 5) AS rrf, d.score AS dense, b.score AS bm25, d.rank AS drank, b.rank AS brank FROM dr d FULL JOIN b50 b USING (query_id, id)),
fr AS (SELECT query_id, id, rrf, dense, bm25, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, drank ASC NULLS LAST, brank ASC NULLS LAST, id) - 1 AS rank FROM fu)
"""
_NO = "NULL::DOUBLE"


@query(f"WITH {_FUSED} SELECT query_id, id, rrf, dense, bm25, rank::BIGINT AS rank FROM fr")
def rrf_fuse(spark, sf_dir):
    hits = _hybrid(spark, sf_dir).where("stage = 'fused'")
    return hits.select("query_id", "id", "rrf", "dense", "bm25", "rank")


_TRACE = f"""SELECT query_id, 'dense' AS stage, rank::BIGINT AS rank, id, score, score AS dense, {_NO} AS bm25, {_NO} AS rrf, {_NO} AS rerank FROM dr
UNION ALL SELECT query_id, 'bm25', rank::BIGINT, id, score, {_NO}, score, {_NO}, {_NO} FROM b50
UNION ALL SELECT query_id, 'fused', rank::BIGINT, id, rrf, dense, bm25, rrf, {_NO} FROM fr
UNION ALL SELECT query_id, 'final', rank::BIGINT, id, rrf, dense, bm25, rrf, {_NO} FROM fr WHERE rank < 8"""


@query(f"WITH {_FUSED} {_TRACE}")
def hybrid_trace_long(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(f"WITH {_FUSED} SELECT query_id, rank::BIGINT AS rank, id, rrf AS score FROM fr WHERE rank < 8")
def hybrid_final(spark, sf_dir):
    return _hybrid(spark, sf_dir).where("stage = 'final'").select("query_id", "rank", "id", "score")


def _pool(spark, sf_dir):
    hits = lexical.search(lexical.build(_records(spark, sf_dir)), _questions(spark, sf_dir), fusion.POOL)
    return hits.select("query_id", "id", F.col("score").alias("bm25"), "rank")


#: hits that are broadcast to texts, at most
_HITS = 1_000_000


def _to_texts(hits: DataFrame, asked: DataFrame, k: int, most: int = _HITS) -> DataFrame:
    """hits, of which each question has k at most, as they are joined with texts: these stay where they are read while hits are few."""
    return F.broadcast(hits) if asked.limit(most // k + 1).count() * k <= most else hits


@query(f"WITH {_RANKED} SELECT query_id, string_agg('[' || rank || '] ' || substr(text, 1, 350), chr(10) ORDER BY rank) AS listing FROM bm JOIN documents ON doc_id = id WHERE rank < 30 GROUP BY query_id")
def rerank_listing(spark, sf_dir):
    texts = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.substring("text", 1, rerank.SNIPPET).alias("embed_text"))
    return rerank.listings(_to_texts(_pool(spark, sf_dir), _questions(spark, sf_dir), fusion.POOL).join(texts, "id"))


@query(f"""WITH {_RANKED},
m0 AS (SELECT query_id, unnest([query_id % 40, 3, 99, 3, query_id % 7, 0]) AS rank, unnest(range(0, 6)) AS pos FROM (SELECT DISTINCT query_id FROM qf)),
m AS (SELECT query_id, rank, min(pos) AS pos FROM m0 GROUP BY ALL),
o AS (SELECT bm.query_id, id, score AS bm25, pos, row_number() OVER (PARTITION BY bm.query_id ORDER BY pos ASC NULLS LAST, bm.rank) AS place FROM bm LEFT JOIN m USING (query_id, rank) WHERE bm.rank < 30)
SELECT query_id, id, bm25, (place - 1)::BIGINT AS rank, CASE WHEN pos IS NOT NULL THEN round(1 / place::DOUBLE, 4) END AS rerank FROM o""")
def rerank_apply_order(spark, sf_dir):
    reply = F.concat_ws(", ", (F.col("query_id") % 40).cast("string"), F.lit("3, 99, 3"), (F.col("query_id") % 7).cast("string"), F.lit("0"))
    return rerank.by_reply(_pool(spark, sf_dir), _questions(spark, sf_dir).select("query_id", reply.alias("reply")))


@query(f"""WITH {_RANKED},
m0 AS (SELECT query_id, unnest([2, query_id % 30, 99, -1, 0]) AS rank, unnest([0.9, 0.8, 0.75, 0.7, 0.1]::DOUBLE[]) AS rel, unnest(range(0, 5)) AS pos FROM (SELECT DISTINCT query_id FROM qf)),
m AS (SELECT query_id, rank, min(pos) AS pos, round(arg_max(rel, m0.pos), 4) AS rerank FROM m0 GROUP BY ALL),
o AS (SELECT bm.query_id, id, score AS bm25, rerank, row_number() OVER (PARTITION BY bm.query_id ORDER BY pos ASC NULLS LAST, bm.rank) AS place FROM bm LEFT JOIN m USING (query_id, rank) WHERE bm.rank < 30)
SELECT query_id, id, bm25, (place - 1)::BIGINT AS rank, rerank FROM o""")
def rerank_endpoint_apply(spark, sf_dir):
    response = F.format_string('{"results":[{"index":2,"relevance_score":0.9},{"index":%d,"relevance_score":0.8},{"index":99,"relevance_score":0.75},{"index":-1,"relevance_score":0.7},{"index":0,"relevance_score":0.1}]}', F.col("query_id") % 30)
    return rerank.by_endpoint(_pool(spark, sf_dir), _questions(spark, sf_dir).select("query_id", response.alias("response")))


@query(f"WITH {_RANKED} SELECT query_id, count(*)::BIGINT AS candidates, count(*) > 40 AS rerank FROM bm WHERE rank < 50 GROUP BY query_id")
def rerank_gate(spark, sf_dir):
    return fusion.gate(bm25_topk(spark, sf_dir), 40, "llm")


# --- chunks and context


_TAIL = r"string_split(regexp_replace(body, '([.!?])[\s\v]+', '\1' || chr(1), 'g'), chr(1))"
_CHUNKS = f"""docs0 AS (SELECT doc_id, trim(text, chr(10)) AS text FROM documents WHERE {_STRIP.of("coalesce(text, '')")} <> ''),
{_PIECES.replace("TARGET", "512").replace("docs0", "long0")},
long0 AS (SELECT * FROM docs0 WHERE {_COUNT.of("text")} > 512),
every AS (SELECT doc_id, 0 AS piece, text FROM docs0 WHERE {_COUNT.of("text")} <= 512 UNION ALL SELECT * FROM pieces),
c0 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM every),
c1 AS (SELECT *, {_COUNT.of("text")} AS k, lead({_COUNT.of("text")}) OVER w AS k2, lead(text) OVER w AS text2 FROM c0 WINDOW w AS (PARTITION BY doc_id ORDER BY piece)),
c2 AS (SELECT doc_id, piece, n, CASE WHEN piece = n - 2 AND k2 < 64 THEN text || chr(10) || chr(10) || text2 ELSE text END AS body FROM c1 WHERE NOT (n > 1 AND piece = n - 1 AND k < 64)),
t0 AS (SELECT doc_id, piece, body, {_TAIL} AS parts FROM c2),
t1 AS (SELECT doc_id, piece, body, parts, list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], ' ')) AS tails FROM t0),
t2 AS (SELECT doc_id, piece, body, coalesce(list_last(list_filter(tails, lambda x: {_COUNT.of("x")} >= 64)), tails[1]) AS tail FROM t1),
t3 AS (SELECT *, {_STRIP.of("lag(tail) OVER (PARTITION BY doc_id ORDER BY piece)")} AS carried FROM t2),
t4 AS (SELECT doc_id, piece, carried, CASE WHEN coalesce(carried, '') <> '' THEN carried || chr(10) || chr(10) || body ELSE body END AS text FROM t3)
"""
# long0 has to come before the pieces that read it
_CHUNKS = _CHUNKS.replace(f"long0 AS (SELECT * FROM docs0 WHERE {_COUNT.of('text')} > 512),\n", "").replace("\ns0 AS", f"\nlong0 AS (SELECT * FROM docs0 WHERE {_COUNT.of('text')} > 512),\ns0 AS", 1)


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, piece::BIGINT AS index, {_COUNT.of('text')} AS token_count, length(text)::BIGINT AS char_count, {_COUNT.of('carried')} AS overlap_tokens, md5(text) AS text_md5 FROM t4")
def chunk_plain_docs(spark, sf_dir):
    chunks = segment.chunk(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("markdown")))
    return chunks.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in ("index", "token_count", "char_count", "overlap_tokens")), F.md5("text").alias("text_md5"))


_LEVELS = "h AS (SELECT conv_id AS doc_id, turn AS ord, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, role || ' ' || turn AS title FROM conversations)"


@query(f"""WITH {_LEVELS},
p AS (SELECT i.doc_id, i.ord, j.ord AS o, j.title FROM h i JOIN h j ON i.doc_id = j.doc_id AND j.ord <= i.ord WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.doc_id = i.doc_id AND k.ord > j.ord AND k.ord <= i.ord AND k.level <= j.level))
SELECT doc_id, ord, string_agg(title, ' › ' ORDER BY o) AS section FROM p GROUP BY ALL""")
def heading_path(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    paths = segment.heading_paths(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), level.alias("level"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title")))
    return paths.select("doc_id", "ord", T.section(F.col("path")).alias("section"))


_PAGES = "p0 AS (SELECT conv_id AS doc_id, turn AS page, coalesce(length(text), 0) AS n FROM conversations), p AS (SELECT doc_id, page, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, n FROM p0)"


@query(f"""WITH {_PAGES}, t AS (SELECT doc_id, max(lo + n) AS total FROM p GROUP BY doc_id),
b AS (SELECT doc_id, unnest(range(0, (total // 300 + 1)::BIGINT)) AS block FROM t)
SELECT b.doc_id, block, string_agg(page::VARCHAR, '-' ORDER BY page) AS pages FROM b JOIN p ON b.doc_id = p.doc_id AND block * 300 < lo + n AND (block + 1) * 300 > lo GROUP BY ALL""")
def page_overlap_join(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    before = F.sum(F.col("n") + 2).over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    pages = c.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("end", F.col("start") + F.col("n"))
    blocks = pages.groupBy("doc_id").agg(F.max("end").alias("total")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("total div 300"))).alias("block")).withColumn("start", F.col("block") * 300).withColumn("end", F.col("start") + 300)
    met = segment.pages_of(blocks, pages)
    return met.select("doc_id", "block", F.array_join(F.transform("pages", lambda p: p.cast("string")), "-").alias("pages"))


@query("SELECT conv_id AS doc_id, turn, CASE WHEN role <> 'user' THEN role || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS embed_text FROM conversations")
def embed_text(spark, sf_dir):
    context = F.when(F.col("role") != "user", F.col("role")).otherwise("")
    return _turns(spark, sf_dir).select("doc_id", "turn", T.embed_text(context, F.col("text")).alias("embed_text"))


_RAW = "CASE turn % 4 WHEN 0 THEN '```' || text || '```' WHEN 1 THEN ' \"Context: ' || text || '\" ' WHEN 2 THEN 'Here is the succinct context for it: ' || text ELSE text END"


@query(f"""WITH a AS (SELECT conv_id, turn, {_STRIP.of(f"coalesce({_RAW}, '')")} AS t FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '```') AND ends_with(t, '```') THEN {_STRIP.of("substr(t, 4, greatest(0, length(t) - 6))")} ELSE t END AS t FROM a),
c AS (SELECT conv_id, turn, CASE WHEN length(t) >= 2 AND t[1] IN ('"', '''', '`') AND t[1] = t[-1] THEN {_STRIP.of("substr(t, 2, length(t) - 2)")} ELSE t END AS t FROM b)
SELECT conv_id AS doc_id, turn, {_STRIP.of(f"regexp_replace(t, '{T.LEAD_IN}', '')")} AS context FROM c""")
def clean_context(spark, sf_dir):
    raw = F.expr(_RAW.replace('\\"', '"'))
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", T.clean_context(raw).alias("context"))


_HEAD, _MARGIN, _SPAN = 60, 40, 150
_SIZED = f"""t AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, role, coalesce(text, '') AS text, {_COUNT.of("text")} AS tok FROM conversations),
u AS (SELECT *, sum(tok) OVER (PARTITION BY doc_id ORDER BY index) AS upto, count(*) OVER (PARTITION BY doc_id) AS n FROM t),
h AS (SELECT doc_id, coalesce(min(CASE WHEN upto >= {_HEAD} THEN index + 1 END), max(n)) AS head_end, max(n) AS n FROM u GROUP BY doc_id),
walk(doc_id, index, start, used, role) AS (SELECT doc_id, index, 0::BIGINT, tok::HUGEINT, role FROM t WHERE index = 0
  UNION ALL SELECT t.doc_id, t.index, CASE WHEN used + t.tok > {_SPAN} OR (t.role <> walk.role AND used >= {_SPAN // 2}) THEN t.index ELSE start END, CASE WHEN used + t.tok > {_SPAN} OR (t.role <> walk.role AND used >= {_SPAN // 2}) THEN t.tok ELSE used + t.tok END, t.role
  FROM walk JOIN t ON t.doc_id = walk.doc_id AND t.index = walk.index + 1),
r AS (SELECT doc_id, start, max(index) + 1 AS "end" FROM walk GROUP BY ALL),
p AS (SELECT doc_id, 0 AS j, 0 AS p FROM h UNION ALL SELECT doc_id, index + 1, upto FROM u),
x AS (SELECT r.doc_id, start, "end", head_end, n, greatest(head_end, start) AS lo0, greatest(head_end, "end") AS hi0 FROM r JOIN h USING (doc_id)),
e AS (SELECT doc_id, start, "end", head_end,
  coalesce((SELECT max(a.j) FROM p a, p b WHERE a.doc_id = x.doc_id AND b.doc_id = x.doc_id AND b.j = lo0 AND a.j BETWEEN head_end AND lo0 AND b.p - a.p >= {_MARGIN}), head_end) AS lo,
  coalesce((SELECT min(a.j) FROM p a, p b WHERE a.doc_id = x.doc_id AND b.doc_id = x.doc_id AND b.j = hi0 AND a.j BETWEEN hi0 AND n AND a.p - b.p >= {_MARGIN}), n) AS hi FROM x),
ex AS (SELECT e.doc_id, start, "end", array_to_string(list_concat(list_concat((SELECT coalesce(list(text ORDER BY index), []) FROM t WHERE t.doc_id = e.doc_id AND index < head_end), CASE WHEN lo > head_end THEN ['[…]'] ELSE [] END), (SELECT coalesce(list(text ORDER BY index), []) FROM t WHERE t.doc_id = e.doc_id AND index >= lo AND index < hi)), chr(10) || chr(10)) AS excerpt FROM e)"""


@query(f"WITH RECURSIVE {_SIZED} SELECT doc_id, head_end::BIGINT AS head_end FROM h")
def head_end(spark, sf_dir):
    return situate.head_ends(_turns(spark, sf_dir), _HEAD)


@query(f'WITH RECURSIVE {_SIZED} SELECT doc_id, start, "end"::BIGINT AS "end" FROM r')
def batch_ranges(spark, sf_dir):
    return situate.batch_ranges(_turns(spark, sf_dir), _SPAN)


def _bounds(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return turns, situate.excerpt_bounds(turns, situate.batch_ranges(turns, _SPAN), _HEAD, _MARGIN)


@query(f'WITH RECURSIVE {_SIZED} SELECT doc_id, start, "end"::BIGINT AS "end", head_end::BIGINT AS head_end, lo::BIGINT AS lo, hi::BIGINT AS hi FROM e')
def excerpt_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir)[1]


@query(f'WITH RECURSIVE {_SIZED} SELECT doc_id, start, "end"::BIGINT AS "end", excerpt FROM ex')
def excerpt_text(spark, sf_dir):
    return situate.excerpts(*_bounds(spark, sf_dir))


@query(f"SELECT conv_id AS doc_id, turn, '<document>' || chr(10) || string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || chr(10) || '</document>' || chr(10) || chr(10) || 'One part of it:' || chr(10) || '<chunk>' || chr(10) || coalesce(text, '') || chr(10) || '</chunk>' || chr(10) || chr(10) || 'Say in one or two sentences where this part belongs in the document, so that a search finds it. Reply with these sentences only.' AS prompt FROM conversations")
def situate_prompt(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    docs = turns.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("document"))
    return turns.join(docs, "doc_id").select("doc_id", "turn", situate.whole_prompt(F.col("document"), F.col("text")).alias("prompt"))


@query(f"""WITH p AS (SELECT conv_id AS doc_id, turn, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
SELECT doc_id, count(*)::BIGINT AS calls, sum(chars // 4)::BIGINT AS prompt_tokens, sum(CASE WHEN nth > 1 THEN floor(0.8 * chars)::BIGINT // 4 ELSE 0 END)::BIGINT AS cached_tokens FROM p GROUP BY doc_id""")
def prefix_group_cache_accounting(spark, sf_dir):
    chars = F.sum(F.length("text").cast("long")).over(W.partitionBy("doc_id"))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("turn")) == 1
    calls = _turns(spark, sf_dir).withColumn("chars", chars).withColumn("first", first)
    return calls.groupBy("doc_id").agg(F.count("*").alias("calls"), F.sum(F.expr("chars div 4")).alias("prompt_tokens"), F.sum(F.when(~F.col("first"), F.expr("cast(floor(0.8 * chars) as bigint) div 4")).otherwise(0)).alias("cached_tokens"))


@query(f"SELECT doc_id, CASE WHEN {_COUNT.of('text')} <= 1000 THEN 'whole' ELSE 'excerpt' END AS mode FROM documents")
def mode_switch(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", situate.document_mode(F.col("text"), 1000).alias("mode"))


# --- store, answers, evaluation


def _store(spark: SparkSession, rows: DataFrame) -> Store:
    """A collection of rows, in the folder that executors share, until the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="heronry-store-")
    store = Store(spark, uuid.uuid4().hex, f"{base}/collections")
    store.add(rows)
    store.delete_on_exit()
    return store


@query("SELECT doc_id::VARCHAR AS doc_id, text, '' AS context FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT doc_id::VARCHAR, 'quality ' || max(quality), '' FROM labels GROUP BY doc_id")
def upsert_merge(spark, sf_dir):
    store = _store(spark, _docs(spark, sf_dir).select("doc_id", "text"))
    store.add(_read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.concat(F.lit("quality "), F.max("quality").cast("string")).alias("text")))
    return store.records().select("doc_id", "text", "context")


@query("SELECT DISTINCT source FROM documents")
def doc_ids_distinct(spark, sf_dir):
    return _store(spark, _docs(spark, sf_dir).select(F.col("source").alias("doc_id"), "text")).doc_ids().select(F.col("doc_id").alias("source"))


@query("SELECT count(*)::BIGINT AS n FROM documents")
def store_count(spark, sf_dir):
    return spark.createDataFrame([(_store(spark, _docs(spark, sf_dir).select("doc_id", "text")).count(),)], "n long")


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source")
def collection_count(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    store = _store(spark, _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text"))
    return store.get("7").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti_join(spark, sf_dir):
    done = _store(spark, _read(spark, sf_dir, "labels").select("doc_id", F.lit("done").alias("text")))
    left = done.missing(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "n_chars"))
    return left.select(F.col("doc_id").cast("long").alias("doc_id"), "n_chars")


@query(r"""WITH a AS (SELECT DISTINCT url, regexp_replace(regexp_replace('domain_' || url, '[^a-zA-Z0-9._-]', '_', 'g'), '\.\.+', '_', 'g') AS safe FROM pages)
SELECT url, CASE WHEN safe <> 'domain_' || url OR NOT regexp_matches(safe, '[a-zA-Z0-9]$') THEN regexp_replace(substr(safe, 1, 494), '[._-]+$', '') || '_' || substr(sha256(url), 1, 8) ELSE substr(safe, 1, 512) END AS name FROM a""")
def collection_name(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("url").distinct().select("url", T.collection_name(F.col("url")).alias("name"))


@query("SELECT conv_id AS doc_id, 'conv ' || conv_id || ', p.' || string_agg(turn::VARCHAR, '-' ORDER BY turn) AS citation FROM conversations GROUP BY conv_id")
def citation(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list("turn")).alias("pages"))
    return c.select("doc_id", T.citation(F.concat(F.lit("conv "), F.col("doc_id").cast("string")), F.col("pages")).alias("citation"))


@query(f"""WITH {_RANKED}, s AS (SELECT query_id, string_agg('[S' || (rank + 1) || '] (source: ' || id || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS blocks FROM bm JOIN documents ON doc_id = id WHERE rank < 6 GROUP BY query_id)
SELECT item_id AS query_id, '{answer.RULES.replace("'", "''")}' || chr(10) || chr(10) || 'Sources:' || chr(10) || blocks || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM benchmark LEFT JOIN s ON query_id = item_id""")
def answer_prompt(spark, sf_dir):
    asked = _questions(spark, sf_dir)
    hits = _to_texts(_pool(spark, sf_dir).where("rank < 6"), asked, 6)
    chunks = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.array().cast("array<int>").alias("pages"), "text")
    return answer.prompts(asked, answer.sources(hits, chunks)).select("query_id", "prompt")


@query(f"SELECT conv_id AS doc_id, count(*)::BIGINT AS chunks, sum({_COUNT.of('text')} + 12)::BIGINT AS context_tokens, sum({_COUNT.of('text')} // 2)::BIGINT AS cached_tokens, bool_or(role = 'system') AS excerpted FROM conversations GROUP BY conv_id")
def ingest_report(spark, sf_dir):
    t = _turns(spark, sf_dir).select("doc_id", F.col("token_count").alias("prompt_tokens"), F.lit(12).alias("completion_tokens"), F.expr("token_count div 2").alias("cached_tokens"), (F.col("role") == "system").alias("excerpted"))
    return situate.report(t)


@query()
def pass_at_k(spark, sf_dir):
    """Over generated reports: it doesn't read the tables."""
    chunks = segment.chunk(sources.synthetic_reports(spark), target=60, overlap_tokens=0, min_tokens=0)
    asked = sources.synthetic_questions(spark)
    hits = lexical.search(lexical.build(chunks.select(F.col("chunk_id").alias("id"), F.concat_ws("\n\n", F.col("doc_id"), "text").alias("text"))), asked)
    return evaluate.pass_at_k(hits, evaluate.gold_chunks(asked, chunks), asked)
