"""Mixing sources to target weights by temperature.

A source's share p of all tokens becomes the weight p ** a / sum(p ** a). The exponent a, from 0 (all
sources alike) to 1 (as they are), is found by bisection to a grid of 1e-6: the smallest a at which no
source is repeated more than max_repeats times within the budget, or, if target_entropy is given (a
fraction of the largest entropy, log of the number of sources), the largest a that reaches it. The
weights split the budget of tokens. A source's documents are taken in seeded permutations, a new one
each epoch: all of them in budget // tokens epochs, and of one more epoch the longest beginning of its
permutation that fits what is left. All chosen documents are spread over blocks of about BLOCK_TOKENS
in which every source has its weight, and permuted inside each block.

Tokens of a text: a quarter of its characters, half to even, 1 at least, 0 for an empty one.

Plan. The narrow table (doc_id, source, n_tokens) is written once. Where a permutation ends is found
without sorting a source: tokens are summed by 4,096 ranges of the permutation key, and only the range
in which the budget runs out is ordered. Which documents are chosen is then a comparison of their key
with a bound of their source, so texts are never shuffled, and a hot source is no hot task.

Cases: null and empty texts have no tokens and are never chosen. A null source is a source. A null
doc_id has its own place in the permutation; documents of equal doc_id share one and are chosen or left
together. Other columns are ignored by mix() and carried along by mixed(), the pipeline's stage, which uses
the budgets only: its rows have no block, place or order.  No tokens at all: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry.llm import scratch

SEED, BUDGET_RATIO, MAX_REPEATS, BLOCK_TOKENS, RANGES = 17, 1.25, 1.5, 1 << 20, 12


def n_tokens(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(F.length(text) / 4))).cast("long")


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    powered = [(t / total) ** exponent for t in tokens]
    return [x / sum(powered) for x in powered]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def exponent(tokens: list[int], budget: float, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """The exponent that meets the target, on a grid of 1e-6. tokens are positive."""
    if target_entropy is None:

        def enough(a: float) -> bool:
            return max(x * budget / t for x, t in zip(weights(tokens, a), tokens)) <= max_repeats

        if not enough(1.0):
            raise ValueError("the budget repeats every source more often than max_repeats")
    else:
        goal = target_entropy * math.log(len(tokens)) if len(tokens) > 1 else 0.0

        def enough(a: float) -> bool:
            return entropy(weights(tokens, a)) < goal - 1e-12

    lo, hi = 0, 1_000_000  # enough() turns from false to true once
    if target_entropy is not None and not enough(1.0):
        return 1.0
    while lo < hi:
        mid = (lo + hi) // 2
        if enough(mid / 1e6):
            hi = mid
        else:
            lo = mid + 1
    return (lo if target_entropy is None else max(0, lo - 1)) / 1e6


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    """60 bits of a hash: the document's place in the permutation of an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def plan(narrow: DataFrame, seed: int = SEED, budget_ratio: float = BUDGET_RATIO, budget: int | None = None, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None) -> DataFrame:
    """(source, total, budget, epochs, rest, bound) of each source with tokens, from narrow (doc_id, source,
    n_tokens): epochs full permutations, then the documents whose key in epoch number epochs is bound or less."""
    spark = narrow.sparkSession
    totals = [(r.source, r.total) for r in narrow.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("total")).collect()]  # one row a source
    totals.sort(key=lambda x: (x[0] is None, x[0]))
    schema = f"source {narrow.schema['source'].dataType.simpleString()}, total long, budget long, epochs long, rest long"
    shares = []
    if totals:
        whole = sum(t for _, t in totals)
        goal = whole * budget_ratio if budget is None else budget
        w = weights([t for _, t in totals], exponent([t for _, t in totals], goal, max_repeats, target_entropy))
        shares = [(s, t, (b := math.floor(x * goal)), b // t, b % t) for (s, t), x in zip(totals, w)]
    split = spark.createDataFrame(shares, schema)
    keyed = narrow.where("n_tokens > 0").alias("n").join(split.alias("s"), F.col("n.source").eqNullSafe(F.col("s.source"))).select("s.source", "n_tokens", "rest", _key(F.col("epochs"), F.col("doc_id"), seed).alias("key"))
    keyed = keyed.withColumn("range", F.shiftright("key", 60 - RANGES))
    before = F.sum("tokens").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = keyed.groupBy("source", "range", "rest").agg(F.sum("n_tokens").alias("tokens")).withColumn("before", F.coalesce(before, F.lit(0)))
    last = sums.where("before <= rest and before + tokens > rest").select("source", "range", "before")
    inside = keyed.alias("k").join(last.alias("l"), F.col("k.source").eqNullSafe(F.col("l.source")) & (F.col("k.range") == F.col("l.range")))
    upto = F.sum("n_tokens").over(W.partitionBy("k.source").orderBy("key").rangeBetween(W.unboundedPreceding, 0))
    ends = inside.select("k.source", "l.range", "key", "rest", (F.col("before") + upto).alias("upto")).groupBy("source", "range").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("key"))
    bounds = ends.select("source", F.coalesce("key", F.shiftleft("range", 60 - RANGES) - 1).alias("bound"))
    return split.alias("s").join(bounds.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")), "left").select("s.*", F.coalesce("bound", F.lit(-1).cast("long")).alias("bound"))


def _chosen(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, source, n_tokens, ...) once for each epoch they are chosen in."""
    joined = rows.alias("r").join(planned.select(F.col("source").alias("s_source"), "total", "budget", "epochs", "bound"), F.col("r.source").eqNullSafe(F.col("s_source")) & (F.col("n_tokens") > 0))
    n = F.col("epochs") + (_key(F.col("epochs"), F.col("r.doc_id"), seed) <= F.col("bound")).cast("long")
    joined = joined.withColumn("n", n).withColumn("ratio", F.col("budget") / F.col("total")).where("n > 0")
    return joined.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_tokens(F.col("text")).alias("n_tokens"))


def mix(docs: DataFrame, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, **target) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, place): the chosen documents; block and place give their order."""
    narrow = scratch.table(_narrow(docs))
    planned = scratch.table(plan(narrow, seed, **target))
    blocks = _blocks(planned, block_tokens)
    spread = _spread(_chosen(narrow, planned, seed), blocks, seed).select("r.doc_id", "r.source", "n_tokens", "epoch", "block", "shuffled")
    place = F.row_number().over(W.partitionBy("block").orderBy("shuffled", "doc_id", "epoch", "source", "n_tokens"))
    return spread.select("doc_id", "source", "n_tokens", "epoch", "block", place.cast("long").alias("place"))


def _blocks(planned: DataFrame, block_tokens: int) -> int:
    whole = planned.agg(F.coalesce(F.sum("budget"), F.lit(0))).first()[0]
    return max(1, -(-whole // block_tokens))


def _spread(chosen: DataFrame, blocks: int, seed: int) -> DataFrame:
    """With block, and shuffled, by which a block's rows are ordered."""
    key = _key(F.col("epoch"), F.col("r.doc_id"), seed)
    along = (F.col("epoch") + key / F.lit(2.0**60)) / F.col("ratio")
    placed = chosen.withColumn("block", F.least(F.floor(along * blocks), F.lit(blocks - 1)).cast("long"))
    return placed.withColumn("shuffled", F.md5(F.concat_ws(":", F.col("block").cast("string"), key.cast("string"))))


def mixed(docs: DataFrame, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, **target) -> DataFrame:
    """The chosen rows of docs with all their columns, a row once for each epoch it is chosen in, block after block
    and permuted inside each: the partitions in turn have the order of mix()."""
    planned = scratch.table(plan(scratch.table(_narrow(docs)), seed, **target))  # as a file, so that the join knows it is small
    blocks, n = _blocks(planned, block_tokens), scratch.n_parts(docs.sparkSession)
    # columns are renamed, so that none clashes with those of the plan
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_tokens(F.col("text")).alias("n_tokens"), *(F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(docs.columns)))
    spread = _spread(_chosen(rows, planned, seed), blocks, seed)
    at = F.floor(F.col("block") * n / F.lit(blocks)).cast("int")
    return spread.repartitionById(n, at).sortWithinPartitions("block", "shuffled", "r.doc_id", "epoch", "r.source", "n_tokens").select(*(F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns)))


SQL = f"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)) END::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM n WHERE n_tokens > 0 GROUP BY source),
g AS (SELECT sum(total)::DOUBLE AS whole, sum(total)::DOUBLE * {BUDGET_RATIO} AS goal FROM t),
bis(i, lo, hi) AS (
  SELECT 0, 0, 1000000
  UNION ALL
  SELECT i + 1,
    CASE WHEN (SELECT max(pow(total / whole, ((lo + hi) // 2) / 1e6) / total) / sum(pow(total / whole, ((lo + hi) // 2) / 1e6)) * max(goal) FROM t, g) <= {MAX_REPEATS} THEN lo ELSE (lo + hi) // 2 + 1 END,
    CASE WHEN (SELECT max(pow(total / whole, ((lo + hi) // 2) / 1e6) / total) / sum(pow(total / whole, ((lo + hi) // 2) / 1e6)) * max(goal) FROM t, g) <= {MAX_REPEATS} THEN (lo + hi) // 2 ELSE hi END
  FROM bis WHERE lo < hi),
a AS (SELECT min(hi) / 1e6 AS a FROM bis),
s AS (SELECT source, total, floor(pow(total / whole, a) / (SELECT sum(pow(total / whole, a)) FROM t, g, a) * goal)::BIGINT AS budget FROM t, g, a),
p AS (SELECT source, total, budget, budget // total AS epochs, budget % total AS rest FROM s),
k AS (SELECT n.doc_id, n.source, n_tokens, total, budget, epochs, rest,
    ('0x' || substr(md5('{SEED}:' || epochs || ':' || coalesce(n.doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS last_key
  FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source WHERE n_tokens > 0),
c AS (SELECT *, epochs + (sum(n_tokens) OVER (PARTITION BY source ORDER BY last_key RANGE UNBOUNDED PRECEDING) <= rest)::BIGINT AS times FROM k),
e AS (SELECT * FROM (SELECT *, unnest(range(0, times)) AS epoch FROM c)),
m AS (SELECT *, ('0x' || substr(md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM e),
b AS (SELECT greatest(1, -((-sum(budget)) // {BLOCK_TOKENS}) ) AS blocks0, CASE WHEN sum(budget) % {BLOCK_TOKENS} = 0 THEN sum(budget) // {BLOCK_TOKENS} ELSE sum(budget) // {BLOCK_TOKENS} + 1 END AS blocks FROM s),
o AS (SELECT doc_id, source, n_tokens, epoch, key, least(floor((epoch + key / pow(2::DOUBLE, 60)) / (budget / total) * blocks), blocks - 1)::BIGINT AS block FROM m, b)
SELECT doc_id, source, n_tokens, epoch::BIGINT AS epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY md5(block || ':' || key), doc_id, epoch, source, n_tokens)::BIGINT AS place
FROM o
"""
