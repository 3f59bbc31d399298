"""Quality classifier: nearest-neighbour voting.

Labelled documents become latent-semantic vectors: the terms (words, their first STEM bytes, and four
shapes of the parts between spaces: capitals, signs, repeats, bars) that occur in at least MIN_DOCS of them are weighted by how
unevenly the labels share them (a z-score), and a truncated singular value decomposition keeps DIMENSIONS
directions. Every document is put into the same space; its cosines with all labelled vectors are
computed exactly, a block of documents at a time, and the NEIGHBOURS nearest vote with their similarity, times what their class's
share of all labels is over its share of the sample.

The labelled sample is bounded: SAMPLE_PER_CLASS documents of each (quality, toxic) class, those with the
lowest hash of doc_id. So the vectors have a fixed size, whatever the input, and are broadcast. Every
document is classified; one in the sample does not vote on itself.

Cases: null and empty texts, and those without a known word, have no neighbours: their votes are the
shares of the labels over the whole labels table. Without labels votes are null. Rows of labels with a
null are ignored, repeated ones count once; labels without a document are ignored in the fit. A null
doc_id and other columns change nothing; repeated rows give a row each; an empty table an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry.llm import scratch, vectext
from heronry.llm.vectext import starts_of

SAMPLE_PER_CLASS, MIN_DOCS, DIMENSIONS, NEIGHBOURS, ROUNDS = 1000, 3, 64, 15, 3
STEM, LEAST_WEIGHT, MOST_WEIGHT, CHANCE = 6, 0.02, 15.0, 6.0
SHAPES = 4
_BLOCK = 512


def _shapes(texts: pa.Array) -> np.ndarray:
    """Of each text, the share of its parts between spaces in capitals, with signs, equal to the one before, and bars."""
    out = np.zeros((len(texts), SHAPES), np.float32)
    kind = np.zeros(256, np.uint8)
    kind[97:123] = 1  # lower case
    kind[[ord(c) for c in "#*$%&!~^_=@+{}<>"]] = 2
    for p in vectext.pieces(texts, lower=False, word=vectext.SOLID):
        if not len(p.hash):
            continue
        cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        k = kind[p.data]
        low, signs = (c[p.end] - c[p.start] for c in (cum(k == 1), cum(k == 2)))
        capital = cum((p.data >= 65) & (p.data <= 90))
        same = np.zeros(len(p.hash), bool)
        same[1:] = (p.hash[1:] == p.hash[:-1]) & (p.row[1:] == p.row[:-1])
        marks = ((low == 0) & (capital[p.end] - capital[p.start] >= 2), signs >= 2, same, (p.end - p.start == 1) & (p.data[p.start] == ord("|")))
        n = np.maximum(1, np.bincount(p.row, minlength=p.n_rows))
        for s, mark in enumerate(marks):
            out[p.first : p.first + p.n_rows, s] = np.bincount(p.row[mark], minlength=p.n_rows) / n
    return out


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash of a word or stem), rows in order."""
    rows, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for p in vectext.pieces(texts):
        long = np.flatnonzero(p.end - p.start > STEM)
        row, word = np.concatenate([p.row, p.row[long]]), np.concatenate([p.hash, p.prefix_hashes(long, STEM)])
        order = np.argsort(row, kind="stable")
        row, word = vectext.distinct(row[order], word[order])
        rows.append(row + p.first)
        words.append(word)
    return np.concatenate(rows), np.concatenate(words)


def _sums(values: np.ndarray, index: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Row sums of a sparse matrix product: for each owner, the sum of weight * values[index]; owner is non-decreasing."""
    out = np.zeros((n, values.shape[1]), np.float32)
    for lo in range(0, len(index), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        heads = starts_of(owner[part])
        out[owner[part][heads]] += np.add.reduceat(values[index[part]] * weight[part, None], heads, axis=0)
    return out


class Space:
    """The terms, their weights and directions, and the labelled vectors."""

    def __init__(self, doc_ids: np.ndarray, texts: pa.Array, labels: np.ndarray, stands_for: np.ndarray, min_docs: int, dimensions: int) -> None:
        n = len(texts)
        row, word = _terms(texts)
        known, df = np.unique(word, return_counts=True)
        self.known = known[df >= min_docs]
        row, term = self._find(row, word)
        shapes = _shapes(texts)
        present = np.concatenate([np.zeros((n, 0)), shapes > 0.2], axis=1)
        size = len(self.known) + SHAPES
        weight = np.full(size, LEAST_WEIGHT)
        for label in labels.T:
            share = label.mean()
            for value, part in ((1, share), (0, 1 - share)):
                if 0 < part < 1:
                    inside = label[row] == value
                    seen = np.concatenate([np.bincount(term[inside], minlength=len(self.known)), present[label == value].sum(axis=0)])
                    total = np.concatenate([np.bincount(term, minlength=len(self.known)), present.sum(axis=0)])
                    z = (seen - total * part) / np.sqrt(np.maximum(total * part * (1 - part), 1e-9))
                    weight = np.maximum(weight, np.minimum(z - CHANCE, MOST_WEIGHT))
        self.weight = weight.astype(np.float32)
        self.top = np.zeros((size, 0), np.float32)
        rows, terms, values = self._matrix(row, term, shapes)
        k = min(dimensions, n, size)
        by_term = np.argsort(terms, kind="stable")
        rng = np.random.default_rng(7)
        basis = rng.standard_normal((size, k)).astype(np.float32)
        for _ in range(ROUNDS):
            left, _ = np.linalg.qr(_sums(basis, terms, values, rows, n))
            basis = _sums(left.astype(np.float32), rows[by_term], values[by_term], terms[by_term], size)
            basis, _ = np.linalg.qr(basis)
        self.top = basis.astype(np.float32)
        self.doc_ids, self.labels, self.stands_for = doc_ids, labels.astype(np.float64), stands_for
        self.vectors = self._vectors(rows, terms, values, n)

    def _find(self, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.known, word), len(self.known) - 1)
        hit = self.known[at] == word
        return row[hit], at[hit]

    def _matrix(self, row: np.ndarray, term: np.ndarray, shapes: np.ndarray):
        r, s = np.nonzero(shapes)
        rows = np.concatenate([row, r])
        terms = np.concatenate([term, s + len(self.known)])
        values = np.concatenate([self.weight[term], shapes[r, s] * self.weight[s + len(self.known)]]).astype(np.float32)
        order = np.argsort(rows, kind="stable")
        return rows[order], terms[order], values[order]

    def _vectors(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        v = _sums(self.top, terms, values, rows, n)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vectors_of(self, texts: pa.Array) -> np.ndarray:
        return self._vectors(*self._matrix(*self._find(*_terms(texts)), _shapes(texts)), len(texts))

    def votes(self, vectors: np.ndarray, doc_ids: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
        """(votes for each label, whether there was a neighbour with a positive cosine)."""
        votes, any_ = np.zeros((len(vectors), self.labels.shape[1])), np.zeros(len(vectors), bool)
        if not len(self.vectors):
            return votes, any_
        k = min(neighbours, len(self.vectors))
        for lo in range(0, len(vectors), _BLOCK):
            part = slice(lo, lo + _BLOCK)
            sims = vectors[part] @ self.vectors.T
            sims[doc_ids[part, None] == self.doc_ids[None, :]] = -1
            near = np.argpartition(sims, -k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(sims, near, axis=1), 0) * self.stands_for[near]
            total = w.sum(axis=1)
            any_[part] = total > 1e-6
            votes[part] = (w[:, :, None] * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)[:, None]
        return votes, any_


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, min_docs: int = MIN_DOCS, dimensions: int = DIMENSIONS) -> tuple[Space | None, tuple[float, float] | None]:
    """The space of the bounded sample, and the shares of the labels over all their rows."""
    clean = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("l_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    shares = clean.agg(F.avg("quality"), F.avg("toxic")).first()
    if shares[0] is None:
        return None, None
    # the row number alone in its window: rows beyond per_class are dropped before the shuffle
    order = F.row_number().over(W.partitionBy("quality", "toxic").orderBy(F.xxhash64("l_id"), "l_id"))
    sample = clean.withColumn("place", order).where(F.col("place") <= per_class)
    size = {(r.quality, r.toxic): r.n for r in clean.groupBy("quality", "toxic").agg(F.count("*").alias("n")).collect()}
    # of documents that share a doc_id, the text that comes first; per_class rows a class at most
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "quality", "toxic")
    table = held.toArrow().sort_by("doc_id").combine_chunks()
    if not table.num_rows:
        return None, tuple(shares)
    lab = np.stack([table.column(k).to_numpy() for k in ("quality", "toxic")], axis=1)
    kind = lab[:, 0] * 2 + lab[:, 1]
    stands_for = np.array([size[tuple(x)] for x in lab.tolist()]) / np.bincount(kind)[kind]
    return Space(table.column("doc_id").to_numpy(), table.column("text").combine_chunks(), lab, stands_for, min_docs, dimensions), tuple(shares)


def classify(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, **sample: int) -> DataFrame:
    """(doc_id, quality_vote, toxic_vote, quality, toxic) of every row."""
    space, shares = fit(docs, labels, **sample)
    held = scratch.share(docs.sparkSession, space)

    def run(batches):
        model = scratch.shared(held)
        for batch in batches:
            n = batch.num_rows
            votes, any_ = np.zeros((n, 2)), np.zeros(n, bool)
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            for lo in range(0, n if model is not None else 0, 2000):
                part = batch.column(1).slice(lo, 2000)
                votes[lo : lo + 2000], any_[lo : lo + 2000] = model.votes(model.vectors_of(part), ids[lo : lo + 2000], neighbours)
            if shares is not None:
                votes[~any_] = shares
            none = np.full(n, shares is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(votes[:, k], mask=none) for k in (0, 1)), *(pa.array((votes[:, k] >= 0.5).astype(np.int32), mask=none) for k in (0, 1))], ["doc_id", "quality_vote", "toxic_vote", "quality", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, quality_vote double, toxic_vote double, quality int, toxic int")
