"""Token counts by a linear longest-match automaton.

A word (a part between ASCII white space) with a leading space is cut greedily into the longest
vocabulary entries from the left. The count of pieces is found without building them: the trie of the
vocabulary carries at each node a failure link, the state after the pieces that are certain once no
child matches, and the number of those pieces. A word costs one step a byte and one for each popped
piece. Each distinct word of a batch is run once, all of them in step as arrays.

The vocabulary must hold every single byte (byte-level ones do), so every text can be cut.

Cases: null and empty texts have 0 words and pieces; words of any length are cut whole; a null doc_id
and other columns change nothing; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm import scratch, vectext, vocabulary

_BATCH = 8 << 20


class Automaton:
    """Arrays of the trie: keys are node * 256 + byte, sorted; child, fail and popped belong to nodes."""

    def __init__(self, tokens: list[bytes]) -> None:
        child: list[dict[int, int]] = [{}]
        final = [False]
        for token in tokens:
            at = 0
            for byte in token:
                step = child[at].get(byte)
                if step is None:
                    step = child[at][byte] = len(child)
                    child.append({})
                    final.append(False)
                at = step
            final[at] = True
        if not all(b in child[0] and final[child[0][b]] for b in range(256)):
            raise ValueError("the vocabulary lacks some single byte")
        final[0] = False
        fail, popped = [0] * len(child), [0] * len(child)
        level = [(0, b, v) for b, v in child[0].items()]
        while level:
            following = []
            for parent, byte, v in level:
                if final[v]:
                    fail[v], popped[v] = 0, 1
                else:
                    z, n = fail[parent], popped[parent]
                    while byte not in child[z]:
                        n += popped[z]
                        z = fail[z]
                    fail[v], popped[v] = child[z][byte], n
                following += [(v, b, w) for b, w in child[v].items()]
            level = following
        pairs = sorted((v << 8 | b, w) for v, kids in enumerate(child) for b, w in kids.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.child = np.array([w for _, w in pairs], np.int64)
        self.fail, self.popped = np.array(fail), np.array(popped)

    def _step(self, node: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The state after one more byte; count gains what is popped."""
        out = np.zeros(len(node), np.int64)
        open_ = np.arange(len(node))
        while len(open_):
            key = node[open_] << 8 | byte[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[open_[found]] = self.child[at[found]]
            open_ = open_[~found]
            count[open_] += self.popped[node[open_]]
            node[open_] = self.fail[node[open_]]
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of the words data[start:end], each with a leading space."""
        order = np.argsort(start - end, kind="stable")  # longest first, so those still running are a prefix
        start, length = start[order], (end - start)[order]
        count = np.zeros(len(start), np.int64)
        node = self._step(np.zeros(len(start), np.int64), np.full(len(start), 32), count)
        running = len(start)
        for t in range(int(length[0]) if len(length) else 0):
            running = int(np.searchsorted(-length[:running], -t, "left"))
            node[:running] = self._step(node[:running].copy(), data[start[:running] + t].astype(np.int64), count[:running])
        while (node > 0).any():
            count += self.popped[node]
            node = self.fail[node]
        out = np.empty(len(count), np.int64)
        out[order] = count
        return out


def count_pieces(docs: DataFrame, path: str = vocabulary.BYTE_BPE) -> DataFrame:
    """(doc_id, n_words, n_pieces, n_bytes) of every row."""
    held = scratch.share(docs.sparkSession, Automaton(list(vocabulary.ranks(path))))  # its size is the vocabulary's

    def run(batches):
        automaton = scratch.shared(held)
        for batch in batches:
            n = np.zeros((3, batch.num_rows), np.int64)
            for p in vectext.pieces(batch.column(1), _BATCH, lower=False, word=vectext.SOLID):
                first, which = vectext.named(p.data, p.start, p.end, p.hash)
                counts = automaton.counts(p.data, p.start[first], p.end[first])[which]
                rows = slice(p.first, p.first + p.n_rows)
                n[0, rows] = np.bincount(p.row, minlength=p.n_rows)
                n[1, rows] = np.bincount(p.row, counts, p.n_rows).astype(np.int64)
                n[2, rows] = np.diff(p.row_starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, n)], ["doc_id", "n_words", "n_pieces", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_bytes long")
