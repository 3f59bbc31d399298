"""The k best rows of each query, kept while batches of rows go by: what a task of a search holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: candidates that wait, at least, before the k best are chosen again
WAIT = 1 << 18
#: of a score that is kept as an integer: 4 decimals
UNIT = 1e4
_NEVER = np.iinfo(np.int64).min


def units(scores: np.ndarray) -> np.ndarray:
    """Scores to 4 decimals, as integers; what is no number counts 0."""
    return np.floor(np.nan_to_num(scores, nan=0.0, posinf=0.0, neginf=0.0) * UNIT + 0.5).astype(np.int64)


def places(*keys: pa.Array) -> np.ndarray:
    """The place of each row in order of the keys, as Spark orders them; structs are ordered by their fields."""
    fields = [f for key in keys for f in (key.flatten() if pa.types.is_struct(key.type) else [key])]
    names = [str(k) for k in range(len(fields))]
    order = pc.sort_indices(pa.table(fields, names), [(n, "ascending") for n in names], null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


class Best:
    """The k rows of each of n queries with the highest scores, ties by ord and id. Memory: the rows kept, and some that wait."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        #: the score a row needs, at least, to be among the k best so far
        self.floor = np.full(n, _NEVER, np.int64)
        self._rows: pa.Table | None = None
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._tables: list[pa.Table] = []
        self._held = self._waiting = self._known = 0

    def offer(self, query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: pa.Array, ords: pa.Array) -> None:
        """Candidates: numbers of queries, numbers of rows in ids and ords, and scores in units."""
        if not len(query):
            return
        used = np.zeros(len(ids), bool)
        used[row] = True
        at = np.cumsum(used) - 1 + self._known
        table = pa.table([ids, ords], ["id", "ord"]).take(pa.array(np.flatnonzero(used)))
        self._parts.append((query.astype(np.int64), at[row], score))
        self._tables.append(table)
        self._known += table.num_rows
        self._waiting += len(query)
        if self._waiting > max(WAIT, self._held):
            self._settle()

    def _settle(self) -> None:
        if not self._waiting:
            return
        query, row, score = (np.concatenate(x) for x in zip(*self._parts))
        rows = pa.concat_tables(self._tables).combine_chunks()
        place = places(*(rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.column(c).type) for c in ("ord", "id")))
        order = np.lexsort((place[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        begins = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        full = rank == self.k - 1
        self.floor[query[full]] = score[full]
        keep = rank < self.k
        query, row, score, self._rank = query[keep], row[keep], score[keep], rank[keep]
        used = np.zeros(rows.num_rows, bool)
        used[row] = True
        rows = rows.take(pa.array(np.flatnonzero(used)))
        self._parts, self._tables = [(query, (np.cumsum(used) - 1)[row], score)], [rows]
        self._held, self._waiting, self._known = len(query), 0, rows.num_rows

    def batches(self, query_ids: pa.Array, names: list[str], size: int = 1 << 17):
        """(query_id, id, ord, score, rank), ordered by query and rank."""
        self._settle()
        if not self._held:
            return
        (query, row, score), rows = self._parts[0], self._tables[0]
        ids, ords = (rows.column(c).combine_chunks() for c in ("id", "ord"))
        for at in range(0, len(query), size):
            q, r = pa.array(query[at : at + size]), pa.array(row[at : at + size])
            yield pa.RecordBatch.from_arrays([query_ids.take(q), ids.take(r), ords.take(r), pa.array(score[at : at + size] / UNIT), pa.array(self._rank[at : at + size])], names)
