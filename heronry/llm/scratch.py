"""Tables that cut lineage, and shuffles of packed arrays.

A table is written to the folder that the session names in spark.checkpoint.dir, which all executors share, so
the loss of an executor loses none of it. Only where the session names none and runs on one machine, as in tests,
a temporary folder takes its place; on a cluster that is an error. Tables of an application are in one folder,
which goes when the application ends; drop() and scope() remove them earlier.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import vectext

_BLOB = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: a packed record batch stays below this many bytes
BLOB_BYTES = 4 << 20

_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The application's folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.heronry.scratch", None)
        if not where:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
            where = "file://" + tempfile.mkdtemp(prefix="heronry-")
            spark.conf.set("spark.heronry.scratch", where)
    return f"{where.rstrip('/')}/heronry-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def table(df: DataFrame, keep: bool = False) -> DataFrame:
    """df, written once and read again. Shuffle files that led to it are freed at once. It goes when the scope that
    it is made in ends, if any and if not keep, or when the application does."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    at, fs = _path(spark, folder)
    fs.deleteOnExit(at)
    path = f"{folder}/{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._heronry_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that nothing will read any more."""
    at, fs = _path(df.sparkSession, df._heronry_path)
    fs.delete(at, True)


@contextmanager
def scope(spark: SparkSession):
    """Tables made inside go at the end, so what is wanted of them has to be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at, fs = _path(spark, path)
            fs.delete(at, True)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of value, to be read by shared(): its class travels along."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(held: Broadcast) -> object:
    """The value; a worker keeps one unpickled object, for its next task."""

    def load() -> object:
        value = pickle.loads(held.value)
        if held._path is not None:
            held.__dict__.pop("_value", None)  # the pickled bytes; the file is still there
        return value

    return vectext.once("shared", held._path or id(held), load)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(part: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, records of it as bytes)."""
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(part))
    step = max(1, BLOB_BYTES // records.dtype.itemsize)
    keys, blobs = [], []
    for lo, hi in zip(heads.tolist(), ends.tolist()):
        for at in range(lo, hi, step):
            keys.append(int(part[lo]))
            blobs.append(records[at : min(hi, at + step)].tobytes())
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], schema=_BLOB)


def shuffle(
    df: DataFrame,
    emit: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]],
    dtype: np.dtype,
    reduce: Callable[[np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """emit yields (64-bit keys, records) of a partition of df; records with equal keys meet in one call of
    reduce, which gets all records of its partition. Arrays travel packed: a record costs its own bytes."""
    n = n_parts(df.sparkSession)

    def scatter(batches):
        for keys, records in emit(batches):
            yield from pack((keys.astype(np.uint64) % np.uint64(n)).astype(np.int32), records)

    def collect(batches):
        held = [np.frombuffer(x.as_buffer(), dtype) for batch in batches for x in batch.column(1)]
        if held:
            yield from reduce(np.concatenate(held))

    return df.mapInArrow(scatter, "part int, blob binary").repartitionById(n, F.col("part")).mapInArrow(collect, schema)


def fold(columns: list[np.ndarray], ascends: bool = True) -> bytes:
    """Columns of 64-bit values as bytes that are few: the first, if it ascends, as differences, each in planes of its
    bytes, as many as its largest value has, compressed."""
    n, heads, planes = len(columns[0]), [], []
    for k, column in enumerate(columns):
        column = np.ascontiguousarray(column, np.uint64)
        if ascends and not k and n:
            column = np.concatenate([column[:1], column[1:] - column[:-1]])
        width = (int(column.max()).bit_length() + 7) // 8 if n else 0
        heads.append(width)
        planes.append(np.ascontiguousarray(column.view(np.uint8).reshape(n, 8)[:, :width].T).tobytes())
    raw = b"".join(planes)
    return n.to_bytes(8, "little") + bytes([ascends, len(heads), *heads]) + (pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b"")


def folded(blob: bytes) -> int:
    """How many rows a blob of fold() has."""
    return int.from_bytes(blob[:8], "little")


def unfold(blob: bytes) -> np.ndarray:
    """The columns of a blob of fold(), one row each."""
    n, ascends, widths = folded(blob), blob[8], blob[10 : 10 + blob[9]]
    out = np.zeros((len(widths), n, 8), np.uint8)
    if n and sum(widths):
        raw = np.frombuffer(pa.Codec("zstd").decompress(memoryview(blob)[10 + len(widths) :], n * sum(widths)), np.uint8)
        at = 0
        for c, w in enumerate(widths):
            out[c, :, :w] = raw[at : at + w * n].reshape(w, n).T
            at += w * n
    out = out.view(np.uint64).reshape(len(widths), n)
    if ascends:
        np.cumsum(out[0], out=out[0])
    return out
