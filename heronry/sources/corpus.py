"""The corpus store: one collection a domain, as immutable versions of Parquet files under numbered pointers.

Records are spread over BUCKETS folders by a hash of doc_id. A write makes new folders for the buckets that it
changes only, and then a pointer file, CURRENT.n with the next number, which lists the folders of all buckets. Readers
take the pointer with the highest number that is written to its end; pointers are never deleted or replaced while they
count, so a reader sees the old version or the new one. The pointer is created only if there is none of its number
yet: of two writers that began at one version, the second gets a WriteConflict and can begin again. A writer that
dies in between leaves an empty pointer, which vacuum() removes. Paths go through Hadoop's file system.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.settings import get_settings

RECORD = "chunk_id string, doc_id string, domain_id string, index int, text string, context string, embed_text string, section string, header_path array<string>, pages array<int>, token_count int, embedding array<float>"
BUCKETS = 64
DEFAULTS = {"doc_id": "?", "context": "", "section": ""}


def collection_name(domain_id: str, prefix: str = "domain_") -> str:
    """The driver's form of functions.text.collection_name."""
    full = prefix + domain_id
    safe = re.sub(r"\.\.+", "_", re.sub(r"[^a-zA-Z0-9._-]", "_", full))
    if safe == full and safe[-1].isalnum():
        return safe[:512]
    return f"{safe[:494].rstrip('._-')}_{hashlib.sha256(domain_id.encode()).hexdigest()[:8]}"


def record(df: DataFrame) -> DataFrame:
    """df with the store's columns, in its order; missing metadata becomes its default."""
    out = []
    for column in RECORD.split(", "):
        name, kind = column.split(" ", 1)
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]))
        elif name in ("pages", "header_path"):
            value = F.coalesce(value, F.array().cast(kind))
        elif name == "embed_text" and name not in df.columns:
            value = T.embed_text(F.col("context") if "context" in df.columns else F.lit(""), F.col("text"))
        out.append(value.alias(name))
    return df.select(*out)


def _bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


def export(df: DataFrame) -> DataFrame:
    """Rows as JSON with their section, for other tools."""
    return df.select("chunk_id", F.to_json(F.struct(*(c for c in df.columns if c != "embedding"))).alias("json"))


class WriteConflict(OSError):
    """Another write was published since this one began."""


class Store:
    """One collection. The path is the argument, the setting vector_dir, or a folder here."""

    def __init__(self, spark: SparkSession, domain_id: str = "default", path: str | None = None) -> None:
        base = path or get_settings().vector_dir or ".heronry"
        if "://" not in base:
            base = os.path.abspath(os.path.expanduser(base))
        self.spark, self.domain_id = spark, domain_id
        self.root = f"{base}/{collection_name(domain_id)}"

    # --- files, through Hadoop

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _pointers(self) -> list[tuple[int, int]]:
        """(number, size) of each pointer, ascending."""
        _, fs, at = self._fs(self.root)
        found = [(x.getPath().getName(), x.getLen()) for x in (fs.listStatus(at) if fs.exists(at) else [])]
        return sorted((int(name[8:]), size) for name, size in found if re.fullmatch(r"CURRENT\.\d+", name))

    def _number(self) -> int | None:
        return max((n for n, size in self._pointers() if size), default=None)

    def version(self) -> str | None:
        """The name of the current version; None of an empty collection. Caches key on it."""
        n = self._number()
        return None if n is None else f"v{n}"

    def _folders(self, number: int | None) -> dict[str, str]:
        """The folder of each bucket that has records."""
        if number is None:
            return {}
        _, fs, at = self._fs(f"{self.root}/CURRENT.{number}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, folders: dict[str, str], before: int | None) -> None:
        jvm, fs, at = self._fs(f"{self.root}/CURRENT.{(before or 0) + 1}")
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            raise WriteConflict(f"{self.root} has changed since version {before}, or a writer died; see vacuum()") from e
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()

    def _write(self, df: DataFrame, folders: dict[str, str], before: int | None) -> None:
        """Publishes folders, and df in folders of its own."""
        name = f"data-{uuid.uuid4().hex}"
        df.withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(f"{self.root}/{name}")
        _, fs, at = self._fs(f"{self.root}/{name}")
        made = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith("bucket=")]
        self._publish({**folders, **{x[7:]: f"{name}/{x}" for x in made}}, before)

    def _read(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*(f"{self.root}/{x}" for x in folders.values()))

    # --- reads

    def records(self) -> DataFrame:
        """Every record of the current version."""
        return self._read(self._folders(self._number()))

    def get(self, chunk_id: str) -> DataFrame:
        return self.records().where(F.col("chunk_id") == chunk_id).limit(1)

    def count(self) -> int:
        return self.records().count()

    def doc_ids(self) -> DataFrame:
        return self.records().where("doc_id <> ''").select("doc_id").distinct()

    def missing(self, docs: DataFrame) -> DataFrame:
        """docs that the collection doesn't have: what a resumed ingestion has left to do."""
        return docs.join(self.doc_ids(), "doc_id", "left_anti")

    # --- writes

    def add(self, chunks: DataFrame, whole_documents: bool = True) -> None:
        """Adds records in place of those with the same doc_id (or, for parity with upserts by record, only of
        those with the same chunk_id)."""
        new, before = record(chunks), self._number()
        folders = self._folders(before)
        key = "doc_id" if whole_documents else "chunk_id"
        # a record with this chunk_id may be of another document, in any bucket
        changed = {str(r.b) for r in new.select(_bucket().alias("b")).distinct().collect()} if whole_documents else set(folders)  # BUCKETS at most
        old = self._read({b: x for b, x in folders.items() if b in changed})
        kept = old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns)
        self._write(kept.unionByName(new), {b: x for b, x in folders.items() if b not in changed}, before)

    def reset(self) -> None:
        """Empties the collection; it stays usable."""
        self._publish({}, self._number())

    def drop(self) -> None:
        _, fs, at = self._fs(self.root)
        fs.delete(at, True)

    def delete_on_exit(self) -> None:
        """The collection goes when the application ends."""
        _, fs, at = self._fs(self.root)
        fs.deleteOnExit(at)

    def vacuum(self) -> None:
        """Deletes what the current version doesn't need: once nothing reads older ones, and while nothing writes."""
        now = self._number()
        needed = {x.split("/")[0] for x in self._folders(now).values()}
        jvm, fs, at = self._fs(self.root)
        for n, _ in self._pointers():
            if n != now:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT.{n}"), False)
        for status in fs.listStatus(at) if fs.exists(at) else []:
            if status.isDirectory() and status.getPath().getName() not in needed:
                fs.delete(status.getPath(), True)
