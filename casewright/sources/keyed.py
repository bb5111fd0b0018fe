"""A keyed table in a shared folder, as numbered snapshots.

``<root>/data/<write>/_bucket=<k>/`` holds rows, ``<root>/versions/<n>.json`` says for version n
which folder holds each bucket. A write rewrites the buckets that its keys
fall into, points the others at what is there, and takes effect when the
next version's file appears; that file is made only once, so of two writers that began
from the same version the later one fails and starts anew. Versions stay
readable until ``vacuum``. All files are reached by Hadoop's file systems.

A store whose newest version can't be read (a torn file, a folder that is gone)
counts as empty and the next write begins a fresh one: a cache must not stop a run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer took the next version first."""


class KeyedStore:
    """Rows of ``schema`` (DDL), at most one for each value of ``keys``."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, buckets: int = 16, files: int = 1):
        self.spark, self.root, self.keys, self.schema, self.buckets, self.files = spark, root.rstrip("/"), list(keys), schema, buckets, files
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, oldest first."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        """The newest version, or a given one, and what it says; an unreadable one says nothing."""
        known = self.versions()
        number = version if version is not None else (known[-1] if known else 0)
        nothing = {"buckets": {}, "tokens": {}, "count": self.buckets}
        if number not in known:
            return number, nothing
        try:
            stream = self._fs.open(self._path(f"{self.root}/versions/{number}.json"))
            try:
                state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            whole = all(self._fs.exists(self._path(f"{self.root}/{p}")) for p in state["buckets"].values())
        except (ValueError, KeyError, AttributeError, TypeError, Py4JJavaError):
            return number, nothing
        return number, state if whole and state["count"] == self.buckets else nothing

    def _commit(self, number: int, state: dict) -> None:
        try:
            stream = self._fs.create(self._path(f"{self.root}/versions/{number}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {number} of {self.root} is taken") from e
            raise
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()

    # rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{p}" for p in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one."""
        return self._rows(list(self._state(version)[1]["buckets"].values()))

    def tokens(self) -> dict[str, int]:
        """The last batch that each stream has merged."""
        return self._state()[1]["tokens"]

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame], DataFrame], token: tuple[str, int] | None = None) -> int:
        """Combine ``rows`` with the stored rows of the buckets they touch; the new version's number.

        ``combine`` gets the union of both with ``_old``, true for stored rows, and
        returns one row for each key. With a token (stream, batch) that was merged before nothing happens.
        """
        number, state = self._state()
        if token and state["tokens"].get(token[0], -1) >= token[1]:
            return number
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        fresh = rows.select(*columns)
        touched = [r[0] for r in fresh.select(self._bucket()).distinct().collect()]  # no more than there are buckets
        kept = dict(state["buckets"])
        if touched:
            old = self._rows([kept[str(b)] for b in touched if str(b) in kept])
            whole = combine(old.withColumn("_old", F.lit(True)).unionByName(fresh.withColumn("_old", F.lit(False)))).select(*columns)
            name = f"data/{number + 1:08d}-{uuid.uuid4().hex[:12]}"
            dealt = whole.withColumn("_bucket", self._bucket()).repartition("_bucket", F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(self.files)))
            dealt.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.root}/{name}")
            for b in touched:  # a bucket that lost all its rows has no folder
                kept.pop(str(b), None)
                if self._fs.exists(self._path(f"{self.root}/{name}/_bucket={b}")):
                    kept[str(b)] = f"{name}/_bucket={b}"
        tokens = state["tokens"] | ({token[0]: token[1]} if token else {})
        self._commit(number + 1, {"buckets": kept, "tokens": tokens, "count": self.buckets})
        return number + 1

    def insert_first(self, rows: DataFrame, order: str | None = None, token: tuple[str, int] | None = None) -> int:
        """Rows of keys that aren't there yet; the stored row wins, then the first by ``order``."""
        first = F.struct(~F.col("_old"), *([order] if order else []))
        return self.merge(rows, lambda both: self._one(both, F.min_by, first), token)

    def upsert_latest(self, rows: DataFrame, order: str, token: tuple[str, int] | None = None) -> int:
        """The row of each key with the greatest ``order``; a stored one wins a tie."""
        return self.merge(rows, lambda both: self._one(both, F.max_by, F.struct(F.col(order), F.col("_old"))), token)

    def _one(self, both: DataFrame, pick: Callable, by: Column) -> DataFrame:
        rest = [c for c in both.columns if c not in (*self.keys, "_old")]
        if not rest:
            return both.select(*self.keys).distinct()
        return both.groupBy(*self.keys).agg(pick(F.struct(*rest), by).alias("_r")).select(*self.keys, "_r.*")

    def evict(self, gone: DataFrame) -> int:
        """The store without some keys; only the buckets that hold them are written again."""
        marked = gone.select(*self.keys).distinct()
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns if c not in self.keys]
        rows = marked.select(*self.keys, *(F.lit(None).alias(c) for c in columns))
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self.schema).schema.fields))

        def rest(both: DataFrame) -> DataFrame:
            return self._one(both.join(marked.withColumn("_gone", F.lit(True)), self.keys, "left_anti"), F.min_by, F.col("_old"))

        return self.merge(rows, rest)

    def vacuum(self) -> int:
        """Delete earlier versions and the data that only they use; the number of deleted folders."""
        number, state = self._state()
        used, gone = set(state["buckets"].values()), 0
        folder = self._path(f"{self.root}/data")
        for write in self._fs.listStatus(folder) if number and self._fs.exists(folder) else []:
            name = f"data/{write.getPath().getName()}"
            if not any(u.startswith(f"{name}/") for u in used):
                gone += bool(self._fs.delete(write.getPath(), True))
                continue
            for bucket in self._fs.listStatus(write.getPath()):
                if bucket.isDirectory() and f"{name}/{bucket.getPath().getName()}" not in used:
                    gone += bool(self._fs.delete(bucket.getPath(), True))
        for v in self.versions():
            if v < number:
                self._fs.delete(self._path(f"{self.root}/versions/{v}.json"), False)
        return gone
