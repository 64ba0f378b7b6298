"""Size-tiered compaction of immutable shards under a versioned manifest.

A run is a folder of Parquet files that is never changed. An arrival becomes a small run; as soon as FAN runs are
of similar size (within one tier, a power of FAN of the least size) they are merged into files of about the target size.
A manifest version lists the live runs. It is committed by creating its file, complete, under a name that
must not exist yet; of two writers that prepare the same version one fails and tries again on the newer one. That
needs a file system whose rename is atomic and does not overwrite, as HDFS's; on a local one a hard link does the
same. An object store without such a rename must not be used by several writers.

Readers take the newest version, or any that is retained, and never see half a merge. A merge deletes nothing: runs go
by ``expire`` alone, which drops all versions but the newest ones and then the runs that only those dropped listed. A reader of
an expired version fails; one of a retained version never loses a file.

Rows keep all their columns and values; nulls, empty and long texts, repeated rows and empty arrivals
included. What reaches the driver is the list of runs, whose number grows as the logarithm of the data.
All data moves through Spark's readers and writers.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import new_folder, table

TARGET_BYTES = 128 << 20
LEAST_BYTES = 1 << 20
FAN = 4
ARRIVALS = 12
#: Versions that the query's store keeps.
RETAINED = 8


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    merged: int = 0

    def tier(self, least: int = LEAST_BYTES, fan: int = FAN) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / least, fan) + 0.5)) if self.bytes > least else 0


class Store:
    """Runs and manifests below one folder of a file system that all machines share."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, least: int = LEAST_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.least, self.fan = spark, root.rstrip("/"), target, least, fan
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        return max(self.versions(), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        v = self.version() if version is None else version
        if not v:
            return []
        reader = self.fs.open(self._path(f"manifests/v{v:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
        finally:
            reader.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, version: int, runs: list[Run]) -> int:
        """Make ``runs`` the version after ``version``. The file appears whole or not at all."""
        body = json.dumps({"version": version + 1, "runs": [asdict(r) for r in runs]}, sort_keys=True)
        to, part = self._path(f"manifests/v{version + 1:012d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        try:
            self._move(part, to)
        except Exception as e:
            raise Conflict(f"version {version + 1} exists") if self.fs.exists(to) else e
        finally:
            self.fs.delete(part, False)
        return version + 1

    def _move(self, part, to) -> None:
        """Give the file its name; fails if the name exists."""
        if self.fs.getUri().getScheme() == "file":
            # the local rename looks first and then renames, so two writers could both succeed
            os.link(part.toUri().getPath(), to.toUri().getPath())
            return
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(part, to, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _bytes(self, path: str) -> int:
        return self.fs.getContentSummary(self.jvm.org.apache.hadoop.fs.Path(path)).getLength()

    def _change(self, drop: list[Run], add: list[Run]) -> int:
        """Replace runs, on whatever version is newest; fails if one to drop is gone."""
        while True:
            v = self.version()
            now = self.runs(v)
            if not set(drop) <= set(now):
                raise Conflict("a run to be merged is no longer live")
            try:
                return self.commit(v, [r for r in now if r not in drop] + add)
            except Conflict:
                continue

    def append(self, rows: DataFrame) -> int:
        """One arrival."""
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self._change([], [Run(path, self._bytes(path))])

    def append_each(self, rows: DataFrame, arrival: str) -> list[str]:
        """Write many arrivals in one pass, told apart by a column of few values; returns their folders, uncommitted."""
        top = f"{self.root}/runs/{uuid.uuid4().hex}"
        rows.write.partitionBy(arrival).parquet(top)
        return sorted(s.getPath().toString() for s in self.fs.listStatus(self.jvm.org.apache.hadoop.fs.Path(top)) if s.isDirectory())

    def similar(self) -> list[Run]:
        """The smallest tier's first FAN runs, or none."""
        tiers: dict[int, list[Run]] = {}
        for r in self.runs():
            tiers.setdefault(r.tier(self.least, self.fan), []).append(r)
        return next((tiers[t][: self.fan] for t in sorted(tiers) if len(tiers[t]) >= self.fan), [])

    def compact(self) -> int:
        """Merge until no tier has FAN runs; the number of merges."""
        n = 0
        while some := self.similar():
            total = sum(r.bytes for r in some)
            path = f"{self.root}/runs/{uuid.uuid4().hex}"
            # whole partitions are put together, so no row is shuffled
            self._read(some).coalesce(max(1, math.ceil(total / self.target))).write.parquet(path)
            try:
                self._change(some, [Run(path, self._bytes(path), max(r.merged for r in some) + 1)])
            except Conflict:  # another writer merged them first
                self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)
                continue
            n += 1
        return n

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def expire(self, keep: int = RETAINED) -> int:
        """Drop all but the newest ``keep`` versions, and the runs that none of the kept lists; the number of runs deleted."""
        every = self.versions()
        gone, kept = every[: len(every) - max(keep, 1)], every[len(every) - max(keep, 1) :]
        live = {r.path for v in kept for r in self.runs(v)}
        dead = {r.path for v in gone for r in self.runs(v)} - live
        # manifests first: what no manifest lists is never opened
        for v in gone:
            self.fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        for path in sorted(dead):
            self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)
        return len(dead)

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[r.path for r in runs]) if hasattr(self, "schema") else self.spark.read.parquet(*[r.path for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.runs(version))


def shard(docs: DataFrame, root: str, arrivals: int = ARRIVALS, key: str = "doc_id") -> Store:
    """Take documents in as ``arrivals`` arrivals, dealt by a hash of the key, compacting after each."""
    store = Store(docs.sparkSession, root)
    store.schema = docs.schema
    mark = "_arrival"
    while mark in docs.columns:
        mark += "_"
    for path in store.append_each(docs.withColumn(mark, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(arrivals))), mark):
        store._change([], [Run(path, store._bytes(path))])
        store.compact()
    store.expire()
    return store


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: documents as the newest manifest has them after all arrivals."""
    store = shard(table(spark, sf_dir, "documents"), new_folder(spark, "shards"))
    rows = store.read() if store.runs() else table(spark, sf_dir, "documents").limit(0)
    return rows.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


SQL = "SELECT doc_id, lang, source, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"
