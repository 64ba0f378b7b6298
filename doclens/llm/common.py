"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker; the workers' memory follows from it.
ARROW_BATCH_BYTES = 8 << 20
#: Bytes of text that a Python worker handles at once; a longer text is a slice of its own.
SLICE_CHARS = 1 << 18
#: Nodes whose edges are kept out of the shuffle of a star step, at most; each has more than HUB_EDGES edges.
MOST_HUBS, HUB_EDGES = 50_000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Keep the batches sent to Python workers small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


@lru_cache(1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives the memory it freed back to the system, as workers outlive their tasks."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Only a local session without one gets one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    if not path:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="doclens-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


#: Folders made in the scratch scopes that are open, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are made inside go at the end; what is needed later must have been written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    return stored_at(df, new_folder(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names, in any letter case: what an operator appends takes their place."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone))


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it or begins with it."""
    have = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in have):
        name = "_" + name
    return name


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``chars`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // chars
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def fold(name: str, mod: int):
    """crc32 of the document's id as text, modulo ``mod``."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % mod


def _with_least(edges: DataFrame, hub_edges: int) -> DataFrame:
    """(u, v, m): every edge with the least v of its u.

    A node with more than ``hub_edges`` edges is a hub: its edges stay where they are and get m from a
    broadcast table, so they never meet in one task. Hubs are at most edges / hub_edges in number.
    """
    facts = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(facts.where(F.col("n") > hub_edges).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    marked = edges.join(hubs, F.col("u") == F.col("hub"), "left")
    plain = marked.where("hub is null").select("u", "v").join(facts.where(F.col("n") <= hub_edges).select("u", "m"), "u")
    return plain.select("u", "v", "m").unionByName(marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: two long columns without nulls; self edges are allowed. Returns (node, root) with the
    least node of each component as root, for every node that has an edge. Each round is written
    to the shared folder and replaces the one before; nothing but a count and a checksum reaches the driver.
    """
    spark = edges.sparkSession
    path = new_folder(spark, "cc")
    now = stored_at(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    mark, n = None, now.count()
    for _ in range(rounds):
        hub = max(HUB_EDGES, 2 * n // MOST_HUBS)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", "m")
        large = _with_least(both, hub).where("v > u").select(F.col("v").alias("u"), least.alias("v")).where("u != v").distinct()
        # every edge (u, v) now has v < u
        small = _with_least(large, hub).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        old, path = path, new_folder(spark, "cc")
        now = stored_at(small, path)
        remove(spark, old)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = seen[0]
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return ends.groupBy("node").agg(F.min("root").alias("root"))
