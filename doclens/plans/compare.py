"""One analysis in several ways, as few or many partitions and calls at a time: how long each takes, and whether their results are equal.

Times are taken with a store of answers for each way, so that every way makes its own calls. For the comparison all ways share one store:
a model may answer twice in two ways, which says nothing about the engine. A judge without a model needs one run of each way for both.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens import storage
from doclens.plans import pipeline
from doclens.plans.progress import Event
from doclens.settings import Settings


@dataclass(frozen=True)
class Way:
    """partitions of the documents and of shuffles; calls of the model at a time."""

    name: str
    partitions: int
    concurrency: int = 1


@dataclass(frozen=True)
class Timing:
    """Seconds of a way's run in all, and from the start to each event that it told, in order."""

    way: Way
    seconds: float
    events: tuple[tuple[str, float], ...]


@dataclass
class Comparison:
    """differences: (channel, doc_id, row, first, other, other_way): rows, as JSON, that the first way and another have a different number of times."""

    timings: list[Timing]
    differences: DataFrame
    kept: list[str]

    def release(self) -> None:
        for path in self.kept:
            storage.remove(self.differences.sparkSession, path)


@contextmanager
def _partitions(spark: SparkSession, n: int):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def as_rows(result: pipeline.Analysis) -> DataFrame:
    """(channel, doc_id, row) of findings and observations; a row is JSON, nulls included."""

    def rows(df: DataFrame, channel: str) -> DataFrame:
        own = F.to_json(F.struct(*sorted(c for c in df.columns if c != "doc_id")), {"ignoreNullFields": "false"})
        return df.select(F.lit(channel).alias("channel"), F.col("doc_id").cast("string").alias("doc_id"), own.alias("row"))

    return rows(result.findings, "finding").unionByName(rows(result.observations, "observation"))


def run(docs: DataFrame, way: Way, settings: Settings, call: Callable | None = None) -> tuple[DataFrame, list[str], Timing]:
    """The written rows of one way, the folders to delete, and its times."""
    spark, told = docs.sparkSession, []
    with _partitions(spark, way.partitions):
        began = time.perf_counter()
        analyzer = pipeline.build(spark, replace(settings, concurrency=way.concurrency), call=call, progress=lambda e: told.append((e.stage, time.perf_counter() - began)) if isinstance(e, Event) else None)
        result = analyzer.documents(docs.repartition(way.partitions))
        try:
            rows, path = storage.stored(as_rows(result), "compared")
        finally:
            result.release()
        return rows, [path], Timing(way, time.perf_counter() - began, tuple(told))


def differences(first: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Rows whose number differs; none where the two are equal as bags. One shuffle of both by the whole row, counted before it."""
    marked = first.withColumn("_n", F.lit(0)).unionByName(other.withColumn("_n", F.lit(1)))
    counted = marked.groupBy("channel", "doc_id", "row").agg(F.sum(1 - F.col("_n")).alias("first"), F.sum("_n").alias("other"))
    return counted.where(F.col("first") != F.col("other")).withColumn("other_way", F.lit(name))


def compare(docs: DataFrame, ways: Sequence[Way], settings: Settings | None = None, call: Callable | None = None) -> Comparison:
    """Run documents (doc_id, text) in every way; the first is what the others are held against."""
    if len(ways) < 2:
        raise ValueError("two ways at least are compared")
    spark = docs.sparkSession
    own = settings or Settings.of(spark)
    base = f"{storage.shared_dir(spark)}/compare-{uuid.uuid4().hex}"
    kept, timings, found = [base], [], []
    asks = own.model != "rules"
    for i, way in enumerate(ways):
        rows, paths, timing = run(docs, way, replace(own, store_path=f"{base}/own-{i}"), call)
        kept += paths
        timings.append(timing)
        found.append(rows)
    if asks:
        found = []
        for way in ways:
            rows, paths, _ = run(docs, way, replace(own, store_path=f"{base}/shared"), call)
            kept += paths
            found.append(rows)
    every = differences(found[0], found[1], ways[1].name)
    for rows, way in zip(found[2:], ways[2:], strict=True):
        every = every.unionByName(differences(found[0], rows, way.name))
    return Comparison(timings, every, kept)


def summary(result: Comparison) -> tuple[list[str], bool]:
    """Lines to print, and whether all ways gave the same rows."""
    first = result.timings[0]
    lines = [f"{t.way.name}: {t.way.partitions} partitions, {t.way.concurrency} calls at a time, {t.seconds:.2f} s, {first.seconds / t.seconds:.2f} times as fast" for t in result.timings]
    by_way = {r["other_way"]: r["n"] for r in result.differences.groupBy("other_way").agg(F.count("*").alias("n")).collect()}
    lines += [f"{t.way.name} against {first.way.name}: " + (f"{by_way[t.way.name]} rows differ" if t.way.name in by_way else "the same rows") for t in result.timings[1:]]
    return lines, not by_way
