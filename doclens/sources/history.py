"""Stored analyses: append, list newest first, read one, delete some, compact; and the responses' store.

A store is a folder of runs. A run is written beside the others and then moved in at once under a number of its own, so a reader sees all
of it or nothing, and a lost writer leaves no half run. ``rows-N`` has records, ``gone-N`` the ids that a deletion took: these hide
records of lower numbers, so a record saved again later is there. ``base-N`` has what was left of the runs that its list names, whose
own folders no longer count; a run that appears meanwhile is on no list and stays. Each record keeps the number that it was saved under.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions import text as t

RECORD = "id string, created_at string, kind string, title string, counts map<string,bigint>, source string, result string"
_COVERS = "_covers"


def records(results: DataFrame, kind: str, at: str) -> DataFrame:
    """Records from (doc_id, text, result, counts columns)."""
    counts = F.create_map(*(x for c in ("toplam", "imla", "dil_bilgisi", "ton", "tutarlilik") for x in (F.lit(c), F.col(c))))
    return results.select(F.sha2(F.concat_ws("\u0000", F.col("doc_id").cast("string"), F.lit(at)), 256).alias("id"), F.lit(at).alias("created_at"), F.lit(kind).alias("kind"), t.make_title("text").alias("title"), counts.alias("counts"), F.col("text").alias("source"), "result")


class _Folder:
    """A store's folder, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.fs.exists(self._at(name)) else []

    def claim(self) -> int:
        """A number that is this writer's alone: a file can be made once only."""
        n = max((int(x) for x in self.names("_numbers") if x.isdigit()), default=0) + 1
        while not self.fs.createNewFile(self._at(f"_numbers/{n}")):
            n += 1
        return n

    def put(self, rows: DataFrame, kind: str, n: int, covers: Iterable[str] = ()) -> None:
        """Write a run beside the others and move it in."""
        part = f"_staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        for name in covers:
            self.fs.mkdirs(self._at(f"{part}/{_COVERS}/{name}"))
        if not self.fs.rename(self._at(part), self._at(f"{kind}-{n}")):
            raise OSError(f"could not add {kind}-{n} to {self.path}")

    def covered(self) -> dict[str, set[str]]:
        return {b: set(self.names(f"{b}/{_COVERS}")) for b in self.names() if b.startswith("base-")}

    def live(self) -> list[str]:
        hidden = set().union(*self.covered().values())
        return [x for x in self.names() if x.split("-")[0] in ("rows", "base", "gone") and x not in hidden]

    def read(self, names: list[str]) -> DataFrame:
        """Records of the runs that no deletion of theirs hides, with their numbers."""
        own = lambda schema, *kinds: self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*(f"{self.path}/{x}" for x in names if x.split("-")[0] in kinds))
        some = lambda *kinds: any(x.split("-")[0] in kinds for x in names)
        form = f"{RECORD}, seq long"
        rows = own(form, "rows", "base") if some("rows", "base") else self.spark.createDataFrame([], form)
        if not some("gone"):
            return rows
        gone = own("id string, upto long", "gone").groupBy("id").agg(F.max("upto").alias("upto"))
        return rows.join(gone, (rows["id"] == gone["id"]) & (rows["seq"] <= gone["upto"]), "left_anti")


def save(rows: DataFrame, path: str) -> None:
    """Append; the records of a call appear together."""
    store = _Folder(rows.sparkSession, path)
    n = store.claim()
    store.put(rows.withColumn("seq", F.lit(n).cast("long")), "rows", n)


def load(spark: SparkSession, path: str) -> DataFrame:
    """All records that were not deleted; none where there is no store."""
    store = _Folder(spark, path)
    return store.read(store.live()).drop("seq")


def listing(rows: DataFrame) -> DataFrame:
    """Everything but the payload, newest first; a missing date comes last."""
    return rows.select("id", "created_at", "kind", "title", "counts").orderBy(F.desc(F.coalesce("created_at", F.lit(""))), "id")


def get(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("id") == key)


def without(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where(~F.col("id").isin(keys))


def delete(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Delete records from the store; the number deleted. Their ids are written, the records are not touched until the store is compacted."""
    store = _Folder(spark, path)
    found = store.read(store.live()).where(F.col("id").isin(keys)).agg(F.count("*").alias("n"), F.collect_set("id").alias("ids")).first()
    if found["n"]:
        n = store.claim()
        store.put(spark.createDataFrame([(i, n) for i in sorted(found["ids"])], "id string, upto long"), "gone", n)
    return found["n"]


def compact(spark: SparkSession, path: str) -> int:
    """Put the live runs into one without what was deleted; the number of runs that it replaces. Readers and writers go on meanwhile."""
    store = _Folder(spark, path)
    live = store.live()
    if len(live) > 1:
        store.put(store.read(live), "base", store.claim(), live)
    return len(live) if len(live) > 1 else 0


def vacuum(spark: SparkSession, path: str, older_than_s: float = 7 * 86_400) -> int:
    """Delete the folders of replaced runs and of lost writers that were last changed so long ago; the number deleted.

    A base's list goes with its folder only once a later base has replaced it, and then the runs that it named go with it.
    """
    store = _Folder(spark, path)
    covers = store.covered()
    replaced = set().union(*covers.values())
    old = lambda x: time.time() - store.fs.getFileStatus(store._at(x)).getModificationTime() / 1000 >= older_than_s
    inner = {x: sorted(covers.get(x, ())) for x in replaced if x in store.names() and old(x)}
    n = 0
    for x in sorted(inner, key=lambda x: x.startswith("base-")):  # what a base names goes before the base
        present = set(store.names())
        if not any(y in present for y in inner[x]):
            n += bool(store.fs.delete(store._at(x), True))
    return n + sum(bool(store.fs.delete(store._at(f"_staging/{x}"), True)) for x in store.names("_staging") if old(f"_staging/{x}"))


def store_responses(new: DataFrame, path: str) -> None:
    """Append successful responses; readers take the first of a key."""
    new.where("status = 'ok'").select("key", "response").write.mode("append").json(path)
