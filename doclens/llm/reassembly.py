"""Conversation turn reassembly by a stateful operator of a streaming query.

Arrivals come in numbered batches, as they are, repeats included. Keyed by conversation, the *arbiter* lets a turn arrive once in a batch, with
its smallest payload; the *sequencer* behind it keeps a turn's first payload, releases the gapless run from the conversation's first turn,
closes a conversation that had no arrival for ``QUIET`` batches, and rejects what arrives after that. Kept are the turns before the next one
to release, and those that wait.

Batches are event time: batch b stands at second b + 1, each holds a clock row, so the watermark also moves over an
empty batch, and a conversation's timer falls due with the very batch that makes it quiet: it closes before the next batch's
rows. The last batch's clock row stands behind every timer and so ends the rest.
State lies in RocksDB: for each conversation seven numbers and the turns that wait, and while a batch runs what its arbiter no longer has room for. Spark leaves about half a MB of an executor's memory (RocksDB's
counters) behind for every store that it opens, and every start opens one for each partition and stateful operator; so both work in one such operator.
Of a key's rows in a batch ``MOST_BYTES`` at most are in memory; of a closing conversation only the waiting turns' numbers are.

Defined cases: rows without a conversation or a turn belong nowhere and are dropped; a null role or text is empty. Of
equal turns in a batch the one with the smallest payload arrives (then the smallest role). An empty table gives no
rows. Turns may be negative and have gaps of any size. Other columns are left out. A conversation stays closed.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from doclens.llm.common import new_folder, stored, table

BATCHES = 12
#: Successive batches without an arrival after which a conversation closes.
QUIET = 2
#: Parts of a conversation when its first turn is found and handed out.
SALTS = 64
#: Bytes of a conversation's arrivals in a batch that wait in memory for smaller payloads of their turns; the others wait in state.
MOST_BYTES = 4 << 20

ARRIVAL = "conv_id long, turn long, first long, role string, payload string, ts timestamp, batch int"
EVENT = "event string, conv_id long, turn long, batch long, payload string, unreleased_sha256 string, n_missing long, n_breaks long"

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # every start has stores of its own; those of earlier starts must not wait in memory
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # twice as many small files for each store and batch; the shared folder's file system has checksums of its own
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    # a timer fires at the start of the next batch, whose rows know it; the last batch is followed by one without rows
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Arbiter:
    """Of the rows that a conversation gets in a batch, each turn's with the smallest payload, then role, by their bytes."""

    def __init__(self, handle: StatefulProcessorHandle, most: int):
        self.most = most
        self.arriving = handle.getMapState("arriving", "turn long", "first long, role string, payload string, batch int")

    def least(self, rows: Iterator[Row]) -> Iterator[Row]:
        some, size, n_stored = {}, 0, 0
        for r in rows:
            had = some.get(r["turn"])
            if had is None or self._bytes(r) < self._bytes(had):
                some[r["turn"]] = r
                size += sum(map(len, self._bytes(r))) + 200 * (had is None)
            if size > self.most:
                n_stored += self._store(some, n_stored)
                some, size = {}, 0
        if not n_stored:
            yield from some.values()
            return
        self._store(some, n_stored)
        for (turn,), (first, role, payload, batch) in self.arriving.iterator():
            yield Row(turn=turn, first=first, role=role, payload=payload, batch=batch)
        self.arriving.clear()

    @staticmethod
    def _bytes(r: Row | dict[str, str | None]) -> tuple[bytes, bytes]:
        return (r["payload"] or "").encode(), (r["role"] or "").encode()

    def _store(self, some: dict[int, Row], n_stored: int) -> int:
        """Put rows into the state where they are the smallest; the number of them that are new there."""
        new = 0
        for turn, r in some.items():
            had = n_stored and self.arriving.containsKey((turn,))
            if had:
                _, role, payload, _ = self.arriving.getValue((turn,))
                if self._bytes({"payload": payload, "role": role}) <= self._bytes(r):
                    continue
            self.arriving.updateValue((turn,), (r["first"], r["role"], r["payload"], r["batch"]))
            new += not had
        return new


class Sequencer(StatefulProcessor):
    """Key conv_id: keeps first payloads, releases turns in order, closes quiet conversations, rejects what comes after."""

    def __init__(self, quiet: int = QUIET, batches: int = BATCHES, most_bytes: int = MOST_BYTES):
        self.quiet, self.batches, self.most_bytes = quiet, batches, most_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.arbiter = handle, Arbiter(handle, self.most_bytes)
        # due: the batch that closes it; null: closed
        self.facts = handle.getValueState("facts", "next long, last_role string, n_waiting long, n_kept long, max_kept long, n_breaks long, due int")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, payload string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        def event(kind: str, turn: int, batch: int, payload: str | None) -> Row:
            return Row(event=kind, conv_id=key[0], turn=turn, batch=batch, payload=payload, unreleased_sha256=None, n_missing=None, n_breaks=None)

        if key[0] is None:  # the clock
            return
        facts, open_, batch = self.facts.get(), True, 0
        if facts is not None:
            nxt, last, n_waiting, n_kept, most, breaks, due = facts
            open_ = due is not None
        else:
            nxt, last, n_waiting, n_kept, most, breaks, due = None, None, 0, 0, None, 0, -1
        for r in self.arbiter.least(rows):
            batch = r["batch"]
            if open_ and 0 <= due < batch:  # its timer fires behind these rows, but it is closed before them
                self.handle.deleteTimer(self._at(due))
                yield self._closed(key)
                open_ = False
            if not open_:
                yield event("reject", r["turn"], batch, r["payload"])
                continue
            nxt = r["first"] if nxt is None else nxt
            turn, role, payload = r["turn"], r["role"], r["payload"]
            if turn < nxt or n_waiting and turn <= most and self.waiting.containsKey((turn,)):  # kept before
                continue
            n_kept, most = n_kept + 1, turn if most is None else max(most, turn)
            if turn != nxt:
                self.waiting.updateValue((turn,), (role, payload))
                n_waiting += 1
                continue
            while True:
                yield event("release", nxt, batch, payload)
                breaks, last, nxt = breaks + (role == last), role, nxt + 1
                if not n_waiting or not self.waiting.containsKey((nxt,)):
                    break
                role, payload = self.waiting.getValue((nxt,))
                self.waiting.removeKey((nxt,))
                n_waiting -= 1
        if open_:
            again = batch + self.quiet
            if due != again:
                if due >= 0:
                    self.handle.deleteTimer(self._at(due))
                self.handle.registerTimer(self._at(again))
            self.facts.update((nxt, last, n_waiting, n_kept, most, breaks, again))

    @staticmethod
    def _at(due: int) -> int:
        """Milliseconds that lie between the batch before and the due one."""
        return (due + 1) * 1000 - 500

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due = self.facts.get()[-1]
        if due is not None and expiredTimerInfo.getExpiryTimeInMs() == self._at(due):
            yield self._closed(key)

    def _closed(self, key: Any) -> Row:
        nxt, last, n_waiting, n_kept, most, breaks, due = self.facts.get()
        turns, roles, names = array("q"), array("q"), {}
        if n_waiting:
            for (turn,), (role, _) in self.waiting.iterator():
                turns.append(turn)
                roles.append(names.setdefault(role, len(names)))
            self.waiting.clear()
        digest, before, its = hashlib.sha256(), nxt - 1, names.get(last, -1) if last is not None else -1
        for k, i in enumerate(sorted(range(len(turns)), key=turns.__getitem__)):
            digest.update(f"{',' * (k > 0)}{turns[i]}".encode())
            breaks += turns[i] == before + 1 and roles[i] == its
            before, its = turns[i], roles[i]
        missing = most - (nxt - 1) - len(turns) if len(turns) else 0
        self.facts.update((nxt, None, 0, n_kept, most, 0, None))
        return Row(event="close", conv_id=key[0], turn=-1, batch=min(due, self.batches), payload=None, unreleased_sha256=digest.hexdigest(), n_missing=missing, n_breaks=breaks)

    def close(self) -> None:
        pass


def with_first(rows: DataFrame) -> DataFrame:
    """Append ``first``, the smallest turn of the row's conversation; a hot conversation is joined in ``SALTS`` parts."""
    salted = rows.withColumn("_salt", F.pmod(F.hash("turn"), F.lit(SALTS)))
    parts = salted.groupBy("conv_id", "_salt").agg(F.min("turn").alias("m"))
    facts = parts.groupBy("conv_id").agg(F.min("m").alias("first"), F.collect_set("_salt").alias("salts"))
    return salted.join(facts.select("conv_id", "first", F.explode("salts").alias("_salt")), ["conv_id", "_salt"]).drop("_salt")


def arrivals(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The arrivals of the query's contract: a batch for each turn by its hash, and repeats for two in seven of them."""
    h = F.conv(F.substring(F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).where("conv_id is not null and turn is not null")
    own = F.struct((F.col("h") % batches).cast("int").alias("batch"), F.col("role"))
    again = F.struct(((F.col("h") + 5) % batches).cast("int").alias("batch"), F.lit("user").alias("role"))
    each = rows.withColumn("h", h).select("conv_id", "turn", "text", F.explode(F.when(F.col("h") % 7 < 2, F.array(own, again)).otherwise(F.array(own))).alias("a"))
    each = each.select("conv_id", "turn", "a.batch", "a.role", F.concat("a.role", F.lit("|"), "text").alias("payload"))
    return with_first(each)


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def events(stream: DataFrame, quiet: int = QUIET, batches: int = BATCHES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The streaming plan: arrivals with columns ``ARRIVAL``, as they come, to events with columns ``EVENT``."""
    return stream.withWatermark("ts", "0 seconds").groupBy("conv_id").transformWithState(Sequencer(quiet, batches, most_bytes), EVENT, "Append", "EventTime")


def reassemble(arriving: DataFrame, quiet: int = QUIET, batches: int = BATCHES) -> DataFrame:
    """Events of the arrivals (conv_id, turn, first, role, payload, batch from 0 to ``batches`` - 1), of which a turn may have several in a batch.

    The batches are written once, below a new folder that all machines share. One after the other is moved into the folder that the
    query watches, and the query is started anew on its checkpoint for each; a start that fails can be repeated.
    """
    spark = arriving.sparkSession
    root = new_folder(spark, "turns")
    clock = spark.range(batches).selectExpr("null conv_id", "null turn", "null first", "null role", "null payload", "cast(id as int) batch")
    own = arriving.where("conv_id is not null and turn is not null").select("conv_id", "turn", "first", "role", "payload", F.col("batch").cast("int").alias("batch"))
    rows = stored(own, "arrivals").unionByName(clock)
    at_end = F.col("conv_id").isNull() & (F.col("batch") == batches - 1)
    moment = F.timestamp_seconds(F.when(at_end, batches + quiet + 1).otherwise(F.col("batch") + 1))
    rows.withColumn("ts", moment).write.partitionBy("batch").parquet(f"{root}/all")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/in"))
    with _settings(spark):
        for b in range(batches):
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(b == batches - 1).lower())
            if not fs.rename(path(f"{root}/all/batch={b}"), path(f"{root}/in/batch={b}")):
                raise RuntimeError(f"batch {b} could not be moved to {root}/in")
            found = events(spark.readStream.schema(ARRIVAL).parquet(f"{root}/in"), quiet, batches)
            query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/events")
            query.awaitTermination()
    return spark.read.schema(EVENT).parquet(f"{root}/events")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: events of all conversations, with digests in place of payloads."""
    found = reassemble(arrivals(table(spark, sf_dir, "conversations")))
    return found.select("event", "conv_id", "turn", "batch", F.coalesce("unreleased_sha256", F.sha2("payload", 256)).alias("sha256"), "n_missing", "n_breaks")


SQL = """
with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, ('0x' || substr(sha256(conv_id || ':' || turn), 1, 8))::bigint h
           from conversations where conv_id is not null and turn is not null),
firsts as (select conv_id, min(turn) f from t group by 1),
each as (select conv_id, turn, h % 12 batch, role, role || '|' || text payload from t
         union all select conv_id, turn, (h + 5) % 12, 'user', 'user|' || text from t where h % 7 < 2),
arr as (select * from each qualify row_number() over (partition by conv_id, turn, batch order by encode(payload), encode(role)) = 1),
days as (select conv_id, batch, lead(batch) over (partition by conv_id order by batch) later from (select distinct conv_id, batch from arr)),
ends as (select conv_id, least(coalesce(min(batch + 2) filter (where later > batch + 2 or later is null), 12), 12) b from days group by 1),
kept as (select a.* from arr a join ends e using (conv_id) where a.batch <= e.b qualify row_number() over (partition by conv_id, turn order by batch) = 1),
runs as (select k.*, f.f, k.turn - f.f = row_number() over (partition by k.conv_id order by k.turn) - 1 gapless,
                max(k.batch) over (partition by k.conv_id order by k.turn) ready,
                lag(k.turn) over (partition by k.conv_id order by k.turn) turn0, lag(k.role) over (partition by k.conv_id order by k.turn) role0
         from kept k join firsts f using (conv_id))
select 'release' event, conv_id, turn, ready::bigint batch, sha256(payload) sha256, null::bigint n_missing, null::bigint n_breaks from runs where gapless
union all
select 'reject', a.conv_id, a.turn, a.batch::bigint, sha256(a.payload), null, null from arr a join ends e using (conv_id) where a.batch > e.b
union all
select 'close', r.conv_id, -1, any_value(e.b)::bigint, sha256(coalesce(string_agg(r.turn::varchar, ',' order by r.turn) filter (where not gapless), '')),
       (max(r.turn) - any_value(r.f) + 1 - count(*))::bigint, count(*) filter (where r.turn0 = r.turn - 1 and r.role0 = r.role)
from runs r join ends e using (conv_id) group by r.conv_id
"""
