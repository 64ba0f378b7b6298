"""Turn reassembly against a plain loop over the batches."""

import hashlib
import random
from collections import defaultdict

import pytest

from doclens.llm import reassembly


def plain(rows, batches=12, quiet=2):
    """The contract's events, one batch after the other."""
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None and t is not None]
    first = {}
    for c, t, _, _ in rows:
        first[c] = min(t, first.get(c, t))
    arriving = [defaultdict(list) for _ in range(batches)]
    for c, t, r, x in rows:
        h = int(hashlib.sha256(f"{c}:{t}".encode()).hexdigest()[:8], 16)
        arriving[h % batches][c, t].append((f"{r}|{x}".encode(), r.encode()))
        if h % 7 < 2:
            arriving[(h + 5) % batches][c, t].append((f"user|{x}".encode(), b"user"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept, released, seen, closed, out = defaultdict(dict), defaultdict(set), {}, set(), []

    def close(c, batch):
        turns = sorted(kept[c])
        rest = ",".join(str(t) for t in turns if t not in released[c])
        breaks = sum(t - 1 in kept[c] and kept[c][t - 1][1] == kept[c][t][1] for t in turns)
        missing = max(turns) - first[c] + 1 - len(turns)
        out.append(("close", c, -1, batch, sha(rest.encode()), missing, breaks))
        closed.add(c)

    for b in range(batches):
        for (c, t), some in arriving[b].items():
            payload, role = min(some)
            if c in closed:
                out.append(("reject", c, t, b, sha(payload), None, None))
                continue
            seen[c] = b
            kept[c].setdefault(t, (payload, role))
        for c in seen.keys() - closed:
            t = first[c]
            while t in kept[c]:
                if t not in released[c]:
                    released[c].add(t)
                    out.append(("release", c, t, b, sha(kept[c][t][0]), None, None))
                t += 1
            if b - seen[c] >= quiet:
                close(c, b)
    for c in seen.keys() - closed:
        close(c, batches)
    return sorted(out, key=str)


def test_events_equal_a_plain_loop(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for c in [*range(30), -7, 2**62]:
        start, n = rnd.choice([0, 0, 1, -3, 10**12]), rnd.choice([1, 2, 5, 9])
        for t in range(start, start + n):
            if rnd.random() < 0.9:
                rows.append((c, t, rnd.choice(["user", "assistant", "", None, "us|er"]), rnd.choice(["", None, "ä|b", "x" * 40_000, "日本", "a\nb"])))
    rows += [(c, t, r, x) for c, t, r, x in rows[:20]] + [(c, t, "user", "other") for c, t, _, _ in rows[5:15]]  # repeats and other payloads
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(150)]  # a hot conversation
    rows += [(None, 1, "user", "x"), (3, None, "user", "x"), (98, None, None, None)]
    data = [(*r, "first", 1) for r in rows]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string, first string, batch int").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in reassembly.turns(spark, str(tmp_path)).select("event", "conv_id", "turn", "batch", "sha256", "n_missing", "n_breaks").collect()]
    want = plain(rows)
    assert sorted(got, key=str) == want
    assert {e[0] for e in want} == {"release", "reject", "close"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_close_by_an_empty_batch_and_an_empty_table(spark):
    schema = "conv_id long, turn long, first long, role string, payload string, batch int"
    rows = [(1, 0, 0, "user", "user|a", 0), (1, 2, 0, "user", "user|c", 0)]
    got = sorted(tuple(r) for r in reassembly.reassemble(spark.createDataFrame(rows, schema), quiet=1, batches=2).select("event", "turn", "batch", "payload", "n_missing").collect())
    assert got == [("close", -1, 1, None, 1), ("release", 0, 0, "user|a", None)]
    assert reassembly.reassemble(spark.createDataFrame([], schema), batches=1).count() == 0


@pytest.mark.parametrize("turns", [[5], [5, 7, 9], [-(2**40), 4]])
def test_first_turn_of_a_salted_conversation(spark, turns):
    rows = reassembly.with_first(spark.createDataFrame([(1, t) for t in turns], "conv_id long, turn long")).collect()
    assert sorted(r["turn"] for r in rows) == sorted(turns) and {r["first"] for r in rows} == {min(turns)}


def test_one_store_a_partition_and_equal_turns_of_a_batch(spark, monkeypatch, tmp_path):
    """Each store that is opened costs an executor memory that does not come back, so a start opens one for a partition."""
    monkeypatch.setattr(reassembly, "new_folder", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(reassembly, "stored", lambda df, _: df)
    schema = "conv_id long, turn long, first long, role string, payload string, batch int"
    rows = [(1, 0, 0, "user", "user|b", 0), (1, 0, 0, "user", "user|a", 0), (1, 0, 0, "user", "user|A", 1), (1, 2, 0, "user", "user|c", 0), (1, 2, 0, "user", "user|d", 1), (1, 1, 0, "user", "user|e", 1), (None, 1, 1, "user", "user|x", 1)]
    got = sorted(tuple(r) for r in reassembly.reassemble(spark.createDataFrame(rows, schema), batches=2).select("event", "turn", "batch", "payload", "n_missing", "n_breaks").collect())
    assert got == [("close", -1, 2, None, 0, 2), ("release", 0, 0, "user|a", None, None), ("release", 1, 1, "user|e", None, None), ("release", 2, 1, "user|c", None, None)]
    assert [p.name for p in (tmp_path / "turns" / "checkpoint" / "state").iterdir() if p.is_dir() and not p.name.startswith((".", "_"))] == ["0"]


@pytest.mark.parametrize("most_bytes", [reassembly.MOST_BYTES, 300])
def test_the_stream_itself_lets_the_smallest_payload_arrive(spark, tmp_path, most_bytes):
    """the smallest payload of a batch was picked before the streaming query, which took any first row and rejected each repeat."""
    rows = [(1, t, 0, "user", f"user|{p}{t}", b) for t in range(9) for p in ("b", "ä", "a", "c") for b in (t % 2,)]
    rows += [(1, 3, 0, "user", "user|0", 5), (1, 3, 0, "tool", "user|0", 5), (1, 3, 0, "user", "user|1", 5)]
    with reassembly._settings(spark):
        for b in (0, 1, 5):
            moment = f"timestamp_seconds(if(conv_id is null and {b} = 5, 99, {b + 1})) ts"
            now = [r for r in rows if r[-1] == b] + [(None, None, None, None, None, b)]
            spark.createDataFrame(now, "conv_id long, turn long, first long, role string, payload string, batch int").selectExpr("conv_id", "turn", "first", "role", "payload", moment, "batch").coalesce(1).write.parquet(str(tmp_path / f"in/batch={b}"))
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(b == 5).lower())
            found = reassembly.events(spark.readStream.schema(reassembly.ARRIVAL).parquet(str(tmp_path / "in")), most_bytes=most_bytes)
            found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(reassembly.EVENT).parquet(str(tmp_path / "out")).select("event", "turn", "batch", "payload").collect())
    want = [("release", t, t > 0, f"user|a{t}") for t in range(9)] + [("close", -1, 3, None), ("reject", 3, 5, "user|0")]
    assert got == sorted(want, key=lambda e: e[:3])
