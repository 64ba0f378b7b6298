"""The store of answers: newest answer, pruned look-ups, compaction."""

import glob

from doclens.sources import responses


def answers(spark, rows):
    return spark.createDataFrame(rows, "key string, response string")


def stored(spark, path):
    return {r["key"]: r["response"] for r in responses.read(spark, path).collect()}


def test_a_newer_answer_replaces_an_older_one(spark, tmp_path):
    path = str(tmp_path / "s")
    assert stored(spark, path) == {} and responses.look_up(answers(spark, [("k", "")]), path).count() == 0
    responses.put(answers(spark, [("k", "one"), ("l", "l"), (None, "x"), ("m", None)]), path)
    responses.put(answers(spark, [("k", "two"), ("n", "b"), ("n", "a")]), path)
    assert stored(spark, path) == {"k": "two", "l": "l", "n": "a"}


def test_look_up_reads_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "s")
    responses.put(answers(spark, [(f"k{i}", str(i)) for i in range(500)]), path)
    asked = answers(spark, [("k3", ""), ("k3", ""), ("k77", ""), ("none", "")])
    found = responses.look_up(asked, path)
    assert sorted((r["key"], r["response"]) for r in found.collect()) == [("k3", "3"), ("k77", "77")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert len(glob.glob(f"{path}/bucket=*")) > 100


def test_compaction_keeps_every_answer(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(4):
        responses.put(answers(spark, [(f"k{i}", f"{i} {n}") for i in range(n, 30)]), path)
    before = stored(spark, path)
    files = len(glob.glob(f"{path}/bucket=*/*.parquet"))
    assert responses.compact(spark, path, 2) > 0
    assert stored(spark, path) == before and len(before) == 30
    assert len(glob.glob(f"{path}/bucket=*/*.parquet")) < files and not glob.glob(f"{path}/_compacted*")
    assert responses.compact(spark, path, 2) == 0


def test_a_compaction_that_broke_off_shows_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "s")
    responses.put(answers(spark, [("k", "one")]), path)
    responses.put(answers(spark, [("k", "two")]), path)
    import shutil

    own = glob.glob(f"{path}/bucket=*/*.parquet")[0]
    shutil.copy(own, own.replace("part-", "part-copy-"))  # moved in, the old one not yet gone
    assert stored(spark, path) == {"k": "two"}
