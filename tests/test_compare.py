"""The same analysis in several ways: equal rows under one store, times, and differences that are found."""

import json

import pytest

from doclens import cli
from doclens.plans import compare
from doclens.plans.compare import Way
from doclens.settings import Settings

COLUMNS = "channel string, doc_id string, row string"


def docs_of(spark, n):
    lines = ("Bu yanlız bir deneme deneme.", "Herkez geldi.", "E-Posta ile Eposta aynı.", "Düz bir cümle.")
    return spark.createDataFrame([(i, lines[i % 4] + f" {i}. satır") for i in range(n)], "doc_id long, text string")


def test_partitions_change_nothing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    result = compare.compare(docs_of(spark, 12), [Way("one", 1), Way("many", 5)], Settings())
    lines, same = compare.summary(result)
    assert same and result.differences.count() == 0 and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert len(lines) == 3 and "5 partitions" in lines[1] and lines[2] == "many against one: the same rows"
    for t in result.timings:
        seconds = [s for _, s in t.events]
        assert [x for x, _ in t.events][0] == "chunk" and [x for x, _ in t.events][-1] == "done"
        assert seconds == sorted(seconds) and 0 < seconds[-1] <= t.seconds
    result.release()


def test_a_wavering_model_is_equal_under_one_store(spark, tmp_path):
    """Each call has another answer, so runs differ by themselves; with one store they may not."""

    def wavers(system, user, path=str(tmp_path / "calls")):
        with open(path, "a") as f:
            f.write("x")
        n = len(open(path).read())
        return json.dumps({"findings": [], "spelling": [], "observations": [{"excerpt": "satır", "note": f"call {n}"}]})

    result = compare.compare(docs_of(spark, 3), [Way("one", 1), Way("many", 3, 3)], Settings(model="m"), wavers)
    assert result.differences.count() == 0 and len(result.timings) == 2
    result.release()


def test_differences_are_counted(spark):
    a = spark.createDataFrame([("finding", "1", "x")] * 2 + [("finding", "1", "y"), ("observation", "2", "z")], COLUMNS)
    b = spark.createDataFrame([("finding", "1", "x"), ("finding", "1", "y"), ("finding", "2", "z"), ("observation", None, "z")], COLUMNS)
    got = {(r["channel"], r["doc_id"], r["row"]): (r["first"], r["other"]) for r in compare.differences(a, b, "b").collect()}
    assert got == {("finding", "1", "x"): (2, 1), ("observation", "2", "z"): (1, 0), ("finding", "2", "z"): (0, 1), ("observation", None, "z"): (0, 1)}
    assert compare.differences(a, a, "a").count() == 0
    with pytest.raises(ValueError):
        compare.compare(a, [Way("one", 1)])


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("Herkez geldi.", encoding="utf-8")
    assert cli.main(["--compare", str(tmp_path), "3"]) == 0 and "the same rows" in capsys.readouterr().out
    assert cli.main(["--compare", str(tmp_path), "1"]) == 2 and cli.main(["--watch", "x"]) == 2
