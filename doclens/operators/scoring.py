"""Scores of findings against expected ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("imla", "dil_bilgisi", "ton", "tutarlilik")
CORE = ("imla", "dil_bilgisi", "tutarlilik")


def by_prefix(golden: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows whose id is, or begins with, one of the prefixes; all rows if there are none."""
    wanted = [p.strip() for p in prefixes if p.strip()]
    return golden.where(F.exists(F.array(*map(F.lit, wanted)), lambda p: F.col("id").startswith(p))) if wanted else golden


def greedy_match(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(id, axis, tp, fp, fn): each expected item in order takes the first free prediction that overlaps.

    expected and predicted: (id, idx, type, excerpt), few of each id. The order matters, so it is a fold within an id.
    """
    rows = expected.withColumn("side", F.lit(0)).unionByName(predicted.withColumn("side", F.lit(1)))
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("side", "idx", "type", "excerpt"))).alias("items"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norm = lambda s: " ".join(s.lower().split())
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                items = [(x["side"], x["type"], norm(x["excerpt"])) for x in r.items]
                free = [x for x in items if x[0] == 1]
                total: dict[str, list[int]] = {}
                for _, kind, text in (x for x in items if x[0] == 0):
                    hit = next((i for i, p in enumerate(free) if text in p[2] or p[2] in text), None)
                    total.setdefault(kind, [0, 0, 0])[2 if hit is None else 0] += 1
                    if hit is not None:
                        free.pop(hit)
                for _, kind, _ in free:
                    total.setdefault(kind, [0, 0, 0])[1] += 1
                out += [(r.id, k, *v) for k, v in total.items()]
            yield pd.DataFrame(out, columns=["id", "axis", "tp", "fp", "fn"])

    return lists.mapInPandas(run, "id string, axis string, tp long, fp long, fn long")


def totals(matched: DataFrame) -> DataFrame:
    """(axis, tp, fp, fn, precision, recall) of each axis, and of the core axes together as ``genel``."""
    own = matched.select("axis", "tp", "fp", "fn")
    core = own.where(F.col("axis").isin(*CORE)).withColumn("axis", F.lit("genel"))
    rows = own.unionByName(core).groupBy("axis").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    part = lambda other: F.round(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(other)), F.lit(0.0)), 6)
    return rows.withColumn("precision", part("fp")).withColumn("recall", part("fn"))


def clean_false_alarms(golden: DataFrame, matched: DataFrame) -> DataFrame:
    """(core_fp, tone_fp, clean): false alarms on examples that expect nothing."""
    clean = golden.where("size(expected) = 0").select("id")
    rows = matched.join(clean, "id", "left_semi")
    return rows.agg(F.coalesce(F.sum(F.when(F.col("axis") != "ton", F.col("fp"))), F.lit(0)).alias("core_fp"), F.coalesce(F.sum(F.when(F.col("axis") == "ton", F.col("fp"))), F.lit(0)).alias("tone_fp"))
