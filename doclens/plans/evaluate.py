"""Evaluation on a golden set: the analyzer over its examples, scores by axis, and an archive of the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators import scoring
from doclens.plans.pipeline import Analyzer

#: Characters of an error that a report shows.
ERROR_CHARS = 140
PREDICTION = "array<struct<type:string,excerpt:string,suggestion:string>>"
OBSERVATION = "array<struct<excerpt:string,note:string>>"


@dataclass
class Run:
    """(id, text, expected, predicted, observations) of the examples that went through, and what they score."""

    predictions: DataFrame
    scores: DataFrame
    false_alarms: DataFrame
    failed: DataFrame
    total: int
    filtered: bool

    def archive(self, spark: SparkSession, folder: str, model: str, at: str) -> dict:
        """Write the predictions, and one row about the run, below ``folder``; returns that row.

        The run is partial if examples were left out by a filter or failed.
        """
        self.predictions.write.mode("overwrite").json(f"{folder}/last_predictions")
        path = f"{folder}/runs/{model}-{at}"
        self.predictions.write.json(f"{path}/predictions")
        failed = [{"id": r["id"], "error": r["error"]} for r in self.failed.limit(1000).collect()]
        n = self.predictions.count()
        row = {"model_id": model, "timestamp": at, "partial": self.filtered or bool(failed), "processed": n, "total": self.total, "failed": failed}
        form = "model_id string, timestamp string, partial boolean, processed long, total long, failed array<struct<id:string,error:string>>"
        spark.createDataFrame([row], form).coalesce(1).write.json(f"{path}/run")
        self.failed.write.json(f"{path}/failed")
        return row


def run(golden: DataFrame, analyzer: Analyzer, prefixes: list[str] = ()) -> Run:
    """Analyse the examples (id, text, expected, mode): those of mode "document" in chunks, the others whole.

    A text that failed is in no score. Clean examples, which expect nothing, give the false alarms.
    """
    chosen = scoring.by_prefix(golden, list(prefixes))
    texts = chosen.select(F.col("id").alias("doc_id"), "text", "mode")
    parts = [analyzer.texts(texts.where("mode is null or mode <> 'document'")), analyzer.documents(texts.where("mode = 'document'").select("doc_id", "text"))]
    found, seen = (parts[0].findings.unionByName(parts[1].findings), parts[0].observations.unionByName(parts[1].observations))
    failed = chosen.limit(0).select("id", F.lit("").alias("error"))
    for p in parts:
        if p.statuses is not None:
            failed = failed.unionByName(p.statuses.where("status <> 'ok'").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.substring(F.min(F.coalesce("error", "status")), 1, ERROR_CHARS).alias("error")))
    failed = failed.groupBy("id").agg(F.min("error").alias("error"))
    went = chosen.join(failed.select("id"), "id", "left_anti")
    predicted = found.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "type", "excerpt", "suggestion"))).alias("p"))
    noted = seen.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("excerpt", "note"))).alias("observations"))
    rows = went.join(predicted, "id", "left").join(noted, "id", "left")
    plain = F.transform("p", lambda x: F.struct(x["type"].alias("type"), x["excerpt"].alias("excerpt"), x["suggestion"].alias("suggestion")))
    rows = rows.select("id", "text", "expected", F.coalesce(plain, F.array().cast(PREDICTION)).alias("predicted"), F.coalesce("observations", F.array().cast(OBSERVATION)).alias("observations"))
    side = lambda c: rows.select("id", F.posexplode(c).alias("idx", "x")).select("id", "idx", "x.type", "x.excerpt")
    matched = scoring.greedy_match(side("expected"), side("predicted"))
    return Run(rows, scoring.totals(matched), scoring.clean_false_alarms(rows.select("id", "expected"), matched), failed, chosen.count(), bool([p for p in prefixes if p.strip()]))
