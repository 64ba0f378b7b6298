"""Documents that arrive as files: each micro-batch runs the whole analysis and appends its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens.functions.text import sse
from doclens.plans import pipeline
from doclens.plans.progress import BatchListener, Progress

DOCUMENT = "doc_id long, text string"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, progress: Progress | None = None) -> StreamingQuery:
    """Analyse Parquet files of documents as they appear; a batch's number names its output, so a repeated batch replaces itself.

    A document is complete in its row, so no state and no watermark are needed. progress gets the events of each batch's analysis, and one
    from the query's own report when the batch has ended.
    """
    stream = spark.readStream.schema(DOCUMENT).parquet(folder)

    def step(batch: DataFrame, number: int) -> None:
        result = pipeline.build(spark, progress=progress).documents(batch)
        try:
            result.findings.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            result.release()

    if progress:
        listener = BatchListener(progress, f"{checkpoint}#watch")
        spark.streams.addListener(listener)
    writer = stream.writeStream.queryName(f"{checkpoint}#watch").foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def events(rows: DataFrame) -> DataFrame:
    """Server-sent frames of progress rows (stage, message, current, total)."""
    return rows.select(sse(F.lit("progress"), F.to_json(F.struct("stage", "message", "current", "total"))).alias("frame"))
