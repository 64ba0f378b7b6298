"""Files dropped into a folder, .docx or text: each micro-batch analyses the new ones and lists those that it refused.

A file is refused, and its content never read, if it has more bytes than the bound; a .docx file also if it can't be read or
unpacks to too much. Files without a byte are passed over, as by all file scans of Spark. Any other file is a text in UTF-8, whose broken bytes are replaced. A document's id is its file's path. A file
counts once: one that is changed under its old name isn't read again.

Below the output stand ``documents``, ``findings`` and ``refused``, with a folder for each batch that is named by its number, so a
batch that is repeated after a failure replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens import storage
from doclens.functions import text as t
from doclens.operators import blocks
from doclens.plans import pipeline
from doclens.plans.progress import BatchListener, Progress
from doclens.sources import readers

MOST_BYTES = 25 << 20
FILE = "path string, modificationTime timestamp, length long, content binary"
PARSED = f"doc_id string, kind string, length long, part int, name string, section {readers.SECTION}, images int, text string, error string"
_COLUMNS = ["doc_id", "kind", "length", "part", "name", "section", "images", "text", "error"]


def sized(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, length, content, error) of binary files: those outside the bound have an error and no content, which the scan doesn't read."""
    fits = files.where(F.col("length") <= most).select("path", "length", "content", F.lit(None).cast("string").alias("error"))
    others = files.where(F.col("length") > most)
    return fits.unionByName(others.select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(f"more than {most} bytes").alias("error")))


def parse(files: DataFrame) -> DataFrame:
    """A row for a text or a refused file, a row for each part of a .docx file."""

    def rows(path: str, length: int, content: bytes | None, error: str | None) -> list[tuple]:
        kind = "docx" if path.lower().endswith(".docx") else "text"
        if error is not None:
            return [(path, kind, length, 0, None, None, 0, None, error)]
        if kind == "text":
            return [(path, kind, length, 0, None, None, 0, content.decode("utf-8-sig", errors="replace"), None)]
        return [(path, kind, length, part, name, section, images, None, wrong) for _, part, name, section, images, wrong in readers.docx_rows(path, content)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):  # one file at a time, as each may be of the greatest size
                yield pd.DataFrame(rows(r.path, r.length, r.content, r.error), columns=_COLUMNS)

    return files.mapInPandas(run, PARSED)


def read(spark: SparkSession, folder: str, most: int = MOST_BYTES) -> DataFrame:
    """The parsed files that stand in a folder now."""
    return parse(sized(spark.read.format("binaryFile").load(folder), most))


def placed_blocks(parsed: DataFrame) -> DataFrame:
    """Blocks of the accepted files: a text is one block, as it is when given to the analysis by itself."""
    good = parsed.where("error is null")
    texts = good.where((F.col("kind") == "text") & (F.trim("text") != ""))
    whole = texts.select("doc_id", F.lit(0).alias("pos"), "text", F.lit("paragraf").alias("kind"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return whole.unionByName(readers.docx_blocks(good.where("kind = 'docx'").select("doc_id", "part", "name", "section", "images", "error")))


def documents(parsed: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, kind, title, length, summary, warning) of the accepted files; a .docx file's title is its name, its summary what was read of it."""
    good = parsed.where("error is null")
    sections = good.where("kind = 'docx'")
    named = sections.where("part = 0").select("doc_id", "kind", F.substring_index("doc_id", "/", -1).alias("title"), "length")
    of_docx = named.join(blocks.report(placed, readers.docx_parts(sections)).select("doc_id", "summary", "warning"), "doc_id", "left")
    nothing = F.lit(None).cast("string")
    texts = good.where("kind = 'text'").select("doc_id", "kind", t.make_title("text").alias("title"), "length", nothing.alias("summary"), nothing.alias("warning"))
    return texts.unionByName(of_docx)


def refused(parsed: DataFrame) -> DataFrame:
    """(path, length, error) of the files that are not analysed."""
    return parsed.where("error is not null").select(F.col("doc_id").alias("path"), "length", "error")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, most: int = MOST_BYTES, files: int = 1000, analyzer=pipeline.build, progress: Progress | None = None) -> StreamingQuery:
    """Analyse the files of a folder that are new to the checkpoint, at most ``files`` in a batch, and stop.

    analyzer makes the Analyzer of a batch from a session and a receiver of progress.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files).load(folder)

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession  # the query's own session, so the caller's settings stay
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
        parsed, held = storage.stored(parse(batch), "drops")
        own.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        try:
            placed = placed_blocks(parsed)
            result = analyzer(own, progress=progress).blocks(placed)
            try:
                result.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
            finally:
                result.release()
            refused(parsed).write.mode("overwrite").parquet(f"{out}/refused/batch={number}")
            documents(parsed, placed).write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        finally:
            storage.remove(own, held)

    if progress:
        spark.streams.addListener(BatchListener(progress, f"{checkpoint}#drops"))
    writer = sized(stream, most).writeStream.queryName(f"{checkpoint}#drops").foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
