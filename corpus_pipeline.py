"""Five stages that turn the documents table into encoded training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclens.llm import bpe, decontaminate, jaccard, langid, toxicity
from doclens.llm.common import stored

STAGES = [
    ("toxicity", toxicity.stage),
    ("language_id", langid.stage),
    ("jaccard_join", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: Learned scores and BPE have no SQL form; tests hold the stages' operators against brute-force versions, but not the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again for the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
