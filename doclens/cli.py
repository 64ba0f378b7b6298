"""Analyse text and print the result as JSON.

python -m doclens.cli SOME TEXT ...   the arguments, joined by blanks
python -m doclens.cli FILE.docx       a document's blocks; what was read is reported on standard error
python -m doclens.cli < FILE          standard input
python -m doclens.cli --folder IN OUT all text files of a folder, a JSON line for each below OUT
python -m doclens.cli --watch IN OUT CHECKPOINT   files dropped into IN since the checkpoint, .docx or text; tables below OUT
python -m doclens.cli --compare IN N              a folder's text files in one partition and in N: times, and whether the results are equal

Progress goes to standard error.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators import blocks
from doclens.plans import compare, pipeline
from doclens.plans.progress import on_standard_error
from doclens.sources import readers
from doclens.streaming import drops

FINDING = ("type", "excerpt", "explanation", "suggestion", "rule_id", "confidence", "start", "end")
_LIST = "array<struct<position:int,type:string,excerpt:string,explanation:string,suggestion:string,rule_id:string,confidence:double,start:int,end:int>>"


def folder(spark: SparkSession, path: str, out: str) -> None:
    texts = readers.texts(spark, path).withColumnRenamed("path", "doc_id")
    result = pipeline.build(spark, progress=on_standard_error).documents(texts)
    item = F.struct("position", *FINDING)
    rows = texts.select("doc_id").join(result.findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("findings")), "doc_id", "left")
    rows.select("doc_id", F.coalesce("findings", F.array().cast(_LIST)).alias("findings")).write.json(out)
    result.release()


def compared(spark: SparkSession, path: str, n: int) -> int:
    """Print how one partition and n compare; 1 if their rows differ."""
    texts = readers.texts(spark, path).withColumnRenamed("path", "doc_id")
    result = compare.compare(texts, [compare.Way("one", 1), compare.Way("many", n, n)])
    lines, same = compare.summary(result)
    print("\n".join(lines))
    result.release()
    return 0 if same else 1


def _printed(result: pipeline.Analysis, model: str, chars: int) -> dict:
    found = [{c: r[c] for c in FINDING} for r in result.findings.orderBy("position").collect()]
    noted = [{"excerpt": r["excerpt"], "note": r["note"]} for r in result.observations.orderBy("position").collect()]
    result.release()
    return {"findings": found, "observations": noted, "model_id": model, "text_len": chars}


def one(spark: SparkSession, text: str) -> dict:
    """The result for one text."""
    analyzer = pipeline.build(spark, progress=on_standard_error)
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    placed = docs.select("doc_id", F.lit(0).alias("pos"), "text", F.lit("paragraf").alias("kind"), F.lit(0).alias("start"), F.length("text").alias("end"))
    return _printed(analyzer.blocks(placed), "rules", len(text))


def docx(spark: SparkSession, path: str) -> dict:
    """The result for one .docx file; its coverage goes to standard error."""
    sections = readers.docx(spark, path)
    if broken := sections.where("error is not null").select("error").first():
        raise ValueError(f"{path}: {broken['error']}")
    placed = readers.docx_blocks(sections)
    report = blocks.report(placed, readers.docx_parts(sections)).first()
    for line in (report["summary"], report["warning"]) if report else ():
        if line:
            print(f"  … {line}", file=sys.stderr)
    chars = blocks.assemble(placed).select(F.length("text").alias("n")).first()
    return _printed(pipeline.build(spark, progress=on_standard_error).blocks(placed), "rules", chars["n"] if chars else 0)


def main(args: list[str]) -> int:
    if args[:1] == ["--folder"]:
        if len(args) != 3:
            print(__doc__, file=sys.stderr)
            return 2
        folder(SparkSession.builder.getOrCreate(), *args[1:])
        return 0
    if args[:1] == ["--watch"]:
        if len(args) != 4:
            print(__doc__, file=sys.stderr)
            return 2
        drops.watch(SparkSession.builder.getOrCreate(), *args[1:], progress=on_standard_error).awaitTermination()
        return 0
    if args[:1] == ["--compare"]:
        if len(args) != 3 or not args[2].isdigit() or int(args[2]) < 2:
            print(__doc__, file=sys.stderr)
            return 2
        return compared(SparkSession.builder.getOrCreate(), args[1], int(args[2]))
    single = args[0] if len(args) == 1 and args[0].lower().endswith(".docx") else None
    if single and not os.path.exists(single):
        print(f"{single}: no such file", file=sys.stderr)
        return 2
    text = None if single else " ".join(args) if args else sys.stdin.read()
    if text is not None and not text.strip():
        print("no text to analyse", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        found = docx(spark, f"file://{os.path.abspath(single)}") if single else one(spark, text)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(found, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
