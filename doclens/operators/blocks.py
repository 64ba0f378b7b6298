"""Blocks of a document: cleaned, classified, without repeats, with running offsets.

blocks: (doc_id, pos, text, kind); placed blocks also have start and end in the assembled text, whose
blocks are joined by a blank line.

A document is a row: ``document_blocks`` and ``texts`` work within it, so they shuffle nothing, and rows that repeat an id each
have their own blocks, offsets and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.functions import text as t
from doclens.operators.chunks import laid

SEPARATOR = "\n\n"


def from_lines(docs: DataFrame) -> DataFrame:
    """Every line of a text that is not empty once cleaned is a block."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return lines.select("doc_id", "pos", F.inline(_cleaned("raw")))


def _cleaned(raw: Column | str, in_table: Column | None = None, style: Column | None = None) -> Column:
    """One (text, kind), or none if nothing is left. A filter on the text would be pushed below and clean a second time."""
    some = F.filter(F.array(t.clean_paragraph(raw)), lambda x: x != "")
    return F.transform(some, lambda x: F.struct(x.alias("text"), t.classify(x, in_table, style).alias("kind")))


def flatten(sections: DataFrame) -> DataFrame:
    """Blocks of nested lists (doc_id, section: array of table, row, cell, paragraph), with their path.

    A paragraph is a struct of text, in_table and style; the latter two may be null.
    """
    out = sections
    for level, source in (("table", "section"), ("row", "table_"), ("cell", "row_"), ("par", "cell_")):
        out = out.select(*[c for c in out.columns if c != source], F.posexplode(source).alias(f"{level}_no", f"{level}_"))
    made = _cleaned(F.col("par_.text"), F.col("par_.in_table"), F.col("par_.style"))
    return out.select("doc_id", "table_no", "row_no", "cell_no", "par_no", F.inline(made))


def count_tables(sections: DataFrame) -> DataFrame:
    """(doc_id, tables): lists of more than one row or column."""
    real = F.filter("section", lambda table: (F.size(table) > 1) | (F.coalesce(F.array_max(F.transform(table, lambda row: F.size(row))), F.lit(0)) > 1))
    return sections.select("doc_id", F.size(real).cast("long").alias("tables"))


def dedup_consecutive(blocks: DataFrame) -> DataFrame:
    before = F.lag("_key").over(W.partitionBy("doc_id").orderBy("pos"))
    return blocks.withColumn("_key", t.squash("text")).withColumn("_before", before).where("not _key <=> _before").drop("_key", "_before")


def dedup_extras(extras: DataFrame) -> DataFrame:
    """First of equal (text, kind) in the order of (part, pos)."""
    first = F.row_number().over(W.partitionBy("doc_id", "text", "kind").orderBy("part", "pos"))
    return extras.withColumn("_n", first).where("_n = 1").drop("_n")


def place(blocks: DataFrame) -> DataFrame:
    """Add start and end: a running sum of lengths and separators."""
    before = F.sum(F.length("text") + len(SEPARATOR)).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).withColumn("end", (F.col("start") + F.length("text")).cast("int"))


def assemble(placed: DataFrame) -> DataFrame:
    """(doc_id, text): the blocks joined by a blank line."""
    rows = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return rows.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), SEPARATOR).alias("text"))


def _of_row(text: Column | str) -> Column:
    """A text's blocks in order, as an array of (pos, text, kind)."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), t.clean_paragraph(x).alias("text")))
    some = F.transform(F.filter(lines, lambda x: x["text"] != ""), lambda x: F.struct(x["pos"], x["text"], t.squash(x["text"]).alias("key")))
    kept = t.let(some, lambda b: F.filter(b, lambda x, i: (i == 0) | (x["key"] != F.get(b, i - 1)["key"])))
    return F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), t.classify(x["text"]).alias("kind")))


def document_blocks(docs: DataFrame) -> DataFrame:
    """Placed blocks of each row (doc_id, text); null and empty texts have none."""
    rows = docs.select("doc_id", _of_row("text").alias("_b"))
    rows = rows.withColumn("_s", laid(F.transform("_b", lambda x: F.length(x["text"]) + len(SEPARATOR))))
    one = lambda x: F.struct(x["_b"]["pos"].alias("pos"), x["_b"]["text"].alias("text"), x["_b"]["kind"].alias("kind"), x["_s"]["start"].alias("start"), (x["_s"]["end"] - len(SEPARATOR)).alias("end"))
    return rows.select("doc_id", F.inline(F.transform(F.arrays_zip("_b", "_s"), one)))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of each row that has a block: its blocks joined by a blank line."""
    joined = F.array_join(F.transform(_of_row("text"), lambda x: x["text"]), SEPARATOR)
    return docs.select("doc_id", F.inline(F.transform(F.filter(F.array(joined), lambda x: x != ""), lambda x: F.struct(x.alias("text")))))


def report(placed: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Blocks, tables and images of each document, with the summary line and its warning.

    parts: (doc_id, header_footer, notes), whether a document has these; none has if it is not given.
    """
    rows = placed.groupBy("doc_id").agg(
        F.count("*").alias("paragraphs"),
        F.sum((F.col("kind") == "tablo_hucresi").cast("long")).alias("tables"),
        F.sum(F.floor((F.length("text") - F.length(F.replace("text", F.lit(t.IMAGE), F.lit("")))) / len(t.IMAGE)).cast("long")).alias("images"),
    )
    if parts is not None:
        rows = rows.join(parts.select("doc_id", "header_footer", "notes"), "doc_id", "left")
    has = lambda c: F.lit(False) if parts is None else F.coalesce(F.col(c), F.lit(False))
    made = rows.withColumn("summary", summary(F.col("paragraphs"), F.col("tables"), F.col("images"), has("header_footer"), has("notes"))).withColumn("warning", warning(F.col("images")))
    return made.drop("header_footer", "notes")


def summary(paragraphs, tables, images, header_footer, notes):
    parts = [F.format_string("%d metin bloğu, %d tablo, %d görsel", paragraphs, tables, images), F.when(header_footer, "üst/altbilgi dahil"), F.when(notes, "dipnot dahil")]
    return F.concat(F.lit("Belge okundu: "), F.concat_ws(", ", *parts), F.lit("."))


def warning(images):
    return F.when(images > 0, F.concat(images.cast("string"), F.lit(" görsel bulundu; görsel içindeki olası yazı okunamadı (OCR gerekir).")))
