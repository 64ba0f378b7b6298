"""Sources: lines, whole files, JSON lines and .docx documents."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "id string, text string, expected array<struct<type:string,excerpt:string>>, mode string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARTS = (("body", r"word/document\.xml"), ("header", r"word/header\d*\.xml"), ("footer", r"word/footer\d*\.xml"), ("footnotes", r"word/footnotes\.xml"), ("endnotes", r"word/endnotes\.xml"))
#: Bytes that a .docx file's XML may have once unpacked; a small archive can hold far more.
MOST_UNPACKED = 256 << 20
SECTION = "array<array<array<array<struct<text:string,in_table:boolean,style:string>>>>>"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a JSON-lines file; blank lines are skipped."""
    return spark.read.schema(GOLDEN).json(path).where("id is not null")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(key, response) of stored responses; none where the folder is missing or a line is broken."""
    try:
        return spark.read.schema("key string, response string").option("mode", "DROPMALFORMED").json(path).where("key is not null")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, response string")


def _paragraph(p: ElementTree.Element, in_table: bool) -> dict:
    out: list[str] = []
    for x in p.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
        elif x.tag == _W + "drawing":
            out.append("----media/image----")
    style = p.find(f"{_W}pPr/{_W}pStyle")
    return {"text": "".join(out), "in_table": in_table, "style": None if style is None else style.get(_W + "val")}


def docx_sections(data: bytes) -> dict[str, list]:
    """Section name to table, row, cell, paragraph; a plain paragraph is a table of its own."""
    out: dict[str, list] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name, pattern in _PARTS:
            tables: list = []
            for part in sorted(n for n in z.namelist() if re.fullmatch(pattern, n)):
                root = ElementTree.fromstring(z.read(part))
                for top in root.findall(_W + "body") or ([root] if name in ("header", "footer") else list(root)):
                    for x in top:
                        if x.tag == _W + "p":
                            tables.append([[[_paragraph(x, False)]]])
                        elif x.tag == _W + "tbl":
                            tables.append([[[_paragraph(p, True) for p in c.iter(_W + "p")] for c in r.findall(_W + "tc")] for r in x.findall(_W + "tr")])
            out[name] = tables
    return out


def docx_rows(path: str, data: bytes) -> list[tuple]:
    """(path, part, name, section, images, error) of a file's parts; one row with the error if it is no .docx or unpacks to more than MOST_UNPACKED."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(x.file_size for x in z.infolist() if x.filename.endswith(".xml")) > MOST_UNPACKED:
                return [(path, 0, "body", [], 0, f"unpacks to more than {MOST_UNPACKED} bytes")]
            images = sum(n.startswith("word/media/") for n in z.namelist())
            if "word/document.xml" not in z.namelist():
                return [(path, 0, "body", [], 0, "no word/document.xml inside")]
        found = docx_sections(data)
        return [(path, i, name, found[name], images, None) for i, (name, _) in enumerate(_PARTS)]
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, KeyError, ElementTree.ParseError) as e:
        return [(path, 0, "body", [], 0, str(e) or type(e).__name__)]


def docx(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, section, images) of .docx files: body, header, footer, footnotes and endnotes in that order.

    A file that is no .docx has error set and no sections.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [x for r in frame.itertuples(index=False) for x in docx_rows(r.path, r.content)]
            yield pd.DataFrame(out, columns=["doc_id", "part", "name", "section", "images", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"doc_id string, part int, name string, section {SECTION}, images int, error string")


def docx_blocks(sections: DataFrame) -> DataFrame:
    """Placed blocks of .docx files: the body, then what the other parts have once each, without consecutive repeats."""
    from pyspark.sql import Window as W

    from doclens.operators import blocks

    rows = [blocks.flatten(sections.where(F.col("part") == i).select("doc_id", "section")).withColumn("part", F.lit(i)) for i in range(len(_PARTS))]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    order = W.partitionBy("doc_id").orderBy("part", "table_no", "row_no", "cell_no", "par_no")
    every = every.withColumn("pos", F.row_number().over(order)).select("doc_id", "part", "pos", "text", "kind")
    body = every.where("part = 0")
    extras = blocks.dedup_extras(every.where("part > 0"))
    return blocks.place(blocks.dedup_consecutive(body.unionByName(extras).drop("part")))


def docx_parts(sections: DataFrame) -> DataFrame:
    """(doc_id, header_footer, notes): whether headers or footers, and foot- or endnotes, have anything."""
    some = F.exists("section", lambda table: F.exists(table, lambda row: F.exists(row, lambda cell: F.exists(cell, lambda p: F.trim(p["text"]) != ""))))
    part = lambda *names: F.coalesce(F.max(F.when(F.col("name").isin(*names), some)), F.lit(False))
    return sections.groupBy("doc_id").agg(part("header", "footer").alias("header_footer"), part("footnotes", "endnotes").alias("notes"))
