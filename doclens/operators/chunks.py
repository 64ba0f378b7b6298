"""Paragraphs, sentences and chunks of a text, each an exact slice of it.

Texts are cut in the JVM; offsets and packing are sums over the pieces' lengths, made in one pass by Arrow functions, as a SQL
fold copies its array at each step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.functions.text import _FAR, _ODD, DIGIT, WORD, WS
from doclens.operators.spans import beside, overlaps

MAX_CHARS = 3000
# Abbreviations that end no sentence.
ABBREVIATIONS = "prof doç doc dr yrd av sn no nu vb vs bkz örn age çev haz ed md müh ltd şti cad sok mah apt blv bld tel faks tic san"
CAPITAL = "[A-ZÇĞİÖŞÜ]"
#: Stands between pieces while a text is cut; where a text has it itself, another character of the private area stands in for it.
MARK, OTHER_MARK = "\ue000", "\ue001"
_GUARD = rf"(?!(?:(?iu:{'|'.join(ABBREVIATIONS.split())})|{DIGIT}+|[{WORD}])[.!?])"
BOUNDARY = rf"(?<![{WORD}]){_GUARD}([{WORD}]+[.!?]+[{WS}]+)(?={CAPITAL})"
#: White space before the first paragraph, and blank lines with the white space after them.
GAP = rf"\A[ {_ODD}]+|\n[ {_ODD}]*\n[ {_ODD}]*"
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _rows(f: Callable[..., list[tuple[int, int]]]) -> Callable[..., Column]:
    """A function of arrays that gives spans, as a column function."""

    @F.pandas_udf(SPAN)
    def own(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else [{"start": a, "end": b} for a, b in f(*row)] for row in zip(*columns, strict=True)], dtype=object)

    return own


def _kept(lengths, keep) -> list[tuple[int, int]]:
    out, at = [], 0
    for n, k in zip(lengths, keep, strict=True):
        if k and n > 0:
            out.append((at, at + int(n)))
        at += int(n)
    return out


def _running(lengths: pa.Array, start: pa.Array) -> pa.Array:
    """Running sums within each list, over all lists' lengths at once."""
    none = pc.or_(lengths.is_null(), start.is_null())
    own = lengths.filter(pc.invert(none))
    sizes, first = (np.asarray(x, np.int64) for x in (own.value_lengths(), start.filter(pc.invert(none))))
    each = np.asarray(own.flatten(), np.int64)
    ends, bounds = np.concatenate([[0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(sizes)])
    ends = ends[1:] + np.repeat(first - ends[bounds[:-1]], sizes)
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (ends - each, ends)], ["start", "end"])
    at = np.zeros(len(lengths) + 1, np.int64)
    at[1:][~np.asarray(none)] = sizes
    return pa.ListArray.from_arrays(pa.array(np.cumsum(at), pa.int32()), spans, mask=none)


def _packed(spans, budget) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in spans:
        if out and x["end"] - out[-1][0] <= budget:
            out[-1] = (out[-1][0], x["end"])
        else:
            out.append((x["start"], x["end"]))
    return out


def _chunked(lengths, keep, budget) -> list[tuple[int, int]]:
    return _packed([{"start": a, "end": b} for a, b in _kept(lengths, keep)], budget)


_running_udf, _kept_udf = F.arrow_udf(_running, SPAN), _rows(_kept)
# as if not deterministic: the optimizer would else move them into filters below, where they cannot run
_packed_udf, _chunked_udf = (_rows(f).asNondeterministic() for f in (_packed, _chunked))
_laid_udf = F.arrow_udf(_running, SPAN).asNondeterministic()


def laid(lengths: Column) -> Column:
    """Spans of pieces of these lengths, side by side from 0."""
    return _laid_udf(lengths, F.lit(0))


def spans_of(parts: Column, start: Column) -> Column:
    """Spans of pieces that lie side by side, the first at ``start``."""
    return _running_udf(F.transform(parts, F.length), start.cast("int"))


def _pieces(text: Column) -> Column:
    """A text's paragraphs and the gaps between them in turn, a paragraph (that may be empty) first."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER_MARK), f"({GAP})", f"{MARK}$1{MARK}"), MARK, -1)


def paragraph_spans(text: Column) -> Column:
    """What lies between blank lines."""
    return _kept_udf(F.transform(_pieces(text), F.length), F.transform(_pieces(text), lambda p, i: i % 2 == 0))


def sentences(text: Column) -> Column:
    """A paragraph's sentences with the white space after them; together they are the paragraph."""
    return F.split(F.regexp_replace(text, BOUNDARY, "$1" + MARK), MARK)


def _atoms(text: Column, max_chars: int) -> Column:
    """(n, k): lengths of paragraphs, or of the sentences of those that are longer than the budget, and of gaps, and which are none."""
    cut = lambda p, i: F.when((i % 2 == 0) & (F.length(p) > max_chars), sentences(p)).otherwise(F.array(p))
    one = lambda n, k: F.struct(n.alias("n"), k.alias("k"))
    return F.flatten(F.transform(_pieces(text), lambda p, i: F.transform(cut(p, i), lambda x: one(F.length(x), i % 2 == 0))))


def pack(spans: Column, max_chars: int = MAX_CHARS) -> Column:
    """Greedy: a chunk takes the next span while it stays within the budget."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    return _packed_udf(spans, F.lit(max_chars))


def chunks(texts: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, chunk_id, start, end, text) from (doc_id, text)."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    cut = texts.select("doc_id", "text", _atoms(F.col("text"), max_chars).alias("_a"))
    packed = cut.withColumn("_packed", _chunked_udf(F.col("_a.n"), F.col("_a.k"), F.lit(max_chars)))
    rows = packed.select("doc_id", "text", F.posexplode("_packed").alias("chunk_id", "c"))
    return rows.select("doc_id", "chunk_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.substring("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("text"))


def _prose(chunk_rows: DataFrame, placed: DataFrame, wanted: bool) -> DataFrame:
    rows = beside(chunk_rows, placed, _prose=F.col("kind").isin("paragraf", "baslik"))
    return rows.where(overlaps("_prose") == wanted).drop("_prose")


def covered(chunk_rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Chunks whose text lies in table cells and contents lines alone; blocks tile the text."""
    return _prose(chunk_rows, placed, False)


def with_prose(chunk_rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The other chunks, which are judged."""
    return _prose(chunk_rows, placed, True)
