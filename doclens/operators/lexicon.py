"""Dictionary check: words that are in no lexicon, with their places."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.functions import text as t
from doclens.operators.affixes import Dictionary

LEAST_LETTERS = 4
#: The same class for Java's and RE2's expressions, and as a pattern of Python's.
WORD_CLASS = r"\p{L}\p{Nl}\p{No}"
_WORD = re.compile(r"[^\W\d_]+")
NO_SUGGESTION = "(öneri yok — kelimeyi bağlamda kontrol edin)"
#: Words that may be broadcast.
MOST_BROADCAST = 1_000_000


TOKENS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("word", T.StringType())]))
#: Bytes of text whose words are Python's objects at once.
SLICE_BYTES = 1 << 20


def token_array(texts: pa.Array, found: Callable[[str], Iterator[tuple[int, str]]]) -> pa.Array:
    """(start, word) of each text as an Arrow list, made from flat columns, a slice of the texts at a time."""
    n = len(texts)
    step, parts = max(1, int(n * SLICE_BYTES / max(1, texts.nbytes))), []
    for at in range(0, max(1, n), step):
        starts, words, sizes, own = [], [], [0], texts.slice(at, step)
        for x in own.to_pylist():
            for start, word in found(x or ""):
                starts.append(start)
                words.append(word)
            sizes.append(len(starts))
        values = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(words, pa.string())], ["start", "word"])
        parts.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=own.is_null()))
    return pa.concat_arrays(parts)


def _tokens(text: str) -> Iterator[tuple[int, str]]:
    return ((m.start(), m.group()) for m in _WORD.finditer(text))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point belongs to words."""
    return np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))])


def _words_of(texts: pa.Array) -> pa.Array:
    """What ``_tokens`` finds in each text, of which there is one at least, told from all their bytes at once."""
    own = pc.fill_null(texts, "").cast(pa.string())
    bounds = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
    raw = np.frombuffer(own.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    first = (raw & 0xC0) != 0x80  # of a character's bytes
    at = np.append(np.flatnonzero(first), len(raw))
    rows = np.searchsorted(at, bounds - bounds[0])  # the texts' first characters
    inside = _letters()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
    edge = np.zeros(len(at), bool)
    edge[rows] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sizes = np.searchsorted(begins, rows)
    starts = begins - np.repeat(rows[:-1], np.diff(sizes))
    offsets = np.append(0, np.cumsum(at[ends] - at[begins])).astype(np.int32)
    letters = raw[np.repeat(inside, np.diff(at))]
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(letters))
    values = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), words], ["start", "word"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=texts.is_null())


def _all_tokens(texts: pa.Array) -> pa.Array:
    """Words with their places: SQL's regular expressions do not tell places, and a fold that does copies its result at each step."""
    n = len(texts)
    step = max(1, int(n * SLICE_BYTES / max(1, texts.nbytes)))
    parts = [_words_of(texts.slice(at, step)) for at in range(0, n, step)]
    return pa.concat_arrays(parts) if parts else token_array(texts, _tokens)


#: As if not deterministic: explode() brings a filter on the size of its array, for which the optimizer would have the words found once more.
tokens = F.arrow_udf(_all_tokens, TOKENS).asNondeterministic()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a dictionary file with a word a line: a .dic file's count and its flags after a slash are left out.

    Affix rules (.aff) are not applied here; ``affixes.Dictionary`` reads both files.
    """
    rows = spark.read.text(path).select(t.strip(F.regexp_replace("value", r"(?<!\\)[/\t].*$", "")).alias("word"))
    return rows.where("word <> ''").where(~F.col("word").rlike(r"^[0-9]+$")).distinct()


def load(spark: SparkSession, path: str) -> DataFrame | Dictionary:
    """The dictionary at a path: with affix rules if a .aff file stands beside the .dic file, else a list of words."""
    base = path.removesuffix(".dic")
    rules = spark._jvm.org.apache.hadoop.fs.Path(f"{base}.aff")
    if rules.getFileSystem(spark._jsc.hadoopConfiguration()).exists(rules):
        return Dictionary.read(spark, base)
    return read(spark, path)


def shared_words(found: DataFrame, documents: int = 2) -> DataFrame:
    """(word) of the words that so many documents use: a lexicon of a corpus's own."""
    return found.select("doc_id", "word").distinct().groupBy("word").count().where(F.col("count") >= documents).select("word")


def words(placed: DataFrame) -> DataFrame:
    """(doc_id, start, word) of all words of placed blocks; a block at a time keeps the fold short."""
    rows = placed.select("doc_id", F.col("start").alias("_at"), tokens(F.col("text")).alias("_x")).select("doc_id", "_at", F.explode("_x").alias("w"))
    return rows.select("doc_id", (F.col("_at") + F.col("w.start")).alias("start"), F.col("w.word").alias("word"))


def unknown(found: DataFrame, lexicon: DataFrame | Dictionary, whitelist: list[str] = (), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words of four letters or more that the lexicon, a table (word) or a dictionary with affix rules, has in no Turkish letter case.

    A table is broadcast if its count allows; else it is joined by shuffle. Distinct words are looked up once.
    """
    skip = [w.casefold() for w in whitelist]
    rows = found.where(F.length("word") >= LEAST_LETTERS)
    if skip:
        rows = rows.where(~t.casefold("word").isin(skip))
    kinds = rows.select("word").distinct()
    if isinstance(lexicon, Dictionary):
        return rows.join(lexicon.known(kinds), "word", "left_anti").select(*keys, "start", (F.col("start") + F.length("word")).cast("int").alias("end"), "word")
    known = lexicon.select(F.col("word").alias("_known")).where("_known is not null").distinct()
    side = F.broadcast(known) if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else known
    low = t.tr_lower("word")
    forms = kinds.select("word", F.explode(F.array_distinct(F.array(F.col("word"), low, t.tr_capitalize(low)))).alias("_form"))
    good = forms.join(side, F.col("_form") == F.col("_known"), "left_semi").select("word").distinct()
    return rows.join(good, "word", "left_anti").select(*keys, "start", (F.col("start") + F.length("word")).cast("int").alias("end"), "word")


def findings(missing: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    note = "Sözlükte bulunmayan kelime; yazım hatası olabilir."
    return missing.select(*keys, F.lit("imla").alias("type"), F.col("word").alias("excerpt"), F.lit(note).alias("explanation"), F.lit(NO_SUGGESTION).alias("suggestion"), F.lit("HUNSPELL").alias("rule_id"), F.lit(None).cast("double").alias("confidence"), "start", "end")
