"""Scalar text functions as columns. Character classes are spelled out, as the engines' shorthands differ.

Offsets are code points, zero-based and half-open.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.isspace() has it; written for Java's and RE2's bracket expressions alike.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters, for trimming.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The same for Java alone: single characters below 256 are one table look-up, and the rest is tried within its range only.
_FAR = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
_ODD = rf"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0{_FAR}"
#: Runs of white space that are not a single blank already.
RUNS = rf" [ {_ODD}]+|[{_ODD}][ {_ODD}]*"
LETTER = r"\p{L}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
#: Digits by str.isdigit(): decimal ones and the raised and lowered.
ANY_DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"

# Place holders and the marks around a judged text.
TEXT_OPEN, TEXT_CLOSE = "<<<ANALIZ_EDILECEK_METIN>>>", "<<<METIN_SONU>>>"
IMAGE = "[görsel]"
LINK = "[bağlantı]"
QUOTES = ("’‘‚ʼ“”„", "''''\"\"\"")
#: Texts that norm() leaves as they are: no white space, none of the quotes, all below U+0300 and so in NFC.
_PLAIN = r"^[!-~\x{a1}-\x{2bb}]*+\z"

# What is cleaned away, what tells a block's kind and what keys leave out.
IMAGE_LINE = rf"^-{{2,}}media/[^{WS}]+-{{2,}}\z"
ANCHOR = r"(?is)<a\b[^>]*>(.*?)</a>"
URL = rf"(?i)https?://[^{WS}]+|www\.[^{WS}]+"
IMAGE_INLINE = rf"(?:-{{2,}}media/[{WORD}.]+(?:-[{WORD}.]+)*)+-{{2,}}"
TOC = rf"\t{DIGIT}{{1,3}}[{WS}]*\z"
RESIDUE = rf"[{DIGIT}{WS}.,:;%/()\-+±°=*]+"
TRAILING = r"""[.,!?;:'"”’]+\z"""
KEY_NOISE = rf"""[{WS}'"‘’“”«»„`.,;:()/\-_]"""
#: Runs of the same for Java alone, as with ``RUNS``; they hold all white space.
_KEY_FAR = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2018}\x{2019}\x{201c}-\x{201e}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
_KEY_RUNS = rf"""[ \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0'"\xab\xbb`.,:;()/\-_{_KEY_FAR}]+"""
NOT_TURKISH = ["q", "w", "x", "Q", "W", "X", "`"]


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(_column(c), F.lit(SPACES))


def squash(c: Column | str) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(_column(c), RUNS, " "))


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Texts in ASCII, which are in NFC, stay as they are in Arrow's memory; only the others become Python's strings."""
    other = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    if not pc.any(other).as_py():
        return texts
    return pc.replace_with_mask(texts, other, pa.array([unicodedata.normalize("NFC", x) for x in texts.filter(other).to_pylist()], texts.type))


def norm(c: Column | str) -> Column:
    """NFC, one form of quotes, single spaces."""
    return squash(F.translate(nfc(_column(c)), *QUOTES))


def norm_composed(c: Column | str) -> Column:
    """norm() of text that is in NFC already; stays in the JVM."""
    return squash(F.translate(_column(c), *QUOTES))


def norm_here(c: Column | str) -> Column:
    """norm() with NFC by Spark's own ICU: an Arrow function hides from Spark how its rows are dealt, and they would be shuffled anew.

    ICU knows Unicode 16, so it may move marks that Python's tables do not have yet.
    """
    c = _column(c)
    composed = F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False)))
    return F.when(c.rlike(_PLAIN), c).otherwise(norm_composed(composed))


def casefold(c: Column | str) -> Column:
    return F.replace(F.lower(_column(c)), F.lit("ß"), F.lit("ss"))


def _swapped(c: Column, pairs: str) -> Column:
    """Each even character replaced by the next; replace() looks for bytes, translate() makes a string of every character."""
    for old, new in zip(pairs[::2], pairs[1::2], strict=True):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def tr_lower(c: Column | str) -> Column:
    return F.lower(_swapped(_column(c), "Iıİi"))


def tr_upper(c: Column | str) -> Column:
    return F.upper(_swapped(_column(c), "ıIiİ"))


def tr_capitalize(c: Column | str) -> Column:
    c = _column(c)
    return F.concat(tr_upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def match_case(reference: Column | str, c: Column | str) -> Column:
    """c in the letter case of reference."""
    reference, c = _column(reference), _column(c)
    first, own = F.substring(reference, 1, 1), F.substring(c, 1, 1)
    all_upper = (reference == F.upper(reference)) & (reference != F.lower(reference)) & (F.length(reference) > 1)
    return (
        F.when((F.length(reference) == 0) | (F.length(c) == 0), c)
        .when(all_upper, tr_upper(c))
        .when(first.rlike(r"\p{Lu}") & own.rlike(r"\p{Ll}"), tr_capitalize(c))
        .otherwise(c)
    )


def surface_key(c: Column | str) -> Column:
    return F.regexp_replace(casefold(c), _KEY_RUNS, "")


def concept_key(c: Column | str) -> Column:
    return F.regexp_replace(casefold(strip(c)), rf"[{WS}]+", " ")


def is_indexable(c: Column | str) -> Column:
    s = strip(c)
    return F.length(s).between(2, 60) & s.rlike(rf"""^[{LETTER}'"‘’“”«»„`]""")


def clean_paragraph(c: Column | str) -> Column:
    """A paragraph's text without image marks and links; empty if it was an image alone.

    A rewrite is tried only where a substring stands that its pattern cannot do without.
    """

    def rewrite(x: Column, needs: Callable[[Column], Column], pattern: str, to: str) -> Column:
        return let(x, lambda v: F.when(needs(v), F.regexp_replace(v, pattern, to)).otherwise(v))

    def body(text: Column) -> Column:
        out = rewrite(text, lambda v: v.contains("<"), ANCHOR, "$1")
        out = rewrite(out, lambda v: v.contains("://") | F.lower(v).contains("www."), URL, LINK)
        out = rewrite(out, lambda v: v.contains("media/"), IMAGE_INLINE, f" {IMAGE} ")
        return strip(rewrite(out, lambda v: v.contains("  ") | v.contains("\t"), r"[ \t]{2,}", " "))

    return let(strip(c), lambda v: F.when(v.startswith("--") & v.rlike(IMAGE_LINE), F.lit("")).otherwise(body(v)))


def classify(c: Column | str, in_table: Column | None = None, style: Column | None = None) -> Column:
    """Kind of a block: icindekiler, tablo_hucresi, baslik or paragraf."""
    c = _column(c)
    in_table = F.lit(False) if in_table is None else F.coalesce(in_table, F.lit(False))
    style = F.lit("") if style is None else F.coalesce(style, F.lit(""))
    return (
        F.when(c.contains("\t") & c.rlike(TOC), "icindekiler")
        .when(in_table, "tablo_hucresi")
        .when((F.length(c) <= 40) & c.rlike(f"[{ANY_DIGIT}]") & (F.length(F.regexp_replace(c, RESIDUE, "")) <= 3), "tablo_hucresi")
        .when(F.lower(style).startswith("heading"), "baslik")
        .when((F.length(c) <= 100) & (c == F.upper(c)) & c.rlike(LETTER), "baslik")
        .otherwise("paragraf")
    )


def is_noop(excerpt: Column | str, suggestion: Column | str) -> Column:
    return norm(excerpt) == norm(suggestion)


def is_corrupt(excerpt: Column | str, suggestion: Column | str) -> Column:
    """The suggestion brings in a letter or mark that Turkish does not use."""
    letters = lambda c: F.split(_column(c), "")
    return F.arrays_overlap(F.array_except(letters(suggestion), letters(excerpt)), F.array(*map(F.lit, NOT_TURKISH)))


def atomic(excerpt_norm: Column, suggestion_norm: Column) -> Column:
    """struct(before, after) if exactly one word differs between two normalised texts, else null."""
    bare = lambda w: F.regexp_replace(w, TRAILING, "")
    split = lambda c: F.transform(F.split(c, " "), bare)
    both = lambda x, y: F.struct(x.alias("before"), y.alias("after"))
    a, b = split(excerpt_norm), split(suggestion_norm)
    pairs = F.filter(F.zip_with(a, b, both), lambda p: p["before"] != p["after"])
    one, other = bare(excerpt_norm), bare(suggestion_norm)  # two single words need no arrays
    words = F.when((F.size(a) == F.size(b)) & (F.size(pairs) == 1), F.get(pairs, F.lit(0)))
    return F.when(excerpt_norm.contains(" ") | suggestion_norm.contains(" "), words).otherwise(F.when(one != other, both(one, other)))


def cache_key(model: Column, system: Column, user: Column) -> Column:
    zero = F.expr("char(0)")
    return F.sha2(F.concat(model, zero, system, zero, user), 256)


def make_title(c: Column | str, limit: int = 60) -> Column:
    """First line that is not blank, cut to the limit with an ellipsis."""
    lines = F.filter(F.transform(F.split(_column(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    return F.when(first.isNull(), "(boş)").when(F.length(first) <= limit, first).otherwise(F.concat(F.regexp_replace(F.substring(first, 1, limit - 1), rf"[{WS}]+\z", ""), F.lit("…")))


def eval_norm(c: Column | str) -> Column:
    return squash(F.lower(_column(c)))


def overlap_text(a: Column, b: Column) -> Column:
    """Whether one normalised text contains the other."""
    a, b = eval_norm(a), eval_norm(b)
    return a.contains(b) | b.contains(a)


def delimited(c: Column | str) -> Column:
    return F.concat(F.lit(f"{TEXT_OPEN}\n"), _column(c), F.lit(f"\n{TEXT_CLOSE}"))


def sse(event: Column, data: Column) -> Column:
    """A server-sent event's frame."""
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x, F.lit("\n"))), ""), F.lit("\n"))


def env_bool(c: Column, default: bool) -> Column:
    return F.when(strip(c) == "", F.lit(default)).otherwise(F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "on", "evet"), F.lit(default)))


def env_number(c: Column, kind: str, default: float) -> Column:
    return F.coalesce(strip(c).try_cast(kind), F.lit(default).cast(kind))
