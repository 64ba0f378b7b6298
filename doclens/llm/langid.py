"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (one to three letters, a space standing for
either end of a word) in order of frequency. A document's own most frequent n-grams are compared to
each profile by out-of-place distance: the sum of rank differences, an absent n-gram counting as the
greatest difference. The nearest language wins; ties go to the name that sorts first.

Profiles are counted on a bounded sample of the labelled documents (``MOST_LEARNED`` expected, drawn by
a hash of the id), so the number of languages and the size of the profiles are bounded by that of the sample.
Null texts and texts without a letter (marks alone are none) get ``und`` with score 0; so does everything
when there is nothing to learn from. Texts are read whole, in any length; repeated rows get
equal answers. Every letter and mark has a code of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.common import bound_arrow, fold, free, slices, table, tidy, without

RANKS = 300
MOST_LEARNED = 50_000
#: Spread of normalised distances at which a score falls by a factor e.
SPREAD = 0.02
UNKNOWN = "und"


#: Bits of a letter's code in an n-gram, and texts counted at once (the bits that are left).
BITS = 18
TEXTS = 1 << (63 - 3 * BITS)
#: What stands for either end of a word; 0 stands for the letters that a shorter n-gram does not have.
END = 1


@lru_cache(1)
def _codes() -> np.ndarray:
    """Code of every code point, ascending from END + 1 for letters and marks and END for all else."""
    kind = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    own = np.flatnonzero((kind == "L") | (kind == "M"))
    out = np.full(0x110000, END, np.uint32)
    out[own] = np.arange(len(own)) + END + 1
    return out


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's position, n-gram, count), ascending by text and n-gram."""
    parts = [_gram_counts(texts[a : a + TEXTS]) for a in range(0, max(len(texts), 1), TEXTS)]
    return tuple(np.concatenate([p[i] + (k * TEXTS if i == 0 else 0) for k, p in enumerate(parts)]) for i in range(3))


def _gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = ["\n" + t.lower() + "\n" for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    code = _codes()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(low), dtype=np.uint64), sizes)
    keep = code != END
    keep[1:] |= (code[:-1] != END) | (doc[1:] != doc[:-1])
    keep[:1] = True
    c, doc = code[keep].astype(np.uint64), doc[keep]
    at = doc << np.uint64(3 * BITS)
    s1, s2, end = np.uint64(2 * BITS), np.uint64(BITS), np.uint64(END)
    first, second, letter = c << s1, c << s2, c != end
    one = (at | first)[letter]
    same = doc[1:] == doc[:-1]
    # the two ends of a text may meet with nothing between them
    two = (at[1:] | first[:-1] | second[1:])[same & (letter[:-1] | letter[1:])]
    three = (at[2:] | first[:-2] | second[1:-1] | c[2:])[same[1:] & same[:-1] & letter[1:-1]] if len(c) > 2 else one[:0]
    keys = np.concatenate([one, two, three])
    keys.sort()
    if not len(keys):
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(start, len(keys)))
    keys = keys[start]
    return (keys >> np.uint64(3 * BITS)).astype(np.int64), keys & np.uint64((1 << (3 * BITS)) - 1), counts


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, rank) of the most frequent n-grams of each document; ties by n-gram."""
    order = np.argsort((doc << 32) - count, kind="stable")
    doc, gram = doc[order], gram[order]
    start = np.searchsorted(doc, doc, side="left")
    rank = np.arange(len(doc)) - start
    keep = rank < ranks
    return doc[keep], gram[keep], rank[keep]


class Profiles:
    """Rank-order profiles: language to n-grams, most frequent first."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int = RANKS):
        self.ranks, self.langs = ranks, sorted(profiles)
        self.keys, self.at = [], []
        for lang in self.langs:
            grams = np.array(profiles[lang], np.uint64)
            order = np.argsort(grams)
            self.keys.append(grams[order])
            self.at.append(order)

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised distance of each text to each language, and each text's number of n-grams."""
        doc, gram, rank = ranked(*gram_counts(texts), self.ranks)
        n = np.bincount(doc, minlength=len(texts))
        out = np.ones((len(texts), len(self.langs)))
        for j, (keys, at) in enumerate(zip(self.keys, self.at, strict=True)):
            where = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
            hit = keys[where] == gram if len(keys) else np.zeros(len(gram), bool)
            gap = np.where(hit, np.abs(rank - at[where]), self.ranks) if len(keys) else np.full(len(gram), self.ranks)
            out[:, j] = np.bincount(doc, weights=gap, minlength=len(texts)) / (np.maximum(n, 1) * self.ranks)
        return out, n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        far, _ = self.distances(texts)
        best = far.argmin(1)
        weight = np.exp((far.min(1)[:, None] - far) / SPREAD)
        score = weight.max(1) / weight.sum(1)
        some = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, some, strict=True)], np.where(some, score, 0.0).astype(np.float64)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", most: int = MOST_LEARNED, ranks: int = RANKS) -> Profiles:
    """Profiles from the rows with text and language; about ``most`` of them if there are more."""
    spark = docs.sparkSession
    bound_arrow(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    n = docs.where(F.col(lang).isNotNull()).count()
    if n > most:
        rows = rows.where(F.xxhash64(F.col("key").cast("string")) < int(-(1 << 63) + (1 << 64) * (most / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            doc, gram, count = gram_counts(part.column("text").to_pylist())
            if not len(doc):
                continue
            own = np.array([place[x] for x in langs])[doc]
            order = np.lexsort((gram, own))
            own, gram = own[order], gram[order]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])]))
            total = np.add.reduceat(count[order], new)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in own[new]], pa.string()), pa.array(gram[new].astype(np.int64)), pa.array(total)], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= ranks)
    found = top.collect()  # bounded: languages of the sample times ranks
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in found:
        profiles.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles({k: [g for _, g in sorted(v)] for k, v in profiles.items()}, ranks)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Append the predicted language and its score to every row, in place of input columns of those names."""
    docs = without(docs, *names)
    spark = docs.sparkSession
    bound_arrow(spark)
    sent = spark.sparkContext.broadcast(profiles)  # languages times ranks, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            langs, score = sent.value.predict([t or "" for t in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score)], names=[*part.schema.names, *names])

    return docs.mapInArrow(tidy(run), T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the language of every document, learned from the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(fold("doc_id", 4) != 2))
    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return identify(rows, profiles).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognisable language go. The columns are those of documents, so the prediction goes too."""
    profiles = learn(docs.select("doc_id", "text", "lang").where(fold("doc_id", 4) != 2))
    name = free(docs, "_lang")
    return identify(docs, profiles, names=(f"{name}_pred", f"{name}_score")).where(F.col(f"{name}_pred") != UNKNOWN).drop(f"{name}_pred", f"{name}_score")
