"""Document fingerprints: a threshold-scaled sketch (every shingle hash below a fixed fraction is kept).

All of it is SQL functions. A shingle is five successive words (a text of one to four words is one
shingle); words are the lower-cased runs of letters and digits. Since the kept hashes do not depend on
the document's size, sketches of very unequal documents compare without loss. A text none of whose hashes lies under
the bound keeps its least one, so that unlike short texts have unlike sketches; a merge drops hashes above the bound as soon as one
lies under it, so the merged sketch is always that of both texts' shingles together.

Null and empty texts, and texts without a word, alone have the empty sketch, "". The likeness of two of them
is 1, that of one and any other text 0. Repeated rows get equal sketches; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.llm.common import table

WORDS = 5
#: One shingle hash in so many is kept.
SCALE = 8
#: Ranges of ids into which documents are dealt to find each one's successor.
RANGES = 512
#: Rows that a part of a range has, about.
RANGE_ROWS = 2000


def words(text: Column) -> Column:
    """Array of lower-cased words; empty for null and for texts without one."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """Hash of every shingle, repeated ones included. Words are hashed once, then combined."""
    each = F.transform(words(text), lambda w: F.xxhash64(w))
    # let() by a one-element array, as else the words would be made anew at each use
    whole = F.transform(
        F.array(each),
        lambda h: F.when(
            F.size(h) >= n,
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])),
        ).otherwise(F.when(F.size(h) > 0, F.array(F.xxhash64(*[F.coalesce(F.get(h, F.lit(k)), F.lit(0).cast("long")) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))),
    )
    return F.element_at(whole, 1)


def sketch(text: Column, scale: int = SCALE, n: int = WORDS) -> Column:
    """Ascending distinct hashes under 1/scale of the hash range, or the least hash if there is none."""
    return F.element_at(F.transform(F.array(shingle_hashes(text, n)), lambda h: F.array_sort(F.array_distinct(_kept(h, scale)))), 1)


def _kept(hashes: Column, scale: int) -> Column:
    under = F.filter(hashes, lambda h: h < F.lit(-(1 << 63) + (1 << 64) // scale).cast("long"))
    own = F.transform(F.array(under), lambda u: F.when((F.size(u) > 0) | (F.size(hashes) == 0), u).otherwise(F.array(F.array_min(hashes))))
    return F.element_at(own, 1)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(_kept(F.array_union(a, b), scale))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = common(a, b)
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles that b has."""
    return F.when(F.size(a) > 0, common(a, b) / F.size(a)).otherwise(F.when(F.size(b) > 0, F.lit(0.0)).otherwise(F.lit(1.0)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text): the text of the row after, by ascending key and then text; the first after the last.

    Rows go to RANGES key ranges bounded by quantiles, each cut evenly by key into as many parts as keep a part at
    about RANGE_ROWS, one window task each. The first row of every part is also sent to the part before it, so no
    window spans the whole table. Keys are numbers. Null texts are empty; a null key comes first.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # one row: the least key, the quantiles, the greatest key, and the parts of a range
    marks = F.concat(F.array(F.min("k")), F.percentile_approx("k", [i / RANGES for i in range(1, RANGES)], 10000), F.array(F.max("k")))
    cuts = docs.select(F.col(key).alias("k")).agg(F.array_distinct(marks).alias("cuts"), F.greatest(F.lit(1), F.ceil(F.count("*") / (RANGES * RANGE_ROWS))).cast("int").alias("cut"))
    ranged = rows.join(F.broadcast(cuts), how="cross").withColumn("range", F.greatest(F.lit(1), F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("k"))), F.lit(1))))
    low, high = F.get("cuts", F.col("range") - 1).cast("double"), F.get("cuts", F.col("range")).cast("double")
    part = F.least(F.floor((F.col("k").cast("double") - low) / (high - low) * F.col("cut")), F.col("cut") - 1)
    dealt = ranged.select("k", "t", "range", F.greatest(F.coalesce(part.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("part"))
    firsts = dealt.groupBy("range", "part").agg(F.min(F.struct("k", "t")).alias("first"))
    ring = firsts.groupBy("range").agg(F.max("part").alias("last")).groupBy().agg(F.array_sort(F.collect_list(F.struct("range", "last"))).alias("ring"))  # RANGES entries at most
    prior = F.lag("part").over(W.partitionBy("range").orderBy("part"))
    there = firsts.withColumn("prior", prior).join(F.broadcast(ring), how="cross")
    turn = F.coalesce(F.array_max(F.filter("ring", lambda r: r["range"] < F.col("range"))), F.array_max("ring"))
    there = there.withColumn("turn", turn).withColumn("to", F.when(F.col("prior").isNull(), F.col("turn.range")).otherwise(F.col("range")))
    before = there.select(F.col("first.k").alias("k"), F.col("first.t").alias("t"), F.col("to").alias("range"), F.coalesce("prior", "turn.last").alias("part"), F.lit(1).alias("guest"))
    every = dealt.withColumn("guest", F.lit(0)).unionByName(before)
    # within a part a guest stands last, whatever its key
    return every.selectExpr("k", "t", "guest", "lead(t) over (partition by range, part order by guest, k, t) as next_text").where("guest = 0").select(F.col("k").alias(key), F.col("t").alias(text), "next_text")


def edited(text: Column, after: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many of ``after``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: fingerprints of every document and of its edited text, and their likeness."""
    rows = with_next(table(spark, sf_dir, "documents"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("e"), F.array(F.col("text"), edited(F.col("text"), F.col("next_text")), F.col("next_text")).alias("all"))
    made = rows.select("doc_id", "n_chars", F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"), F.transform("all", lambda t: sketch(t)).alias("s"))
    # one evaluation of the three sketches, then the columns made from them
    row = F.transform(F.array("s"), lambda s: F.struct(as_text(F.get(s, F.lit(0))).alias("fingerprint"), as_text(F.get(s, F.lit(1))).alias("edited_fingerprint"), resemblance(F.get(s, F.lit(0)), F.get(s, F.lit(1))).alias("near_edited"), resemblance(F.get(s, F.lit(0)), F.get(s, F.lit(2))).alias("near_next")))
    return made.select("doc_id", "n_chars", "edited_sha256", F.inline(row))
