"""Terminology: an inventory of terms, and the clusters of forms that may be the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.functions import text as t

MOST_OF_A_CONCEPT = 3


def inventory(entries: DataFrame) -> DataFrame:
    """(doc_id, surface, n, concepts) of indexable surfaces from (doc_id, surface, concept)."""
    rows = entries.select("doc_id", t.strip("surface").alias("surface"), t.strip("concept").alias("concept")).where(t.is_indexable("surface"))
    # sets are gathered from few rows: beyond 128 groups they are made by sorting
    each = rows.groupBy("doc_id", "surface", "concept").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id", "surface").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.when(F.col("concept") != "", F.col("concept")))).alias("concepts"))


def surface_clusters(terms: DataFrame) -> DataFrame:
    """(doc_id, members): two surfaces or more of one key."""
    return terms.groupBy("doc_id", t.surface_key("surface").alias("key")).agg(F.array_sort(F.collect_set("surface")).alias("members")).where("size(members) >= 2").select("doc_id", "members")


def concept_clusters(terms: DataFrame) -> DataFrame:
    """(doc_id, members): two or three surfaces of one concept; more belong to a generic one."""
    rows = terms.select("doc_id", "surface", F.explode("concepts").alias("concept")).select("doc_id", "surface", t.concept_key("concept").alias("key")).where("key <> ''").distinct()
    # the count comes first, so a generic concept's surfaces are never gathered
    few = rows.withColumn("_n", F.count("*").over(W.partitionBy("doc_id", "key"))).where(F.col("_n").between(2, MOST_OF_A_CONCEPT))
    return few.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("surface")).alias("members")).select("doc_id", "members")


def _candidates(terms: DataFrame) -> DataFrame:
    """(doc_id, members): the clusters of both families, without repeats, as their terms (surface, n, concept: the shortest one).

    A term stands once for each of its keys, so all clusters come from one look at the terms; each has all that its lines need.
    """
    shortest = F.get(F.transform(F.array_sort(F.transform("concepts", lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))), lambda s: s["c"]), F.lit(0))
    key = lambda family, k: F.struct(F.lit(family).alias("family"), k.alias("key"))
    own = F.array_distinct(F.filter(F.transform("concepts", t.concept_key), lambda k: k != ""))
    keys = F.concat(F.array(key(0, t.surface_key("surface"))), F.transform(own, lambda k: key(1, k)))
    rows = terms.select("doc_id", F.struct("surface", "n", shortest.alias("concept")).alias("term"), F.explode(keys).alias("k")).select("doc_id", "term", "k.family", "k.key")
    # the count comes first, so a generic concept's surfaces are never gathered
    some = rows.withColumn("_n", F.count("*").over(W.partitionBy("doc_id", "family", "key"))).where((F.col("_n") >= 2) & ((F.col("family") == 0) | (F.col("_n") <= MOST_OF_A_CONCEPT)))
    both = some.groupBy("doc_id", "family", "key").agg(F.array_sort(F.collect_list("term")).alias("members")).select("doc_id", "members").distinct()
    return both.where(F.size(F.array_distinct(F.transform("members", lambda m: t.casefold(m["surface"])))) > 1)


def candidate_clusters(terms: DataFrame) -> DataFrame:
    """Both families without repeats and without those that differ in letter case alone."""
    return _candidates(terms).select("doc_id", F.col("members.surface").alias("members"))


def index(terms: DataFrame) -> DataFrame:
    """(doc_id, cluster, line_no, line): the numbered rendering, a row for each line."""
    # terms of one surface are one term in a document, so their order is that of the surfaces
    numbered = _candidates(terms).withColumn("cluster", F.row_number().over(W.partitionBy("doc_id").orderBy("members")).cast("int"))
    head = F.concat(F.lit("Küme "), F.col("cluster").cast("string"), F.lit(" (aynı şey olabilir mi?):"))
    line = lambda m: F.concat(F.lit("  - «"), m["surface"], F.lit("» ("), m["n"].cast("string"), F.lit(" kez) — "), F.coalesce(m["concept"], F.lit("?")))
    return numbered.select("doc_id", "cluster", F.posexplode(F.concat(F.array(head), F.transform("members", line))).alias("line_no", "line"))


def index_text(terms: DataFrame) -> DataFrame:
    """(doc_id, index): all lines of a document as one text."""
    return index(terms).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "line_no", "line"))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("index"))
