"""Filters, joins and order of findings (doc_id, type, excerpt, explanation, suggestion, rule_id, confidence, start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.functions import text as t
from doclens.operators.spans import beside, overlaps, reached

HEADING_NOISE = ("GRAMER-TEKRAR", "IMLA-NOKTALAMA")
COLUMNS = ("doc_id", "type", "excerpt", "explanation", "suggestion", "rule_id", "confidence", "start", "end")


def drop_noop(findings: DataFrame) -> DataFrame:
    return findings.where(~t.is_noop("excerpt", "suggestion"))


def drop_unlocated(findings: DataFrame) -> DataFrame:
    return findings.where("start is not null and end is not null")


def drop_corrupt(findings: DataFrame) -> DataFrame:
    return findings.where(~t.is_corrupt("excerpt", "suggestion"))


def drop_context_satisfied(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Drop a suggestion that only adds what follows the excerpt anyway.

    Only findings whose suggestion goes on after the excerpt meet a text.
    """
    longer = F.coalesce(F.col("suggestion").startswith(F.col("excerpt")) & (F.length("suggestion") > F.length("excerpt")) & F.col("start").isNotNull(), F.lit(False))
    extra = F.substring("suggestion", F.length("excerpt") + 1, F.length("suggestion"))
    follows = F.substring("_text", F.col("end") + 1, F.length(extra)) == extra
    # Spark takes texts that are yet to be made for as small as their file, and would send them all to the driver and every executor
    own = texts.select("doc_id", F.col("text").alias("_text")).hint("shuffle_hash")
    some = findings.where(longer).join(own, "doc_id", "left")
    return findings.where(~longer).unionByName(some.where(~F.coalesce(follows, F.lit(False))).drop("_text"))


def merge(fixed: DataFrame, judged: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All dictionary findings, and the judge's that overlap none of them; those without a place stay."""
    free = beside(judged, fixed, keys, _fixed=F.lit(True))
    return fixed.unionByName(free.where(~overlaps("_fixed")).drop("_fixed"))


def cross_pass_dedup(findings: DataFrame, dealt: bool = False) -> DataFrame:
    """Of overlapping findings of different kinds with the same excerpt or the same one-word change, the strongest kind stays.

    All are compared with the whole input: those of one excerpt in one pass over them in order, then those of one change.
    dealt: the rows are dealt by their document already, so nothing is shuffled; if they are not, Spark shuffles for each pass.
    """
    prio = F.when(F.col("type") == "imla", 0).when(F.col("type") == "dil_bilgisi", 1).when(F.col("type") == "ton", 2)
    own = findings if dealt else findings.repartition("doc_id")  # once for both passes
    keyed = own.withColumns({"_norm": t.norm_here("excerpt"), "_sug": t.norm_here("suggestion")}).withColumns({"_prio": prio, "_atomic": t.atomic(F.col("_norm"), F.col("_sug")), "_gone": F.lit(False)}).drop("_sug")
    placed = F.col("_prio").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    for key in ("_norm", "_atomic"):
        # all but the weakest kind stand once more, as what may cover others
        same = placed & F.col(key).isNotNull()
        rows = keyed.withColumn("_asks", F.explode(F.when(same & (F.col("_prio") < 2), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
        rows = reached(rows, F.col("_asks"), ["doc_id", key], _first=F.col("_prio") == 0, _second=F.col("_prio") == 1)
        hit = ((F.col("_prio") > 0) & overlaps("_first")) | ((F.col("_prio") > 1) & overlaps("_second"))
        keyed = rows.withColumn("_gone", F.col("_gone") | F.coalesce(same & hit, F.lit(False))).drop("_asks", "_first", "_second")
    return keyed.where(~F.col("_gone")).drop("_norm", "_prio", "_atomic", "_gone")


def drop_structural(findings: DataFrame, placed: DataFrame) -> DataFrame:
    """Drop findings in table cells and contents lines (but for consistency), and noise rules in headings."""
    rows = beside(findings, placed.where("kind <> 'paragraf'"), _cell=F.col("kind").isin("tablo_hucresi", "icindekiler"), _head=F.col("kind") == "baslik")
    cell = overlaps("_cell") & F.coalesce(F.col("type") != "tutarlilik", F.lit(False))
    head = overlaps("_head") & F.coalesce(F.col("rule_id").isin(*HEADING_NOISE), F.lit(False))
    return rows.where(~(cell | head)).drop("_cell", "_head")


def decimal_summary(placed: DataFrame, least: int = 3) -> DataFrame:
    """One consistency finding for a document whose table cells have ``least`` decimals with a dot or more."""
    cells = placed.where("kind = 'tablo_hucresi'").select("doc_id", "start", "text", F.regexp_extract_all("text", F.lit(rf"({t.DIGIT}+\.{t.DIGIT}+)"), F.lit(1)).alias("hits"))
    first = F.get("hits", F.lit(0))
    per = cells.where("size(hits) > 0").select("doc_id", F.size("hits").alias("n"), F.struct((F.col("start") + F.position(first, F.col("text")) - 1).alias("start"), first.alias("hit")).alias("f"))
    rows = per.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("f").alias("f")).where(F.col("n") >= least)
    note = F.concat(F.lit("Belge genelinde tablo değerlerinde ondalık ayraç olarak nokta kullanılmış ("), F.col("n").cast("string"), F.lit(" yerde); TDK'ya göre ondalık ayraç virgüldür. Tek tek işaretlemek yerine toplu bildirilmiştir."))
    return rows.select("doc_id", F.lit("tutarlilik").alias("type"), F.col("f.hit").alias("excerpt"), note.alias("explanation"), F.replace(F.col("f.hit"), F.lit("."), F.lit(",")).alias("suggestion"), F.lit("IMLA-BIRIM").alias("rule_id"), F.lit(None).cast("double").alias("confidence"), F.col("f.start").cast("int").alias("start"), (F.col("f.start") + F.length("f.hit")).cast("int").alias("end"))


_PLACE = ("start", "end", "type", "excerpt")


def _total() -> W:
    """A document's findings in their total order."""
    return W.partitionBy("doc_id").orderBy(F.col("start").isNull(), *_PLACE, "suggestion", "explanation", "rule_id", "confidence")


def dedup(findings: DataFrame) -> DataFrame:
    """First of equal (type, start, end, excerpt) in the total order: equal ones follow each other in it."""
    own = F.struct(*_PLACE)
    before = F.lag(own).over(_total())
    return findings.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(own)).drop("_before")


def ordered(findings: DataFrame) -> DataFrame:
    """Add position, the place in the document's total order."""
    return findings.withColumn("position", F.row_number().over(_total()).cast("int"))


def finalize(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """The fixed chain; its order can be seen in the result, as a corrupt finding may win before it is dropped."""
    rows = drop_context_satisfied(drop_unlocated(findings), texts)
    return ordered(drop_corrupt(dedup(cross_pass_dedup(rows))))


def observations(rows: DataFrame) -> DataFrame:
    """Distinct (excerpt, note) of each document, ordered."""
    order = W.partitionBy("doc_id").orderBy("excerpt", "note")
    return rows.select("doc_id", "excerpt", "note").distinct().withColumn("position", F.row_number().over(order).cast("int"))


def counts(findings: DataFrame) -> DataFrame:
    """Findings of each document in total and by axis; other kinds count in the total alone."""
    axis = lambda a: F.sum((F.col("type") == a).cast("long")).alias(a)
    return findings.groupBy("doc_id").agg(F.count("*").alias("toplam"), *map(axis, ("imla", "dil_bilgisi", "ton", "tutarlilik")))


def resolve_spelling(candidates: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Dictionary findings with the judge's decisions (doc_id, idx, word, is_error, correction) of the same keys.

    An exact word comes before a folded one, the first decision before later ones. No decision keeps the finding;
    one that finds no error drops it.
    """
    # a decision and the words that it may stand for are of one folded form, so one pass over a document's words by it finds all
    made = F.struct("idx", "is_error", "correction")
    asked = candidates.withColumns({"_word": F.col("excerpt"), "_folded": t.casefold("excerpt"), "_asks": F.lit(True)})
    told = decisions.where("word is not null").select(*keys, F.col("word").alias("_word"), t.casefold("word").alias("_folded"), made.alias("_made"), F.lit(False).alias("_asks"))
    same, form = W.partitionBy(*keys, "_folded", "_word"), W.partitionBy(*keys, "_folded")
    rows = asked.unionByName(told, allowMissingColumns=True).withColumn("_exact", F.min("_made").over(same))
    rows = rows.withColumns({"_any": F.min("_made").over(form), "_low": F.min(F.when(F.col("_word") == F.col("_folded"), F.col("_made"))).over(form)}).where("_asks")
    d = F.coalesce("_exact", F.when(F.col("_word") == F.col("_folded"), F.col("_any")), "_low", "_any")
    fix = t.strip(d["correction"])
    rows = rows.withColumn("_d", d).where("_d is null or _d.is_error")
    return rows.withColumn("suggestion", F.when(fix != "", t.match_case(F.col("excerpt"), fix)).otherwise(F.col("suggestion"))).drop("_word", "_folded", "_asks", "_made", "_exact", "_any", "_low", "_d")
