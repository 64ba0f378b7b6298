"""Rule text by section, and a deterministic judge for the rules that need no context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions import text as t
from doclens.operators import terms
from doclens.operators.lexicon import _WORD, TOKENS, WORD_CLASS, token_array

# Section headings and what each pass is sent.
HEADINGS = {"A.": "imla", "B.": "dil_bilgisi", "C.": "ton"}
PURPOSES = {"local": ("imla", "dil_bilgisi"), "tone": ("ton",), "all": ("imla", "dil_bilgisi", "ton")}
#: Closed lists of misspelt and informal words (wrong, right, kind, rule).
LITERALS = [
    ("yanlız", "yalnız", "imla", "IMLA-YALNIZ"),
    ("yannış", "yanlış", "imla", "IMLA-YANLIS"),
    ("yalnış", "yanlış", "imla", "IMLA-YANLIS"),
    ("herkez", "herkes", "imla", "IMLA-HERKES"),
    ("herşey", "her şey", "imla", "IMLA-HERSEY"),
    ("yada", "ya da", "imla", "IMLA-AYRI"),
    ("slm", "selam", "ton", "TON-RESMI"),
    ("tşk", "teşekkürler", "ton", "TON-RESMI"),
    ("bi", "bir", "ton", "TON-RESMI"),
    ("naber", "nasılsınız", "ton", "TON-RESMI"),
    ("şöför", "şoför", "imla", "IMLA-YABANCI"),
    ("orjinal", "orijinal", "imla", "IMLA-YABANCI"),
    ("egzos", "egzoz", "imla", "IMLA-YABANCI"),
    ("espiri", "espri", "imla", "IMLA-YABANCI"),
    ("süpriz", "sürpriz", "imla", "IMLA-YABANCI"),
    ("laboratuar", "laboratuvar", "imla", "IMLA-YABANCI"),
    ("aksesuvar", "aksesuar", "imla", "IMLA-YABANCI"),
    ("antreman", "antrenman", "imla", "IMLA-YABANCI"),
    ("lizans", "lisans", "imla", "IMLA-YABANCI"),
    ("perfomans", "performans", "imla", "IMLA-YABANCI"),
    ("konfigrasyon", "konfigürasyon", "imla", "IMLA-YABANCI"),
    ("saatlar", "saatler", "imla", "IMLA-SAAT"),
    ("dönersermaye", "döner sermaye", "imla", "IMLA-AYRI"),
]
#: Two words that are written as one, and unit signs in the wrong letter case.
PHRASES = [
    ("bir kaç", "birkaç", "imla", "IMLA-BITISIK"),
    ("bir çok", "birçok", "imla", "IMLA-BITISIK"),
    ("her hangi", "herhangi", "imla", "IMLA-BITISIK"),
    ("gök delen", "gökdelen", "imla", "IMLA-BITISIK"),
    ("red ettik", "reddettik", "imla", "IMLA-BITISIK"),
    ("işbu vesileyle", "bu vesileyle", "ton", "TON-KLISE"),
]
UNITS = [("Khz", "kHz"), ("KHz", "kHz"), ("Mhz", "MHz"), ("mhz", "MHz")]
#: Words that stand twice for emphasis, and words after which a noun has no plural.
DOUBLED = "yavaş adım azar teker tek ikişer"
NUMBERS = "iki üç dört beş altı yedi sekiz dokuz on birkaç birçok çeşitli"
ORDINAL = rf"({t.DIGIT}+\.['’][{WORD_CLASS}]+)"
COMMA_AND = rf"([{WORD_CLASS}]+, ve) "
#: A term is a capitalised word, or several that hyphens and apostrophes join.
TERM = rf"([{WORD_CLASS}]+(?:[-'’][{WORD_CLASS}]+)*)"
NOISE = r"([!?]{2,})"
#: Emitting places of what is found by pattern or word, one range for each rule.
DECIMAL_AT, LITERAL_AT, PHRASE_AT, ORDINAL_AT, AND_AT, PLURAL_AT, UNIT_AT = (k * 1_000_000 for k in range(1, 8))
FINDING = "array<struct<pass:string,type:string,excerpt:string,explanation:string,suggestion:string,rule_id:string,confidence:double,at:int>>"


def default_text() -> str:
    """The rule text that comes with the package: its closed lists and patterns, by section."""
    line = lambda wrong, right, rule: f"- {rule}: \"{right}\" ({wrong} değil)."
    part = lambda kind: [line(w, f, r) for w, f, k, r in (*LITERALS, *PHRASES) if k == kind]
    own = {"A. İmla": [*part("imla"), *(line(w, f, "IMLA-BIRIM") for w, f in UNITS), "- IMLA-SIRA-SAYI: 8'inci (8.'inci değil).", "- IMLA-NOKTALAMA: bağlaç \"ve\"den önce virgül konmaz."],
           "B. Dil bilgisi": ["- GRAMER-TEKRAR: art arda aynı kelime; ikilemeler (" + ", ".join(DOUBLED.split()) + ") hata değildir.", "- GRAMER-SAYI-UYUM: sayıdan sonra çoğul eki kullanılmaz."],
           "C. Ton": part("ton")}
    return "Kurallar\n\n" + "\n".join(f"## {head}\n" + "\n".join(lines) + "\n" for head, lines in own.items())


def read(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(rule_set, text) of a rule file, or of the package's own rules. A file is read anew each time."""
    if not path:
        return spark.createDataFrame([("default", default_text())], "rule_set string, text string")
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("rule_set"), F.col("value").alias("text"))


def texts_by_purpose(spark: SparkSession, path: str | None = None) -> dict[str, str]:
    """What each pass is sent of the rules; a rule file is one text, of bounded size."""
    rows = read(spark, path)
    return {p: slice_for(rows, p).first()["text"] for p in PURPOSES}


def sections(rules: DataFrame) -> DataFrame:
    """(rule_set, pos, kind, body) of rule texts (rule_set, text); pos 0 is the preamble, kind is null where none is known."""
    parts = F.split(F.regexp_replace("text", r"(?m)^## ", "\ue000## "), "\ue000")
    rows = rules.select("rule_set", F.posexplode(parts).alias("pos", "body"))
    head = t.strip(F.substring_index(F.substring("body", 4, 1 << 30), "\n", 1))
    kind = F.when(F.col("pos") > 0, F.coalesce(*(F.when(head.startswith(k), v) for k, v in HEADINGS.items())))
    return rows.select("rule_set", "pos", kind.alias("kind"), "body")


def slice_for(rules: DataFrame, purpose: str) -> DataFrame:
    """(rule_set, text): preamble and the purpose's sections; the whole text if none is picked. Unknown purposes get all."""
    wanted = PURPOSES.get(purpose, PURPOSES["all"])
    rows = sections(rules).where((F.col("pos") == 0) | F.col("kind").isin(*wanted))
    picked = rows.groupBy("rule_set").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("p"))
    text = F.concat(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["body"]), ""), rf"[{t.WS}]+\z", ""), F.lit("\n"))
    return rules.join(picked, "rule_set").select("rule_set", F.when(F.size("p") > 1, text).otherwise(F.col("text")).alias("text"))


def _made(p: str, kind: str, excerpt: Column, note: str, suggestion: Column, rule: str | Column, at: Column, sure: float) -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(F.lit(p).alias("pass"), F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), excerpt.alias("excerpt"), F.lit(note).alias("explanation"), suggestion.alias("suggestion"), rule.alias("rule_id"), F.lit(sure).alias("confidence"), at.cast("int").alias("at"))


def neighbours(words: Column) -> Column:
    """(a, b) of neighbouring words one character apart, from tokens()."""
    after = F.concat(F.slice(words, 2, 1 << 30), F.array(F.lit(None).cast("struct<start:int,word:string>")))
    both = F.zip_with(words, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(both, lambda p: p["b"]["start"] == p["a"]["start"] + F.length(p["a"]["word"]) + 1)


def _blank_between(text: Column, p: Column) -> Column:
    return F.substring(text, p["b"]["start"], F.lit(1)) == " "


def repeated_words(words: Column) -> Column:
    """Neighbouring equal words, but for those that stand twice for emphasis; array of findings."""
    pairs = F.filter(neighbours(words), lambda p: (p["a"]["word"] == p["b"]["word"]) & ~t.tr_lower(p["a"]["word"]).isin(*DOUBLED.split()))
    return F.transform(pairs, lambda p: _made("local", "dil_bilgisi", F.concat(p["a"]["word"], F.lit(" "), p["a"]["word"]), "Art arda aynı kelime.", p["a"]["word"], "GRAMER-TEKRAR", p["a"]["start"], 0.9))


def as_tone(found: Column) -> Column:
    """The same findings as another pass would name them."""
    return F.transform(found, lambda f: F.struct(F.lit("tone").alias("pass"), F.lit("ton").alias("type"), *(f[c].alias(c) for c in ("excerpt", "explanation", "suggestion", "rule_id", "confidence", "at"))))


def _by_pattern(text: Column, pattern: str, note: str, fix: Callable[[Column], Column], rule: str, at: int) -> Column:
    """What a pattern's group finds; array of findings (their places are found later)."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m, i: _made("local", "imla", m, note, fix(m), rule, at + i, 0.8))


def decimals(text: Column) -> Column:
    """Decimals with a dot; array of findings."""
    return _by_pattern(text, rf"({t.DIGIT}+\.{t.DIGIT}+)", "Ondalık ayraç virgüldür.", lambda m: F.replace(m, F.lit("."), F.lit(",")), "IMLA-BIRIM", DECIMAL_AT)


def ordinals(text: Column) -> Column:
    """Ordinal numbers with both a dot and a suffix; array of findings."""
    return _by_pattern(text, ORDINAL, "Sıra sayısında nokta ve ek birlikte kullanılmaz.", lambda m: F.replace(m, F.lit("."), F.lit("")), "IMLA-SIRA-SAYI", ORDINAL_AT)


def commas(text: Column) -> Column:
    """Commas before "ve"; array of findings."""
    return _by_pattern(text, COMMA_AND, "Bağlaçtan önce virgül konmaz.", lambda m: F.replace(m, F.lit(", ve"), F.lit(" ve")), "IMLA-NOKTALAMA", AND_AT)


def _table(rows: list[tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(x) for key, *rest in rows for x in (key, "\t".join(rest))))


def _part(h: Column, i: int) -> Column:
    return F.split_part(h["m"], F.lit("\t"), F.lit(i))


def literals(words: Column) -> Column:
    """Words of the closed lists; array of findings."""
    hits = F.filter(F.transform(words, lambda w: F.struct(w.alias("w"), F.try_element_at(_table(LITERALS), t.tr_lower(w["word"])).alias("m"))), lambda h: h["m"].isNotNull())
    return F.transform(hits, lambda h: _made("local", _part(h, 2), h["w"]["word"], "Kapalı listede yanlış biçim.", t.match_case(h["w"]["word"], _part(h, 1)), _part(h, 3), LITERAL_AT + h["w"]["start"], 1.0))


def units(words: Column) -> Column:
    """Unit signs in the wrong letter case; array of findings."""
    hits = F.filter(F.transform(words, lambda w: F.struct(w.alias("w"), F.try_element_at(_table(UNITS), w["word"]).alias("m"))), lambda h: h["m"].isNotNull())
    return F.transform(hits, lambda h: _made("local", "imla", h["w"]["word"], "Birim simgesinin harfleri yanlış.", h["m"], "IMLA-BIRIM", UNIT_AT + h["w"]["start"], 1.0))


def phrases(text: Column, words: Column) -> Column:
    """Pairs of words that are written as one; array of findings."""
    key = lambda p: t.tr_lower(F.concat(p["a"]["word"], F.lit(" "), p["b"]["word"]))
    hits = F.filter(F.transform(neighbours(words), lambda p: F.struct(p.alias("p"), F.try_element_at(_table(PHRASES), key(p)).alias("m"))), lambda h: h["m"].isNotNull() & _blank_between(text, h["p"]))
    return F.transform(hits, lambda h: _made("local", _part(h, 2), F.concat(h["p"]["a"]["word"], F.lit(" "), h["p"]["b"]["word"]), "Kapalı listede yanlış biçim.", t.match_case(h["p"]["a"]["word"], _part(h, 1)), _part(h, 3), PHRASE_AT + h["p"]["a"]["start"], 1.0))


def plurals(text: Column, words: Column) -> Column:
    """Plural nouns after a number; array of findings."""
    hits = F.filter(neighbours(words), lambda p: t.tr_lower(p["a"]["word"]).isin(*NUMBERS.split()) & (F.length(p["b"]["word"]) > 5) & F.right(p["b"]["word"], F.lit(3)).isin("lar", "ler") & _blank_between(text, p))
    both = lambda p, end: F.concat(p["a"]["word"], F.lit(" "), F.left(p["b"]["word"], F.length(p["b"]["word"]) - end))
    return F.transform(hits, lambda p: _made("local", "dil_bilgisi", both(p, 0), "Sayıdan sonra çoğul eki kullanılmaz.", both(p, 3), "GRAMER-SAYI-UYUM", PLURAL_AT + p["a"]["start"], 0.8))


MATCHERS: dict[str, Callable[[Column, Column], Column]] = {
    "repeated_words": lambda x, w: repeated_words(w), "decimals": lambda x, w: decimals(x), "literals": lambda x, w: literals(w), "phrases": phrases,
    "ordinals": lambda x, w: ordinals(x), "commas": lambda x, w: commas(x), "plurals": plurals, "units": lambda x, w: units(w),
}


def _rows(rows: DataFrame, *found: Column) -> DataFrame:
    every = rows.select("doc_id", "chunk_id", F.explode(F.concat(*(x.cast(FINDING) for x in found))).alias("f"))
    return every.select("doc_id", "chunk_id", "f.pass", F.col("f.at").alias("emit_idx"), "f.type", "f.excerpt", "f.explanation", "f.suggestion", "f.rule_id", "f.confidence")


#: What a closed list, a unit or a number rule can begin with, in Turkish lower case.
_FIRST = {w for w, *_ in LITERALS} | {w.split()[0] for w, *_ in PHRASES} | set(NUMBERS.split())
_UNITS = {w for w, _ in UNITS}
_TO_LOWER = str.maketrans("Iİ", "ıi")


def _notable(text: str) -> Iterator[tuple[int, str]]:
    last, before, end, follows, leads = "", 0, -2, False, False
    for m in _WORD.finditer(text):
        word, start = m.group(), m.start()
        near = start == end + 1
        twice = near and word == last
        if twice and not follows:
            yield before, last
        first = word in _UNITS or (word if word.islower() and word.isascii() else word.translate(_TO_LOWER).lower()) in _FIRST
        own = first or twice or (near and leads)
        if own:
            yield start, word
        last, before, end, follows, leads = word, start, m.end(), own, first


def _all_notable(texts: pa.Array) -> pa.Array:
    """The words that some rule may name, and those after them: neighbours, for the rules, are one character apart, so what lies between the rest is not missed."""
    return token_array(texts, _notable)


notable = F.arrow_udf(_all_notable, TOKENS).asNondeterministic()  # found once, as with tokens()


def _words(rows: DataFrame) -> DataFrame:
    """Chunks whose ``words`` are those that the rules look at."""
    return rows.withColumn("words", notable(F.col("text")))


class RuleJudge:
    """A judge that needs no model: the rules that a text alone decides. All JVM-side, but for the words' places.

    Every judge has these: ``local``, ``decisions`` and ``observations`` of chunks with their dictionary candidates,
    ``tone`` of chunks, ``terms`` of chunks, ``consistency`` of whole texts and ``reduce`` of indexes of terms.
    matchers: names of ``MATCHERS``; all if none are given.
    """

    def __init__(self, matchers: tuple[str, ...] = ()):
        self.matchers = matchers or tuple(MATCHERS)

    def _local(self) -> list[Column]:
        return [MATCHERS[m](F.col("text"), F.col("words")) for m in self.matchers]

    def _tone(self) -> list[Column]:
        return [as_tone(repeated_words(F.col("words")))] if "repeated_words" in self.matchers else [F.array()]

    def local(self, rows: DataFrame) -> DataFrame:
        """Findings (doc_id, chunk_id, pass, emit_idx, type, ..., confidence)."""
        return _rows(_words(rows), *self._local())

    def tone(self, rows: DataFrame) -> DataFrame:
        return _rows(_words(rows), *self._tone())

    def both(self, rows: DataFrame) -> DataFrame:
        """Findings of the local and the tone pass, from one look at the chunks."""
        return _rows(_words(rows), *self._local(), *self._tone())

    def decisions(self, rows: DataFrame) -> DataFrame:
        """(doc_id, chunk_id, idx, word, is_error, correction) of the candidates: an abbreviation is no error, a closed list has corrections."""
        each = rows.select("doc_id", "chunk_id", F.posexplode("candidates").alias("idx", "word"))
        fix = F.split_part(F.try_element_at(_table(LITERALS), t.tr_lower("word")), F.lit("\t"), F.lit(1))
        return each.select("doc_id", "chunk_id", "idx", "word", (fix.isNotNull() | (F.col("word") != F.upper("word"))).alias("is_error"), F.coalesce(fix, F.lit("")).alias("correction"))

    def observations(self, rows: DataFrame) -> DataFrame:
        """(doc_id, chunk_id, excerpt, note) of what no rule names."""
        return rows.select("doc_id", "chunk_id", F.explode(F.regexp_extract_all("text", F.lit(NOISE), F.lit(1))).alias("excerpt")).withColumn("note", F.lit("Art arda noktalama işareti."))

    def terms(self, rows: DataFrame) -> DataFrame:
        """(doc_id, surface, concept) of each occurrence."""
        every = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(1))).alias("surface"))
        return every.where(F.col("surface").rlike(r"^\p{Lu}")).withColumn("concept", F.lit(""))

    def consistency(self, texts: DataFrame) -> DataFrame:
        """Findings (doc_id, pass, emit_idx, ...) of whole texts: what ``reduce`` says of the text's own index."""
        return self.reduce(terms.index_text(terms.inventory(self.terms(texts))))

    def reduce(self, indexes: DataFrame) -> DataFrame:
        """Findings from (doc_id, index): of a cluster's forms the most frequent is preferred, the first of equal ones."""
        clusters = indexes.select("doc_id", F.posexplode(F.split("index", r"(^|\n)Küme ")).alias("no", "body"))
        forms = F.transform(F.regexp_extract_all("body", F.lit(r"  - («.*» \([0-9]+) kez\)"), F.lit(1)), lambda x: F.struct((-F.substring_index(x, "(", -1).cast("long")).alias("n"), F.regexp_replace(F.substring(x, 2, 1 << 30), r"» \([0-9]+\z", "").alias("form")))
        each = clusters.select("doc_id", F.array_sort(forms).alias("forms")).where("size(forms) > 1")
        rows = each.select("doc_id", F.get("forms", F.lit(0))["form"].alias("suggestion"), F.explode(F.slice("forms", F.lit(2), F.size("forms"))).alias("f")).select("doc_id", "suggestion", F.col("f.form").alias("excerpt"))
        return rows.select("doc_id", F.lit("consistency").alias("pass"), F.lit(0).alias("emit_idx"), F.lit("tutarlilik").alias("type"), "excerpt", F.lit("Aynı terimin başka yazılışı belgede daha sık.").alias("explanation"), "suggestion", F.lit("TUTARLILIK-TERIM").alias("rule_id"), F.lit(0.7).alias("confidence"))


def judge(chunks: DataFrame, *matchers: str) -> DataFrame:
    """Local and tone findings of the rules that need no context, or of some of ``MATCHERS`` alone."""
    return RuleJudge(matchers).both(chunks)
