"""Steps that have to stay small however many rows there are."""

import random
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from doclens import storage
from doclens.functions import text as t
from doclens.operators import findings, lexicon, locate, rules, terms
from doclens.plans import queries

SF = "/root/testdata/sf0.001"

TEXTS = ["Yavaş yavaş gitti gitti gitti, ve Orjinal yanlız bir kaç. Üç kullanıcılar 12 Khz red  ettik red ettik.", "bir\nkaç her hangi iki uzunlar üç-dört beş beş altı evlerler", "", None, "aa aa bb aa aa", "IŞIK BİR ÇOK 3.5 8.'inci"]


def test_words_of_many_texts_are_few_python_objects():
    """a batch's words were a dictionary each, about 400 bytes, all at once."""
    texts = pa.array(["kelime başka söz " * 200] * 4000)
    tracemalloc.start()
    found = lexicon.token_array(texts, lexicon._tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4000 and len(found.flatten()) == 4000 * 600
    assert peak < 40 << 20


def test_notable_words_give_the_findings_of_all_words(spark):
    """The rules looked at every word, one after the other."""
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(TEXTS)], "doc_id long, chunk_id int, text string")
    judge = rules.RuleJudge()
    every = rules._rows(rows.withColumn("words", lexicon.tokens(F.col("text"))), *judge._local(), *judge._tone()).collect()
    assert sorted(map(str, rules.judge(rows).collect())) == sorted(map(str, every)) and len(every) > 12
    few = rows.withColumn("words", rules.notable(F.col("text")))
    assert few.where("doc_id = 4").select(F.size("words")).first()[0] == 4


def test_some_matchers_alone(spark):
    """decimals were read from the findings of all rules."""
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(TEXTS)], "doc_id long, chunk_id int, text string")
    every = {str(r) for r in rules.judge(rows).collect()}
    for name in rules.MATCHERS:
        own = {str(r) for r in rules.judge(rows, name).collect()}
        assert own and own <= every


def test_nfc_of_a_batch_with_ascii_and_null(spark):
    rows = spark.createDataFrame([("abc",), (None,), ("e\u0301",), ("\u00e9",)], "x string")
    assert [r[0] for r in rows.select(t.nfc("x")).collect()] == ["abc", None, "\u00e9", "\u00e9"]


FORM = "doc_id long, type string, excerpt string, explanation string, suggestion string, rule_id string, confidence double, start int, end int"


def _spans(n: int, seed: int) -> list[tuple]:
    r, out = random.Random(seed), []
    for _ in range(n):
        start = r.choice([None, *range(40)])
        kind, excerpt = r.choice(["imla", "dil_bilgisi", "ton", "tutarlilik", "x", None]), r.choice(["a b", "a c", "b"])
        out.append((r.randrange(3), kind, excerpt, "n", r.choice(["a b", "a d", "c", "a c"]), r.choice(["GRAMER-TEKRAR", "X", None]), None, start, None if start is None else start + r.randrange(4)))
    return out


def _meet(a: tuple, b: tuple) -> bool:
    return a[0] == b[0] and None not in (a[7], b[7]) and a[7] < b[8] and b[7] < a[8]


def test_overlaps_equal_all_pairs(spark):
    """overlapping spans were joined by cells, and the join's small looking side was broadcast."""
    fixed, judged = _spans(60, 1), _spans(300, 2)
    frame = lambda rows: spark.createDataFrame(rows, FORM)
    made = findings.merge(frame(fixed), frame(judged))
    want = fixed + [j for j in judged if not any(_meet(j, f) for f in fixed)]
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    prio = {"imla": 0, "dil_bilgisi": 1, "ton": 2}
    change = {(e, s): [(x, y) for x, y in zip(e.split(), s.split()) if x != y] if len(e.split()) == len(s.split()) else [] for e in ("a b", "a c", "b") for s in ("a b", "a d", "c", "a c")}

    def weaker(f: tuple, o: tuple) -> bool:
        one, other = change[f[2], f[4]], change[o[2], o[4]]
        return f[1] in prio and o[1] in prio and _meet(f, o) and prio[o[1]] < prio[f[1]] and (f[2] == o[2] or (len(one) == 1 and one == other))

    crossed = findings.cross_pass_dedup(frame(judged))
    want = [f for f in judged if not any(weaker(f, o) for o in judged)]
    assert len(want) < len(judged) and sorted(map(str, map(tuple, crossed.collect()))) == sorted(map(str, want))
    kinds = ["tablo_hucresi", "icindekiler", "baslik", "paragraf"]
    placed = [(f[0], f[7], f[8], kinds[i % 4]) for i, f in enumerate(fixed[:20]) if f[7] is not None]
    left = findings.drop_structural(frame(judged), spark.createDataFrame(placed, "doc_id long, start int, end int, kind string"))

    def dropped(f: tuple) -> bool:
        near = {p[3] for p in placed if _meet(f, (p[0], *[None] * 6, *p[1:3]))}
        return bool(near & set(kinds[:2]) and f[1] not in ("tutarlilik", None)) or ("baslik" in near and f[5] == "GRAMER-TEKRAR")

    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(f) for f in judged if not dropped(f))


def test_findings_on_words_are_not_shuffled(spark):
    """the documents' words are dealt once, before each becomes two findings; no side is broadcast."""
    for name in ("merge_findings", "dedup_sorted", "structural_filter", "resolve_spelling", "term_index", "drop_context_satisfied"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan, name


def test_exact_places_alone(spark):
    """where a text's beginning in lower case is nowhere in it, places that are alike were given."""
    rows = spark.createDataFrame([("\u201cA b 'a \"a",), ("aa aaa",)], "x string").withColumn("y", F.lower(F.substring("x", 1, 2)))
    assert [[tuple(s) for s in r[0]] for r in rows.select(locate.spans_as_they_stand("x", "y")).collect()] == [[], [(0, 2), (3, 5), (4, 6)]]


def test_first_places_equal_all_places(monkeypatch):
    """F8: each excerpt was made a pattern and searched for in the whole text, for all its places."""
    r = random.Random(5)
    for _ in range(300):
        signs = r.choice(["ab \n", "aab  \t\n'’\"”", "xy  \n\r", "abcdefgh \n\n"])
        text = "".join(r.choice(signs) for _ in range(r.randrange(80)))
        lines = [x.strip(" ") for x in text.split("\n")]
        own = [f"{a} {b}" for a, b in zip(lines, lines[1:]) if a and b] + ["".join(r.choice(signs) for _ in range(r.randrange(1, 9)))]
        want = [next(iter(locate._found(text, e)), None) for e in own]
        for most in (1 << 26, 0):
            monkeypatch.setattr(locate, "MOST_LOOKS", most)
            assert locate.first_spans(text, own) == [w and (w["start"], w["end"]) for w in want], (text, own)


def test_first_places_of_a_long_text():
    """F8: text times excerpts was looked at."""
    lines = [f"2024-01-01 {i:06d} some words" for i in range(40_000)]
    began = time.process_time()
    found = locate.first_spans("\n".join(lines), [f"{a} {b}" for a, b in zip(lines, lines[1:])])
    assert [f[0] for f in found[:3]] == [0, 29, 58] and None not in found and time.process_time() - began < 20


def test_words_of_all_bytes_are_each_texts_words(monkeypatch):
    """every word was a Python object."""
    r = random.Random(1)
    for size in (1, 10, 1 << 20):
        monkeypatch.setattr(lexicon, "SLICE_BYTES", size)
        for signs in ("ab c\n", "aé ½٣Ⅷ_9'", "𝒳a😀ıİ ß", "  "):
            texts = pa.array([r.choice([None, "".join(r.choice(signs) for _ in range(r.randrange(12)))]) for _ in range(200)], pa.string())
            for own in (texts, texts.slice(3, 50), texts.slice(0, 0)):
                found = lexicon._all_tokens(own)
                found.validate(full=True)
                assert found.equals(lexicon.token_array(own, lexicon._tokens))
    every = pa.array(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert lexicon._words_of(every).equals(lexicon.token_array(every, lexicon._tokens))


def test_words_are_found_once_and_not_dealt_out(spark):
    """a filter that explode() brings found them twice, and words looked at one by one were shuffled."""
    for name in ("turkish_case", "surface_key", "match_case", "oov_words"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython [_all_tokens") == plan.count("Relation [doc_id"), name
    plan = queries.QUERIES["turkish_case"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" not in plan and "translate(" not in plan


def test_keys_and_case_of_every_character(spark):
    """the faster forms are the plain ones."""
    signs = [chr(i) for i in [*range(0x3100), 0x1F600, 0xFF0D]]
    rows = spark.createDataFrame([(x,) for c in signs for x in (c, f"{c}Aß{c}Σ{c}", f"Iİ {c}ıi")], "c string")
    key = F.regexp_replace(t.casefold(t.strip("c")), t.KEY_NOISE, "")
    low, up = F.lower(F.translate("c", "Iİ", "ıi")), F.upper(F.translate("c", "ıi", "Iİ"))
    assert rows.where(~(key.eqNullSafe(t.surface_key("c")) & low.eqNullSafe(t.tr_lower("c")) & up.eqNullSafe(t.tr_upper("c")))).count() == 0


def test_texts_and_terms_of_consistency_are_made_once(spark, monkeypatch):
    """the documents were cleaned anew for each of some ten steps, and terms gathered three times."""
    made = []
    stored = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stored(df, name))
    rows = queries.consistency_routes(spark, SF)
    assert [n for n, p in made if "documents.parquet" in p or "split(text" in p] == ["texts"]
    judged = [p for n, p in made if n == "judged"]
    assert len(judged) == 2 and not any("regexp_extract_all(text" in p for p in judged)
    assert {r["route"] for r in rows.select("route").distinct().collect()} == {"single", "map_reduce"}


def test_documents_dealt_once_are_not_dealt_again(spark):
    """an Arrow function hid how the findings were dealt, so all of them were shuffled once more."""
    plan = queries.cross_pass_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_normal_form_in_the_jvm(spark):
    """equal to the form by Python, for texts that need no work and for those that do."""
    odd = ["", "abc", "İş–yeri", "é", "ạ́b", "  iki  söz ", "o’ne", "ʼn", "„x“", "a b", "­", "한", "Å", "क़", "x\u0085y", "日本", "ﬁ", "🙂́", None]
    r = random.Random(3)
    marks = [chr(c) for c in (0x41, 0x65, 0x20, 0x300, 0x301, 0x323, 0x327, 0x345, 0x5B0, 0x9C7, 0x9BE, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x2019, 0x1E0B)]
    odd += ["".join(r.choices(marks, k=r.randint(1, 7))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").withColumns({"here": t.norm_here("x"), "python": t.norm("x")})
    assert rows.where("not here <=> python").collect() == [] and rows.where("here <> x").count() > 1000


def test_one_changed_word_without_arrays(spark):
    """two single words are told apart without arrays; what stands behind a word is no change."""
    pairs = [("a", "b"), ("a", "a."), ("a.", "a"), ("", ""), ("", "b"), ("a b", "a c"), ("a b", "c d"), ("a", "a b"), ("a b.", "a b"), (None, "a"), ("a", None), ("a b", None), ("a! b", "x b?")]
    got = [r["c"] and tuple(r["c"]) for r in spark.createDataFrame(pairs, "x string, y string").select(t.atomic(F.col("x"), F.col("y")).alias("c")).collect()]
    assert got == [("a", "b"), None, None, None, ("", "b"), ("b", "c"), None, None, None, None, None, None, ("a", "x")]


def test_clusters_and_their_lines_from_one_look_at_the_terms(spark):
    """the terms were made three times over, and the clusters once more for their headings."""
    r = random.Random(7)
    entries = [(r.randint(0, 3), r.choice("'\"  ") + r.choice(["e-posta", "E-Posta", "eposta", "Sunucu", "sunucu", "makine", "Makine", "servis"]) + r.choice(["", "'", "-"]), r.choice(["ağ", "Ağ", " ağ  x", "", "mail", "m", None])) for _ in range(400)]
    made = spark.createDataFrame(entries, "doc_id long, surface string, concept string")
    inventory = terms.inventory(made)
    both = terms.surface_clusters(inventory).unionByName(terms.concept_clusters(inventory)).distinct().collect()
    want = sorted((x["doc_id"], x["members"]) for x in both if len({m.lower() for m in x["members"]}) > 1)
    assert sorted((x["doc_id"], x["members"]) for x in terms.candidate_clusters(inventory).collect()) == want and len(want) > 8
    of = {(x["doc_id"], x["surface"]): x for x in inventory.collect()}
    lines = []
    for doc in sorted({d for d, _ in want}):
        for i, members in enumerate((m for d, m in want if d == doc), 1):
            lines.append((doc, i, 0, f"Küme {i} (aynı şey olabilir mi?):"))
            for j, m in enumerate(members, 1):
                short = min(of[doc, m]["concepts"], key=lambda c: (len(c), c), default="?")
                lines.append((doc, i, j, f"  - «{m}» ({of[doc, m]['n']} kez) — {short}"))
    assert sorted(tuple(x) for x in terms.index(inventory).collect()) == lines
    assert terms.index(inventory)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
