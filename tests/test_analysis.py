"""The whole analysis with a dictionary, judges, consistency, evaluation and the command line."""

import io
import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from doclens import cli, storage
from doclens.functions import text as t
from doclens.operators import blocks, chunks, findings, lexicon, locate, prompts, rules
from doclens.plans import evaluate, pipeline, queries
from doclens.settings import Settings
from doclens.sources import history, readers
from doclens.streaming import documents

SF = "/root/testdata/sf0.001"


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brief(df, *more):
    return sorted((r["doc_id"], r["type"], r["excerpt"], r["suggestion"], *(r[m] for m in more)) for r in df.collect())


def test_dictionary_decisions_and_merge(spark):
    words = spark.createDataFrame([(w,) for w in "bu kitap masada duruyor ve".split()], "word string")
    docs = docs_of(spark, "Bu kitap herkez masada duruyor.\nTBMM kitap kitapp duruyor ve duruyor.", "Bu kitap masada.")
    got = pipeline.analyze(docs, dictionary=words)
    # the dictionary's finding takes the place of the closed list's; an abbreviation is no error
    assert brief(got, "rule_id") == [(0, "imla", "herkez", "herkes", "HUNSPELL"), (0, "imla", "kitapp", lexicon.NO_SUGGESTION, "HUNSPELL")]
    assert brief(pipeline.analyze(docs), "rule_id") == [(0, "imla", "herkez", "herkes", "IMLA-HERKES")]
    at = {r["excerpt"]: (r["start"], r["end"]) for r in got.collect()}
    text = "Bu kitap herkez masada duruyor.\n\nTBMM kitap kitapp duruyor ve duruyor."
    assert all(text[a:b] == e for e, (a, b) in at.items())


def test_rules_of_patterns(spark):
    docs = docs_of(spark, "Elma, armut, ve üzüm. Her hangi biri 2.'nci oldu. Beş çalışanlar 5 Khz ile yavaş yavaş geldi geldi.")
    assert [x[2:] for x in brief(pipeline.analyze(docs), "rule_id")] == [
        ("Beş çalışanlar", "Beş çalışan", "GRAMER-SAYI-UYUM"),
        ("geldi geldi", "geldi", "GRAMER-TEKRAR"),
        ("2.'nci", "2'nci", "IMLA-SIRA-SAYI"),
        ("Her hangi", "Herhangi", "IMLA-BITISIK"),
        ("Khz", "kHz", "IMLA-BIRIM"),
        ("armut, ve", "armut ve", "IMLA-NOKTALAMA"),
    ]


def test_consistency_by_both_ways(spark):
    long = "E-Posta gelir.\n" + "Uzun bir metin sürer gider.\n" * 40 + "Eposta ve E-Posta aynı."
    docs = docs_of(spark, long, "Tek Terim var.", "Modu burada. modu orada.")
    for most in (0, 16_000):
        got = pipeline.Analyzer(map_reduce_chars=most).documents(docs).findings.where("type = 'tutarlilik'")
        assert brief(got) == [(0, "tutarlilik", "Eposta", "E-Posta")]
    seen = []

    class Counting(rules.RuleJudge):
        def reduce(self, indexes):
            seen.append(indexes.collect())
            return super().reduce(indexes)

        def consistency(self, texts):
            return super().consistency(texts.limit(0))

    pipeline.Analyzer(Counting(), map_reduce_chars=0).documents(docs).findings.collect()
    # no index, and so no reduce call, for documents without clusters
    assert [r["doc_id"] for r in seen[-1]] == [0]
    assert seen[-1][0]["index"] == "Küme 1 (aynı şey olabilir mi?):\n  - «E-Posta» (2 kez) — ?\n  - «Eposta» (1 kez) — ?"


def test_observations_are_apart(spark):
    result = pipeline.Analyzer().documents(docs_of(spark, "Ne oldu?! Geldi!!\nNe oldu?!", "temiz"))
    assert [(r["doc_id"], r["position"], r["excerpt"]) for r in result.observations.orderBy("position").collect()] == [(0, 1, "!!"), (0, 2, "?!")]
    assert result.findings.count() == 0
    result.release()
    assert result.kept and not any(os.path.exists(path.removeprefix("file://").removeprefix("file:")) for path in result.kept)


class Model:
    """Answers by purpose; counts its calls in a folder, as it runs in other processes."""

    def __init__(self, folder, broken=""):
        self.folder, self.broken = str(folder), broken

    def __call__(self, system, user):
        import uuid

        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        if self.broken and self.broken in user:
            raise RuntimeError("quota")
        body = user.split(t.TEXT_OPEN)[-1] if t.TEXT_OPEN in user else user
        if system == prompts.SYSTEM["terms"]:
            return json.dumps({"terms": [{"surface": w, "concept": "ad"} for w in re.findall(r"\bT\w+", body)]})
        out = {"findings": [], "spelling": [], "observations": []}
        one = lambda kind, a, b: {"type": kind, "excerpt": a, "explanation": "", "suggestion": b, "rule_id": "X", "confidence": 0.5}
        if system == prompts.SYSTEM["local"]:
            out["findings"] = [one("dil_bilgisi", "geldi", "gelir"), one("imla", "yok", "var"), one("imla", "aynı", " aynı ")]
            out["spelling"] = [{"word": w, "is_error": w != "Ahmet", "correction": "düzelt" if w == "bozukk" else ""} for w in re.findall(r"\w+", user.split("işaretledi)\n")[1].split("\n")[0])] if "işaretledi)" in user else []
            out["observations"] = [{"excerpt": "Ahmet", "note": "kim?"}]
        elif system == prompts.SYSTEM["tone"]:
            out["findings"] = [one("ton", "geldi", "geldiler")]
        elif system == prompts.SYSTEM["reduce"]:
            out["findings"] = [one("tutarlilik", "Tbir", "Tiki")] if "«Tbir»" in user else []
        else:
            out["findings"] = [one("tutarlilik", "Ahmet", "Mehmet")] if "Ahmet" in body else []
        return json.dumps(out)


def judged(spark, tmp_path, docs, broken="", most=60):
    (tmp_path / "calls").mkdir(exist_ok=True)
    judge = prompts.ModelJudge(spark, "m", Model(tmp_path / "calls", broken), rules.texts_by_purpose(spark), f"{tmp_path}/store")
    words = spark.createDataFrame([(w,) for w in "Ahmet bozukk geldi aynı kaldı Tbir Tiki dolgu sözü".split()[2:]], "word string")
    result = pipeline.Analyzer(judge, words, map_reduce_chars=most).documents(docs)
    return result, lambda: len(list((tmp_path / "calls").iterdir()))


def test_model_judge_and_its_store(spark, tmp_path):
    docs = docs_of(spark, "Ahmet geldi bozukk aynı.", "Tbir kaldı. Tiki kaldı.\n" + "dolgu sözü " * 20)
    result, calls = judged(spark, tmp_path, docs)
    want = [
        (0, "dil_bilgisi", "geldi", "gelir"),
        (0, "imla", "bozukk", "düzelt"),
        (0, "tutarlilik", "Ahmet", "Mehmet"),
        (1, "tutarlilik", "Tbir", "Tiki"),
    ]
    assert brief(result.findings) == want
    assert {(r["doc_id"], r["excerpt"]) for r in result.observations.collect()} == {(0, "Ahmet"), (1, "Ahmet")}
    n = calls()
    assert n == 7  # two local, two tone, one consistency, one of terms and one reduce
    again, _ = judged(spark, tmp_path, docs)
    assert brief(again.findings) == want and calls() == n
    assert result.statuses.count() == 0


def test_a_failed_call_leaves_its_document_without_a_result(spark, tmp_path):
    docs = docs_of(spark, "Ahmet geldi bozukk aynı.", "Ahmet kaldı, geldi.")
    result, calls = judged(spark, tmp_path, docs, broken="kaldı, geldi")
    assert {r["doc_id"] for r in result.findings.collect()} == {0} == {r["doc_id"] for r in result.observations.collect()}
    assert {(r["doc_id"], r["status"], r["error"]) for r in result.statuses.collect()} == {(1, "transient", "quota")}
    # what succeeded is stored, what failed is asked again
    n = calls()
    healed, _ = judged(spark, tmp_path, docs)
    assert {r["doc_id"] for r in healed.findings.collect()} == {0, 1} and calls() == n + 3


def test_evaluation(spark, tmp_path):
    golden = [("imla-1", "Bunu herkez bilir.", [("imla", "herkez")], None), ("imla-2", "Temiz bir cümle.", [], None), ("ton-1", "slm dedi yanlız", [("ton", "slm")], "document"), ("ton-2", "naber", [], None)]
    rows = spark.createDataFrame(golden, readers.GOLDEN)
    done = evaluate.run(rows, pipeline.Analyzer())
    scores = {r["axis"]: (r["tp"], r["fp"], r["fn"]) for r in done.scores.collect()}
    assert scores == {"imla": (1, 1, 0), "ton": (1, 1, 0), "genel": (1, 1, 0)}
    assert tuple(done.false_alarms.first()) == (0, 1)
    row = done.archive(spark, f"{tmp_path}/eval", "rules", "20240101-000000")
    assert row == {"model_id": "rules", "timestamp": "20240101-000000", "partial": False, "processed": 4, "total": 4, "failed": []}
    back = {r["id"]: r for r in spark.read.json(f"{tmp_path}/eval/runs/rules-20240101-000000/predictions").collect()}
    assert back["ton-1"]["predicted"][0]["excerpt"] == "slm" and spark.read.json(f"{tmp_path}/eval/last_predictions").count() == 4
    some = evaluate.run(rows, pipeline.Analyzer(), ["imla"])
    assert some.total == 2 and some.archive(spark, f"{tmp_path}/eval", "rules", "2")["partial"]


def test_evaluation_skips_what_failed(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([("a", "Ahmet geldi.", [("imla", "x")], None), ("b", "kötü geldi.", [("imla", "x")], None)], readers.GOLDEN)
    judge = prompts.ModelJudge(spark, "m", Model(tmp_path / "calls", "kötü"), rules.texts_by_purpose(spark), f"{tmp_path}/store", tries=1)
    done = evaluate.run(rows, pipeline.Analyzer(judge))
    assert [(r["id"], r["error"]) for r in done.failed.collect()] == [("b", "quota")]
    assert [r["id"] for r in done.predictions.collect()] == ["a"]
    row = done.archive(spark, f"{tmp_path}/eval", "m", "1")
    assert row["partial"] and row["processed"] == 1 and row["total"] == 2 and row["failed"] == [{"id": "b", "error": "quota"}]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tests.test_cases import W

    assert cli.main(["Bunu", "herkez", "bilir."]) == 0
    got = json.loads(capsys.readouterr().out)
    assert [f["excerpt"] for f in got["findings"]] == ["herkez"] and got["text_len"] == 18
    monkeypatch.setattr("sys.stdin", io.StringIO(" \n"))
    assert cli.main([]) == 2
    monkeypatch.setattr("sys.stdin", io.StringIO("yanlız kaldı"))
    assert cli.main([]) == 0 and json.loads(capsys.readouterr().out)["findings"][0]["suggestion"] == "yalnız"
    import zipfile

    p = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.DOCX", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('Bunu herkez bilir.')}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('Üst')}</w:hdr>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}><w:footnote>{p('Not')}</w:footnote></w:footnotes>")
    assert cli.main([str(tmp_path / "a.DOCX")]) == 0
    out = capsys.readouterr()
    assert [f["excerpt"] for f in json.loads(out.out)["findings"]] == ["herkez"] and "üst/altbilgi dahil, dipnot dahil" in out.err
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert cli.main([str(tmp_path / "b.docx")]) == 1 and cli.main([str(tmp_path / "none.docx")]) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("herkez geldi")
    assert cli.main(["--folder", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out")).first()["findings"][0]["excerpt"] == "herkez"


def test_files_of_rules_and_words(spark, tmp_path):
    (tmp_path / "d.dic").write_text("3\nkitap/AB\nmasa\n\nç\\/x\tnot\n")
    assert sorted(r["word"] for r in lexicon.read(spark, f"{tmp_path}/d.dic").collect()) == ["kitap", "masa", "ç\\/x"]
    own = rules.texts_by_purpose(spark)
    assert "## A." in own["local"] and "## C." not in own["local"] and "slm" in own["tone"] and "herkez" not in own["tone"]
    (tmp_path / "r.md").write_text("başlıksız")
    assert rules.texts_by_purpose(spark, f"{tmp_path}/r.md") == dict.fromkeys(rules.PURPOSES, "başlıksız")
    made = pipeline.build(spark, Settings(dictionary_path=f"{tmp_path}/d.dic", max_chars=7, map_reduce_chars=9))
    assert made.dictionary.count() == 3 and (made.max_chars, made.map_reduce_chars) == (7, 9)


def test_deleting_from_the_history(spark, tmp_path):
    base = findings.counts(spark.createDataFrame([(i, "imla") for i in range(3)], "doc_id long, type string")).withColumn("text", F.lit("x")).withColumn("result", F.lit("{}"))
    path = f"{tmp_path}/h"
    history.save(history.records(base, "text", "2024-01-01T00:00:00"), path)
    key = history.load(spark, path).first()["id"]
    assert history.delete(spark, path, [key, "none"]) == 1 and history.delete(spark, path, [key]) == 0
    assert history.load(spark, path).count() == 2 and history.get(history.load(spark, path), key).count() == 0


def test_history_keeps_what_is_saved_beside_deletions_and_compaction(spark, tmp_path):
    base = findings.counts(spark.createDataFrame([(i, "imla") for i in range(4)], "doc_id long, type string")).withColumn("text", F.lit("x")).withColumn("result", F.lit("{}"))
    path, rows = f"{tmp_path}/h", history.records(base, "text", "2024-01-01T00:00:00")
    ids = lambda: sorted(r["id"] for r in history.load(spark, path).collect())
    assert ids() == [] and history.delete(spark, path, ["x"]) == 0 and history.compact(spark, path) == 0
    history.save(rows, path)
    every = ids()
    store = history._Folder(spark, path)
    early, reader = store.claim(), history.load(spark, path)  # a writer that is slow to move its run in, and an open reader
    assert history.delete(spark, path, every[:2]) == 2 and ids() == every[2:]
    history.save(history.get(rows, every[0]), path)  # saved again after the deletion
    assert ids() == sorted([every[0], *every[2:]])
    assert history.compact(spark, path) == 3 and ids() == sorted([every[0], *every[2:]]) and len(store.live()) == 1
    late = rows.limit(1).withColumn("id", F.lit("late")).withColumn("seq", F.lit(early).cast("long"))
    store.put(late, "rows", early)
    assert "late" in ids() and reader.count() == 4
    assert history.delete(spark, path, [every[3]]) == 1 and history.compact(spark, path) == 3
    left = ids()
    assert left == sorted([every[0], every[2], "late"])
    store.fs.mkdirs(store._at("_staging/lost"))
    assert history.vacuum(spark, path) == 0 and history.vacuum(spark, path, 0) == 7
    assert ids() == left and [x for x in store.names() if "-" in x] == store.live()


def test_rows_of_one_id_are_texts_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "d\ne\ne\nf"), (1, "d\ne\ne\nf"), (2, None), (3, "\n \n"), (None, "x")], "doc_id long, text string")
    assert sorted(r["text"] for r in blocks.texts(docs).collect()) == ["a\n\nb\n\nc", "d\n\ne\n\nf", "d\n\ne\n\nf", "x"]
    placed = blocks.document_blocks(docs)
    assert [(r["text"], r["pos"], r["start"], r["end"]) for r in placed.where("doc_id = 1").collect()] == [("a", 0, 0, 1), ("b", 1, 3, 4), ("c", 2, 6, 7), *[("d", 0, 0, 1), ("e", 1, 3, 4), ("f", 3, 6, 7)] * 2]
    for df in (placed, blocks.texts(docs), chunks.chunks(blocks.texts(docs))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    long = "\n".join(f"line {i}" for i in range(50_000))
    last = blocks.document_blocks(docs_of(spark, long)).orderBy(F.desc("pos")).first()
    assert blocks.texts(docs_of(spark, long)).first()["text"][last["start"] : last["end"]] == "line 49999"


def plain_paragraphs(text):
    ws = f"[{re.escape(t.SPACES)}]"
    return [m.span(1) for m in re.finditer(rf"(?s)([^{re.escape(t.SPACES)}].*?)(?=\n{ws}*\n|\Z)", text)]


def test_paragraphs_are_the_plain_search(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b.", " ", "\n", "\n\n", "\t", " ", ""]) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = docs_of(spark, *texts).select("text", chunks.paragraph_spans(F.col("text")).alias("p")).collect()
    for r in rows:
        assert [tuple(x) for x in r["p"]] == plain_paragraphs(r["text"])


def test_cleaning_is_in_the_plan_once(spark):
    plan = blocks.from_lines(docs_of(spark, "a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)https?") == 1 and plan.count("media/") <= 3


def test_context_meets_only_longer_suggestions(spark):
    text = "bilginize sunuyoruz. son"
    rows = spark.createDataFrame([(0, "imla", "sunuyoruz", "", "sunuyoruz.", None, None, 10, 19), (0, "ton", "son", "", None, None, None, 21, 24)], "doc_id long, type string, excerpt string, explanation string, suggestion string, rule_id string, confidence double, start int, end int")
    assert [r["excerpt"] for r in findings.drop_context_satisfied(rows, docs_of(spark, text)).collect()] == ["son"]


def test_a_text_is_handed_over_once(spark):
    texts = spark.createDataFrame([(1, 0, "ki ... ki Pil’i")], "doc_id long, chunk_id int, text string")
    rows = spark.createDataFrame([(1, 0, "p", e, i) for i, e in enumerate(["ki", "ki", "Pil'i", "yok", None])], "doc_id long, chunk_id int, pass string, excerpt string, emit_idx int")
    got = {(r["excerpt"], r["emit_idx"]): (r["start"], r["end"]) for r in locate.locate(rows, texts).collect()}
    assert got == {("ki", 0): (0, 2), ("ki", 1): (7, 9), ("Pil'i", 2): (10, 15), ("yok", 3): (None, None), (None, 4): (None, None)}


def test_a_document_of_a_million_characters(spark):
    line = "Bunu herkez bilir bilir ve 12.5 der. Sonra gider, ve gelir. "
    text = "\n".join(f"{line}{i}" if i % 3 else "446.00625" for i in range(25_000))
    assert len(text) > 1_000_000
    began = time.monotonic()
    got = findings.counts(pipeline.analyze(docs_of(spark, text))).first()
    assert got["imla"] > 30_000 and got["tutarlilik"] == 1
    assert time.monotonic() - began < 120


def test_scores_of_the_query_by_brute_force(spark):
    expected, predicted = queries._golden(spark, SF)
    want = {}
    norm = lambda s: " ".join(s.lower().split())
    items = {}
    for side, df in enumerate((expected, predicted)):
        for r in df.orderBy("id", "idx").collect():
            items.setdefault(r["id"], ([], []))[side].append((r["type"], norm(r["excerpt"])))
    for own, said in items.values():
        free = list(said)
        for kind, text in own:
            hit = next((p for p in free if text in p[1] or p[1] in text), None)
            tally = want.setdefault(kind, [0, 0, 0])
            tally[2 if hit is None else 0] += 1
            if hit:
                free.remove(hit)
        for kind, _ in free:
            want.setdefault(kind, [0, 0, 0])[1] += 1
    got = {r["axis"]: [r["tp"], r["fp"], r["fn"]] for r in queries.QUERIES["precision_recall"](spark, SF).collect()}
    assert {k: v for k, v in got.items() if k != "genel"} == want and want


@pytest.mark.parametrize("name", ["covered_chunks", "consistency_routes", "rule_patterns", "rule_literal_map", "affix_lookup"])
def test_no_query_is_empty(spark, name):
    assert not queries.QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty()


def test_analysis_has_all_axes(spark):
    got = queries.QUERIES["axis_counts"](spark, SF).agg(*(F.sum(a).alias(a) for a in ("imla", "dil_bilgisi", "ton", "tutarlilik"))).first()
    assert all(got[a] > 0 for a in ("imla", "dil_bilgisi", "ton", "tutarlilik"))


def test_tables_of_steps_go_when_what_is_made_of_them_stands(spark, tmp_path, monkeypatch):
    """Every step's table stayed until the end, the blocks' twice, and what was shuffled for each until the driver's garbage went."""
    folder, steps = tmp_path / "steps", []
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(folder))
    stored = storage.stored

    def watched(df, name):
        out = stored(df, name)
        steps.append((name, sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir())))
        return out

    monkeypatch.setattr(storage, "stored", watched)
    words = spark.createDataFrame([(w,) for w in ("cümlede", "yanlış")], "word string")
    result = pipeline.Analyzer().blocks(blocks.document_blocks(docs_of(spark, queries.SAMPLE)), lambda own: words)
    assert sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir()) == ["observations", "result"]
    assert [n for n, _ in steps].count("blocks") == 1
    assert dict(steps)["result"] == ["blocks", "chunks", "dictionary", "findings", "result", "texts"]
    assert result.findings.count() > 5 and result.observations.count() > 0
    result.release()
    assert not list(folder.iterdir())


def test_shuffle_files_go_with_their_step(spark, tmp_path):
    """They stayed until the driver happened to collect its garbage."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in local.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = files()
    storage.stored(spark.range(10_000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "few")
    assert files() <= before
    spark.range(10_000).repartition(3, "id").write.format("noop").mode("overwrite").save()
    assert files() - before
