"""Literal cases of every transform."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from doclens.functions import text as t
from doclens.operators import blocks, chunks, findings, lexicon, locate, prompts, rules, scoring, terms
from doclens.plans import pipeline
from doclens.settings import Settings
from doclens.sources import history, readers
from doclens.streaming import documents

FINDING = "doc_id long, type string, excerpt string, explanation string, suggestion string, rule_id string, confidence double, start int, end int"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def chunk_rows(spark, text, n):
    rows = chunks.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), n).orderBy("chunk_id").collect()
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows)
    return [(r["text"], r["start"]) for r in rows]


def found(spark, rows):
    return spark.createDataFrame([(1, k, e, "", s, r, None, a, b) for k, e, s, r, a, b in rows], FINDING)


def kept(df):
    return sorted((r["type"], r["excerpt"], r["suggestion"], r["start"]) for r in df.collect())


def test_chunks(spark):
    assert chunk_rows(spark, "aaaa\n\nbbbb\n\ncccc", 5) == [("aaaa", 0), ("bbbb", 6), ("cccc", 12)]
    assert chunk_rows(spark, "aaaa\n\nbbbb\n\ncccc", 10) == [("aaaa\n\nbbbb", 0), ("cccc", 12)]
    assert chunk_rows(spark, "x" * 50, 10) == [("x" * 50, 0)]
    assert chunk_rows(spark, "", 5) == chunk_rows(spark, "   \n\n  ", 5) == []
    with pytest.raises(ValueError):
        chunk_rows(spark, "a", 0)
    text = "Prof. Dr. Ahmet Bey saat 15.30'da 2. kez geldi. Sonra hemen çıktı."
    assert chunk_rows(spark, text, 40)[0][0].strip().endswith("geldi.")
    assert chunk_rows(spark, "tail\n", 50) == [("tail\n", 0)]


def test_cleaning(spark):
    clean = lambda s: one(spark, t.clean_paragraph("s"), s=s)
    assert clean('Ziyaret edin: <a href="http://x.y">http://x.y</a> adresini.') == "Ziyaret edin: [bağlantı] adresini."
    assert clean("Metin ----media/image3.png---- ortasında işaretçi.") == "Metin [görsel] ortasında işaretçi."
    assert clean("----media/a.png--------media/b.png----Metin") == "[görsel] Metin"
    assert clean("  ----media/image1.png---- ") == ""
    assert clean(" a  \t b ") == "a b"


def test_classes(spark):
    kind = lambda s, **k: one(spark, t.classify("s", *(F.lit(v) for v in k.values())), s=s)
    assert [kind(s) for s in ("446.00625", "67.0 Hz", "5. adım burada anlatılır.")] == ["tablo_hucresi", "tablo_hucresi", "paragraf"]
    assert kind("Güvenlik Bilgileri\t6") == kind("aksesuar)\t15") == "icindekiler"
    assert kind("BAŞLARKEN") == "baslik" and kind("x", a=True) == "tablo_hucresi" and kind("x", a=False, b="Heading 1") == "baslik"


def test_blocks(spark):
    docs = spark.createDataFrame([(1, "BAŞLARKEN\nBAŞLARKEN\nGerçek metin.\nBAŞLARKEN"), (2, ""), (3, None)], "doc_id long, text string")
    placed = blocks.document_blocks(docs)
    assert [(r["text"], r["start"], r["end"]) for r in placed.orderBy("pos").collect()] == [("BAŞLARKEN", 0, 9), ("Gerçek metin.", 11, 24), ("BAŞLARKEN", 26, 35)]
    assert blocks.assemble(placed).first()["text"] == "BAŞLARKEN\n\nGerçek metin.\n\nBAŞLARKEN"
    r = blocks.report(placed).first()
    assert r["summary"] == "Belge okundu: 3 metin bloğu, 0 tablo, 0 görsel." and r["warning"] is None


def test_turkish_case(spark):
    assert one(spark, t.tr_lower("s"), s="FREKANSINA DİĞER") == "frekansına diğer"
    assert one(spark, t.tr_capitalize("s"), s="istanbul") == "İstanbul"
    case = lambda a, b: one(spark, t.match_case("a", "b"), a=a, b=b)
    assert [case("SEÇENEKLERI", "seçenekleri"), case("Herşey", "her şey"), case("herşey", "her şey"), case("", "x")] == ["SEÇENEKLERİ", "Her şey", "her şey", "x"]


def test_noop_and_corrupt(spark):
    noop = lambda a, b: one(spark, t.is_noop("a", "b"), a=a, b=b)
    assert noop("Ben  de", " Ben de ") and noop("ALKALINE'den", "ALKALINE’den") and noop("resmî", "resmî") and not noop("yalnız mı", "yalnız mı?")
    bad = lambda a, b: one(spark, t.is_corrupt("a", "b"), a=a, b=b)
    assert bad("bir çok", "birchoq") and bad("Modu'na", "Modu`na") and not bad("Linux'da", "Linux'ta")


def test_locate(spark):
    assert locate.exact_spans("aaa", "aa") == [(0, 2), (1, 3)]
    assert locate.loose_spans("Ben de\ngeldim buraya.", "Ben de geldim") == [(0, 13)]
    assert locate.loose_spans("Pil’i tak", "Pil'i") == [(0, 5)]
    texts = spark.createDataFrame([(1, 0, "ki ... ki")], "doc_id long, chunk_id int, text string")
    rows = spark.createDataFrame([(1, 0, "p", "ki", i) for i in range(3)] + [(1, 0, "q", "ki", 9), (1, 0, "p", "yok", 4)], "doc_id long, chunk_id int, pass string, excerpt string, emit_idx int")
    got = {(r["pass"], r["emit_idx"]): (r["start"], r["end"]) for r in locate.locate(rows, texts).collect()}
    assert got == {("p", 0): (0, 2), ("p", 1): (7, 9), ("p", 2): (None, None), ("q", 9): (0, 2), ("p", 4): (None, None)}


def test_context_and_merge(spark):
    texts = spark.createDataFrame([(1, "bilginize sunuyoruz. son")], "doc_id long, text string")
    rows = found(spark, [("imla", "sunuyoruz", "sunuyoruz.", None, 10, 19), ("imla", "son", "son.", None, 21, 24), ("ton", "x", "y", None, None, None)])
    assert [r[1] for r in kept(findings.drop_context_satisfied(rows, texts))] == ["son", "x"]
    fixed, judged = found(spark, [("imla", "a", "b", None, 10, 16)]), found(spark, [("ton", "a b", "c", None, 10, 20), ("ton", "z", "c", None, None, None), ("ton", "w", "c", None, 16, 20)])
    assert [r[1] for r in kept(findings.merge(fixed, judged))] == ["a", "w", "z"]


def test_cross_pass(spark):
    a, b = ("dil_bilgisi", "zamanı aşınır", "x y z", None, 0, 13), ("ton", "zamanı aşınır", "q", None, 0, 13)
    for rows in ([a, b], [b, a]):
        assert [r[0] for r in kept(findings.cross_pass_dedup(found(spark, rows)))] == ["dil_bilgisi"]
    rows = [("dil_bilgisi", "raporu sundular.", "raporu sunuldu.", None, 100, 140), ("ton", "sundular", "sunuldu", None, 130, 138)]
    assert [r[0] for r in kept(findings.cross_pass_dedup(found(spark, rows)))] == ["dil_bilgisi"]
    rows = [("imla", "a", "b", None, 0, 3), ("tutarlilik", "a", "b", None, 0, 3)]
    assert len(kept(findings.cross_pass_dedup(found(spark, rows)))) == 2


def test_corrupt_finding_wins_before_it_goes(spark):
    texts = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    rows = found(spark, [("imla", "abc", "abq", None, 0, 3), ("ton", "abc", "xyz", None, 0, 3)])
    assert findings.finalize(rows, texts).count() == 0


def test_spelling_decisions(spark):
    rows = spark.createDataFrame([(1, w, "?", i) for i, w in enumerate(["Herşey", "herşey", "SEÇENEKLERI", "Ahmet", "kalan"])], "doc_id long, excerpt string, suggestion string, start int")
    said = [(1, 0, "Herşey", True, "Her şey"), (1, 1, "herşey", True, "her şey"), (1, 2, "seçenekleri", True, "seçenekleri"), (1, 3, "Ahmet", False, "")]
    got = findings.resolve_spelling(rows, spark.createDataFrame(said, "doc_id long, idx int, word string, is_error boolean, correction string"))
    assert {r["excerpt"]: r["suggestion"] for r in got.collect()} == {"Herşey": "Her şey", "herşey": "her şey", "SEÇENEKLERI": "SEÇENEKLERİ", "kalan": "?"}


def test_terms(spark):
    def clusters(entries):
        rows = spark.createDataFrame([(1, s, c) for s, c in entries], "doc_id long, surface string, concept string")
        return sorted("|".join(r["members"]) for r in terms.candidate_clusters(terms.inventory(rows)).collect())

    assert clusters([("0", "x"), ("%5", "x"), ("Pil", "a")]) == []
    assert clusters([("'Programlama Modu'", "a"), ("Programlama Modu", "b")]) == ["'Programlama Modu'|Programlama Modu"]
    assert clusters([("standart pil", "a"), ("Standart Pil", "b")]) == []
    assert clusters([(f"Ad{i}", "özellik adı") for i in range(6)]) == []
    assert clusters([("PTT", "posta idaresi"), ("BK", "Posta  idaresi")]) == ["BK|PTT"]
    rows = spark.createDataFrame([(1, "PTT", "posta"), (1, "BK", "posta"), (1, "BK", "")], "doc_id long, surface string, concept string")
    assert terms.index_text(terms.inventory(rows)).first()["index"] == "Küme 1 (aynı şey olabilir mi?):\n  - «BK» (2 kez) — posta\n  - «PTT» (1 kez) — posta"


def test_structure(spark):
    docs = spark.createDataFrame([(1, "Metin metni burada 1.5 var.\n446.00625\n467.25\n470.5"), (2, "446.00625\nMetin burada durur."), (3, "ABC ABC\nSon son cümle.")], "doc_id long, text string")
    got = pipeline.analyze(docs).collect()
    summary = [r for r in got if r["type"] == "tutarlilik"]
    assert [(r["doc_id"], r["suggestion"]) for r in summary] == [(1, "446,00625")] and "3 yerde" in summary[0]["explanation"]
    assert [(r["excerpt"]) for r in got if r["doc_id"] == 1 and r["type"] == "imla"] == ["1.5"]
    assert not [r for r in got if r["doc_id"] == 3]


def test_pipeline_ignores_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(pipeline.analyze(docs.coalesce(1)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert key(pipeline.analyze(docs.orderBy(F.rand(n)).repartition(5))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_lexicon(spark):
    placed = blocks.document_blocks(spark.createDataFrame([(1, "İSTANBUL kitap xyzt ab5cdef")], "doc_id long, text string"))
    known = spark.createDataFrame([("İstanbul",), ("kitap",), (None,)], "word string")
    got = lexicon.unknown(lexicon.words(placed), known, ["XYZT"]).collect()
    assert [(r["word"], r["start"]) for r in got] == [("cdef", 23)]
    assert lexicon.findings(lexicon.unknown(lexicon.words(placed), known)).where("rule_id = 'HUNSPELL'").count() == 2


def test_rules(spark):
    frame = spark.createDataFrame([("a", "önsöz\n## A. İmla\nx\n## B. Dil\ny\n## C. Ton\nz\n## Sınırlar\nw\n"), ("b", "başlıksız")], "rule_set string, text string")
    text = lambda p: {r["rule_set"]: r["text"] for r in rules.slice_for(frame, p).collect()}
    assert text("local")["a"] == "önsöz\n## A. İmla\nx\n## B. Dil\ny\n" and text("tone")["a"] == "önsöz\n## C. Ton\nz\n" and text("?") == text("all")
    assert text("tone")["b"] == "başlıksız"


def test_judging(spark):
    asked = spark.createDataFrame([("k1", "s", "ok"), ("k2", "s", "gone"), ("k3", "s", "none"), ("k4", "s", "flaky")], "key string, system string, user string").coalesce(1)

    def call(system, user, seen={}):  # noqa: B006
        seen[user] = seen.get(user, 0) + 1
        if user == "gone":
            raise RuntimeError(f"model is not found ({seen[user]})")
        if user == "flaky" and seen[user] < 3:
            raise RuntimeError("timeout")
        return None if user == "none" else '{"findings":[{"type":"imla","excerpt":"a","explanation":"","suggestion":"b","confidence":0.5}],"spelling":[],"observations":[]}'

    got = {r["key"]: r for r in prompts.ask(asked, call).collect()}
    assert [got[k]["status"] for k in ("k1", "k2", "k3", "k4")] == ["ok", "permanent", "transient", "ok"] and got["k2"]["error"].endswith("(1)")
    parsed = prompts.parse(spark.createDataFrame([(got["k1"]["response"],), ('{"findings":[{"confidence":1.5}]}',)], "response string")).collect()
    assert parsed[0]["answer"]["findings"][0]["suggestion"] == "b" and parsed[1]["answer"] is None
    rows = found(spark, [("imla", "a", "b", None, 0, 1)])
    assert prompts.whole_documents(rows, spark.createDataFrame([(1, "transient")], "doc_id long, status string")).count() == 0
    keyed = prompts.keyed(asked.drop("key"), "m")
    have = keyed.where("user = 'ok'").select("key", F.lit("{}").alias("response"))
    assert prompts.misses(keyed, have).count() == 3 and prompts.hits(keyed, have).count() == 1


def test_scores(spark):
    expected = spark.createDataFrame([("1", 0, "imla", "Sende"), ("1", 1, "ton", "Slm"), ("2", 0, "imla", "yok")], "id string, idx int, type string, excerpt string")
    predicted = spark.createDataFrame([("1", 0, "ton", "sende  mi"), ("1", 1, "ton", "sende"), ("3", 0, "ton", "x")], "id string, idx int, type string, excerpt string")
    got = {(r["id"], r["axis"]): (r["tp"], r["fp"], r["fn"]) for r in scoring.greedy_match(expected, predicted).collect()}
    assert got == {("1", "imla"): (1, 0, 0), ("1", "ton"): (0, 1, 1), ("2", "imla"): (0, 0, 1), ("3", "ton"): (0, 1, 0)}
    total = {r["axis"]: r for r in scoring.totals(scoring.greedy_match(expected, predicted)).collect()}
    assert total["genel"]["recall"] == 0.5 and total["ton"]["precision"] == 0.0


def test_history_and_titles(spark, tmp_path):
    title = lambda s: one(spark, t.make_title("s"), s=s)
    assert title("\n  Merhaba dünya  \nikinci") == "Merhaba dünya" and title(" \n") == "(boş)"
    assert len(title("x" * 100)) == 60 and title("x" * 100).endswith("…")
    counts = findings.counts(found(spark, [("imla", "a", "b", None, 0, 1)] * 2 + [("ton", "a", "b", None, 0, 1), ("diğer", "a", "b", None, 0, 1)]))
    r = counts.first()
    assert (r["toplam"], r["imla"], r["ton"], r["tutarlilik"]) == (4, 2, 1, 0)
    base = counts.withColumn("text", F.lit("başlık")).withColumn("result", F.lit("{}"))
    for at in ("2024-01-01T00:00:00", "2024-01-02T00:00:00"):
        history.save(history.records(base, "text", at), f"{tmp_path}/h")
    stored = history.load(spark, f"{tmp_path}/h")
    listed = history.listing(stored).collect()
    assert [r["created_at"][8:10] for r in listed] == ["02", "01"] and "source" not in listed[0].asDict()
    assert history.get(stored, listed[0]["id"]).count() == history.without(stored, [listed[0]["id"]]).count() == 1


def test_sse_and_settings(spark):
    assert one(spark, t.sse(F.lit("e"), F.col("s")), s="a\nb") == "event: e\ndata: a\ndata: b\n\n"
    frames = documents.events(spark.createDataFrame([("chunk", "x", 1, 2)], "stage string, message string, current int, total int")).first()["frame"]
    assert frames == 'event: progress\ndata: {"stage":"chunk","message":"x","current":1,"total":2}\n\n'
    spark.conf.set("spark.doclens.concurrency", "x")
    spark.conf.set("spark.doclens.timeoutSec", "0")
    got = Settings.of(spark)
    assert got.concurrency == 6 and got.timeout_s is None and got.map_reduce_chars == 16_000


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "son son cümle burada."), (2, "temiz")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # nothing is read twice
        documents.watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, got.drop("batch").collect())) == sorted(map(str, pipeline.analyze(docs).collect()))


def test_golden_and_responses(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id":"imla-1","text":"a","expected":[{"type":"imla","excerpt":"a"}]}\n\n{"id":"ton-1","text":"b","expected":[]}\n')
    rows = readers.golden(spark, f"{tmp_path}/g.jsonl")
    assert rows.count() == 2 and [r["id"] for r in scoring.by_prefix(rows, ["ton"]).collect()] == ["ton-1"] and scoring.by_prefix(rows, [""]).count() == 2
    assert readers.responses(spark, f"{tmp_path}/none").count() == 0
    history.store_responses(spark.createDataFrame([("k", "{}", "ok"), ("l", None, "transient")], "key string, response string, status string"), f"{tmp_path}/r")
    assert [r["key"] for r in readers.responses(spark, f"{tmp_path}/r").collect()] == ["k"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = lambda s, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{s}</w:t></w:r></w:p>'


def test_docx(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        table = f"<w:tbl><w:tr><w:tc>{P('hücre')}</w:tc><w:tc>{P('iki')}</w:tc></w:tr></w:tbl>"
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{P('Bölüm', 'Heading1')}{P('Metin.')}{P('Metin.')}{table}{P('')}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{P('Üst')}</w:hdr>")
        z.writestr("word/header2.xml", f"<w:hdr {W}>{P('Üst')}</w:hdr>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}><w:footnote>{P('Not')}</w:footnote></w:footnotes>")
        z.writestr("word/media/a.png", b"")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    sections = readers.docx(spark, str(tmp_path))
    assert sections.where("error is not null").count() == 1 and sections.agg(F.max("images")).first()[0] == 1
    got = readers.docx_blocks(sections).orderBy("pos").collect()
    assert [(r["text"], r["kind"]) for r in got] == [("Bölüm", "baslik"), ("Metin.", "paragraf"), ("hücre", "tablo_hucresi"), ("iki", "tablo_hucresi"), ("Üst", "paragraf"), ("Not", "paragraf")]
    assert blocks.count_tables(sections.where("part = 0 and error is null")).first()["tables"] == 1
    text = "\n\n".join(r["text"] for r in got)
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got)


def test_prompt_messages(spark):
    got = one(spark, prompts.local_message(F.lit("R"), F.col("s"), F.array(F.lit("b"), F.lit("a"), F.lit("b"))), s="metin")
    assert "b, a\n" in got and got.endswith(f"{t.TEXT_OPEN}\nmetin\n{t.TEXT_CLOSE}")
    assert json.loads(one(spark, F.to_json(F.struct("s")), s="x")) == {"s": "x"}
