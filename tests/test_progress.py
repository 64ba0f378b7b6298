"""Events of running analyses, in order and with the rows that were written."""

import json

from doclens import cli
from doclens.operators import blocks, prompts, rules
from doclens.plans import pipeline
from doclens.plans.progress import Event, Reporter, on_standard_error
from doclens.streaming import documents


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_stages_in_order_with_observed_rows(spark):
    seen = []
    docs = docs_of(spark, "Bu yanlız bir deneme deneme.", "446.1\n447.2", "Dolgu metni burada durur.\n" * 2 + "Herkez geldi.")
    result = pipeline.Analyzer(progress=seen.append).documents(docs)
    assert [e.stage for e in seen] == ["chunk", "chunk_start", "chunk_done", "consistency_start", "consistency_done", "finalize", "done"]
    n = result.findings.count()
    assert seen[0] == Event("chunk", "Belgeler 3 bölüme ayrıldı", 0, 3)
    assert (seen[2].current, seen[2].total) == (2, 3) and "1 bölüm tablo" in seen[2].message
    assert (seen[-1].current, seen[-1].total) == (n, n) and n > 0 and all(e.message for e in seen)
    result.release()


def test_map_and_reduce_tells_its_second_step(spark):
    seen = []
    pipeline.Analyzer(map_reduce_chars=0, progress=seen.append).documents(docs_of(spark, "E-Posta ile Eposta aynı. Eposta yine.")).release()
    assert [e.stage for e in seen] == ["chunk", "chunk_start", "chunk_done", "consistency_start", "consistency_start", "consistency_done", "finalize", "done"]


def test_texts_taken_whole_and_no_documents(spark):
    seen = []
    pipeline.Analyzer(progress=seen.append).texts(docs_of(spark, "Bir cümle.")).release()
    assert seen[0].total == 1 and seen[-1].stage == "done"
    seen.clear()
    pipeline.Analyzer(progress=seen.append).documents(docs_of(spark, "x").where("doc_id < 0")).release()
    assert [(e.stage, e.total) for e in seen if e.stage in ("chunk", "done")] == [("chunk", 0), ("done", 0)]


def test_same_findings_with_and_without_a_receiver(spark):
    docs = docs_of(spark, "Bu yanlız bir deneme deneme.", "Herkez 8.'inci katta, ve orda.")
    one, two = pipeline.Analyzer().documents(docs), pipeline.Analyzer(progress=lambda e: None).documents(docs)
    assert sorted(map(tuple, one.findings.collect()), key=str) == sorted(map(tuple, two.findings.collect()), key=str)
    assert not Reporter().wanted and Reporter().watched(docs, "x") is docs


def test_a_model_judge_reports_too(spark, tmp_path):
    seen = []
    judge = prompts.ModelJudge(spark, "m", lambda s, u: json.dumps({"findings": [], "spelling": [], "observations": []}), rules.texts_by_purpose(spark), str(tmp_path / "store"))
    pipeline.Analyzer(judge, progress=seen.append).documents(docs_of(spark, "Bir cümle.")).release()
    assert seen[0].stage == "chunk" and seen[-1] == Event("done", "Analiz tamamlandı: 0 bulgu", 0, 0)


def test_lines_on_standard_error(capsys):
    for stage in ("chunk", "chunk_start", "chunk_done"):
        on_standard_error(Event(stage, f"about {stage}"))
    assert capsys.readouterr().err == "  … about chunk\n  … about chunk_done\n"


def test_command_line_tells_its_progress(spark, capsys):
    assert cli.main(["Bu", "yanlız", "bir", "deneme."]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)["findings"] and "Belgeler 1 bölüme ayrıldı" in said.err and "Analiz tamamlandı" in said.err


def test_stream_reports_batches(spark, tmp_path):
    seen = []
    docs_of(spark, "Bu yanlız.", "Herkez geldi.").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = documents.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), seen.append)
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    own = [e for e in seen if e.stage == "batch"]
    assert [(e.current, e.total) for e in own] == [(0, 2)] and seen[0].stage == "chunk" and "done" in [e.stage for e in seen]


def test_frames(spark):
    rows = spark.createDataFrame([("chunk", "x", 1, 2)], "stage string, message string, current int, total int")
    assert documents.events(rows).first()["frame"].startswith("event: progress\ndata: {")
    assert blocks is not None
