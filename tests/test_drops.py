"""Files dropped into a folder: what is analysed, what is refused, and batches that are repeated."""

import io
import zipfile

import pytest

from doclens.plans import pipeline
from doclens.sources import readers
from doclens.streaming import drops

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(*paragraphs, header=None):
    ps = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{ps}</w:body></w:document>')
        if header:
            z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{W}"><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>')
    return data.getvalue()


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.txt").write_text("Bu yanlız bir deneme deneme.", encoding="utf-8")
    (at / "b.docx").write_bytes(docx_bytes("Herkez geldi.", "Düz bir cümle.", header="Üst yazı"))
    (at / "c.txt").write_bytes("Kırık ".encode() + b"\xff\xfe" + " bayt herkez.".encode())
    (at / "empty.txt").write_bytes(b"")
    (at / "blank.txt").write_bytes(b" \n ")
    (at / "large.txt").write_bytes(b"x" * 5000)
    (at / "broken.docx").write_bytes(b"no zip")
    (at / "other.docx").write_bytes(b"PK\x05\x06" + b"\0" * 18)  # an archive of nothing
    return at


def name(path):
    return path.rsplit("/", 1)[-1]


def test_what_is_refused(spark, folder):
    parsed = drops.read(spark, str(folder), most=4000)
    got = {name(r["path"]): r["error"] for r in drops.refused(parsed).collect()}
    assert set(got) == {"large.txt", "broken.docx", "other.docx"}  # a file without a byte is on no list
    assert got["large.txt"] == "more than 4000 bytes" and got["other.docx"] == "no word/document.xml inside"
    texts = {name(r["doc_id"]): r["text"] for r in parsed.where("kind = 'text' and error is null").collect()}
    assert texts == {"a.txt": "Bu yanlız bir deneme deneme.", "c.txt": "Kırık �� bayt herkez.", "blank.txt": " \n "}


def test_bound_is_in_the_scan(spark, folder):
    plan = drops.sized(spark.read.format("binaryFile").load(str(folder)), 4000)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 2 and "LessThanOrEqual(length,4000)" in scans[0] and "content" not in scans[1].split("Batched")[0]


def test_a_small_archive_that_unpacks_to_too_much(monkeypatch):
    monkeypatch.setattr(readers, "MOST_UNPACKED", 1000)
    assert readers.docx_rows("x", docx_bytes("a" * 2000))[0][5] == "unpacks to more than 1000 bytes"
    assert all(r[5] is None for r in readers.docx_rows("x", docx_bytes("a")))
    cut = docx_bytes("some words " * 50)
    assert len(readers.docx_rows("x", cut[: len(cut) // 2])) == 1


def run(spark, tmp_path, **more):
    query = drops.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), most=4000, **more)
    query.awaitTermination()
    assert query.exception() is None
    table = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    return table("documents"), table("findings"), table("refused")


def test_batches_of_files(spark, folder, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs, found, refused = run(spark, tmp_path)
    rows = {name(r["doc_id"]): r for r in docs.collect()}
    assert set(rows) == {"a.txt", "b.docx", "c.txt", "blank.txt"} and rows["b.docx"]["title"] == "b.docx" and rows["a.txt"]["title"] == "Bu yanlız bir deneme deneme."
    assert rows["b.docx"]["summary"] == "Belge okundu: 3 metin bloğu, 0 tablo, 0 görsel, üst/altbilgi dahil." and rows["a.txt"]["summary"] is None
    assert {(name(r["doc_id"]), r["excerpt"]) for r in found.collect()} >= {("b.docx", "Herkez"), ("c.txt", "herkez")}
    alone = pipeline.Analyzer().texts(spark.createDataFrame([(1, "Bu yanlız bir deneme deneme.")], "doc_id long, text string")).findings
    same = ("type", "excerpt", "suggestion", "start", "end")
    assert sorted(map(str, alone.select(*same).collect())) == sorted(map(str, found.where("doc_id like '%/a.txt'").select(*same).collect()))
    assert refused.count() == 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

    (folder / "d.txt").write_text("Herkez burada.", encoding="utf-8")
    docs, found, refused = run(spark, tmp_path)
    assert docs.count() == 5 and docs.where("batch = 1").count() == 1 and found.where("batch = 1").count() >= 1 and refused.count() == 3


def test_repeated_batch_replaces_itself(spark, folder, tmp_path, monkeypatch):
    """A batch fails once its findings are written; the next start repeats the batch, and nothing is there twice."""
    real = drops.documents

    def lost(parsed, placed):
        raise ValueError("lost")

    monkeypatch.setattr(drops, "documents", lost)
    query = drops.watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint"), most=4000)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out" / "findings")).count()
    monkeypatch.setattr(drops, "documents", real)
    docs, found, refused = run(spark, tmp_path)
    assert written > 0 and found.count() == written
    assert docs.count() == 4 and refused.count() == 3 and docs.select("batch").distinct().count() == 1


def test_small_batches_and_no_files(spark, folder, tmp_path):
    docs, _, refused = run(spark, tmp_path, files=4)
    assert docs.select("doc_id").distinct().count() == 4 and refused.count() == 3
    (tmp_path / "none").mkdir()
    query = drops.watch(spark, str(tmp_path / "none"), str(tmp_path / "nothing"), str(tmp_path / "checkpoint2"))
    query.awaitTermination()
    assert query.exception() is None and not (tmp_path / "nothing").exists()
