"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a group of WARC/1.1 records, and a
seek table in a skippable frame at its end (the public seekable format), so that one frame can be read
alone. The index maps a record's identifier to bundle, frame and offset in the frame.

Bundles go to a folder that all machines share, through Arrow's file systems, under names that are
unique to the attempt. The index is written by Spark, whose commit is atomic; it names only the bundles
of attempts that succeeded, so a lost executor's files are never read, and they are deleted after the commit.
Responses are written first; a revisit then names the record of a response that the committed index has.

Null payloads are empty. Repeated rows: among records of equal payload, all those that have the
largest identifier are responses. A null identifier ranks lowest. No payload is cut.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from doclens.llm.common import bound_arrow, new_folder, stored, table, tidy

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
LEAST_REVISIT = 1000


def record(kind: str, name: str, url: str | None, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC record; a revisit's block is empty and its headers name the response's record."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(frame: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset after it."""
    end = frame.index(b"\r\n\r\n", at)
    first, *lines = frame[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    start, size = end + 4, int(head["Content-Length"])
    if frame[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("the record does not end where it says")
    return head, frame[start : start + size], start + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, decompressed) sizes and the footer."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the end of a bundle."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    raw, at, out = f.read(8 * n), 0, []
    for i in range(n):
        c, d = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, c, d))
        at += c
    return out


class Bundle:
    """Writer of one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.zip, self.frame_bytes = zstandard.ZstdCompressor(level=3), frame_bytes
        self.out, self.sizes, self.frame = io.BytesIO(), [], bytearray()

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame."""
        if self.frame and len(self.frame) + len(data) > self.frame_bytes:
            self.flush()
        where = len(self.sizes), len(self.frame)
        self.frame += data
        return where

    def flush(self) -> None:
        if self.frame:
            packed = self.zip.compress(bytes(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.frame = bytearray()

    def close(self) -> bytes:
        self.flush()
        self.out.write(seek_table(self.sizes))
        return self.out.getvalue()


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def classify(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = LEAST_REVISIT) -> DataFrame:
    """(key, url, payload, length, digest, kind, refers_to) of each row; refers_to is the response's key."""
    text = F.coalesce(F.col(payload), F.lit(""))
    digest = F.sha1(F.encode("payload", "UTF-8"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), text.alias("payload")).withColumns({"length": F.octet_length("payload").cast("long"), "digest": digest})
    # only payloads that occur twice need a look-up; counts are summed before the shuffle
    light = pages.select(F.col(key).alias("key"), text.alias("payload")).where(F.octet_length("payload") >= least).select("key", digest.alias("digest"))
    kept = stored(light.groupBy("digest").agg(F.max("key").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest"), "warc-repeats")
    repeats = rows.join(kept, "digest", "left")
    old = F.coalesce((F.col("length") >= least) & ~F.col("key").eqNullSafe(F.col("newest")) & F.col("newest").isNotNull(), F.lit(False))
    return repeats.select("key", "url", "payload", "length", "digest", F.when(old, "revisit").otherwise("response").alias("kind"), F.when(old, F.col("newest")).alias("refers_to"))


def _index(rows: DataFrame) -> T.StructType:
    fields = [("record_id", T.StringType()), ("key", rows.schema["key"].dataType), ("digest", T.StringType()), ("kind", T.StringType()), ("refers_to", rows.schema["refers_to"].dataType), ("bundle", T.StringType()), ("frame", T.IntegerType()), ("start", T.IntegerType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write classified rows as bundles below ``folder``; returns the committed index."""
    no_record = F.lit(None).cast("string").alias("record")
    first = _write(rows.where("kind = 'response'").withColumn("record", no_record), folder)
    targets = first.groupBy("digest").agg(F.min("record_id").alias("record"))
    # nothing but the headers of a revisit is written, so its payload goes no further than the scan
    revisits = rows.where("kind = 'revisit'").withColumn("payload", F.lit("")).join(targets, "digest").select("key", "url", "payload", "length", "digest", "kind", "refers_to", "record")
    index = first.unionByName(_write(revisits, folder))
    sweep(index, folder)
    return index


def _write(rows: DataFrame, folder: str) -> DataFrame:
    spark = rows.sparkSession
    bound_arrow(spark)
    schema = _index(rows)
    key_type, to_type = (to_arrow_type(schema[c].dataType) for c in ("key", "refers_to"))
    kinds = [pa.string(), key_type, pa.string(), pa.string(), to_type, pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)

        def save(bundle: Bundle, index: list) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(bundle.close())
            every = [(*x[:5], name, *x[5:]) for x in index]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in every], kind) for i, kind in enumerate(kinds)], names=schema.names)

        bundle, index, size = Bundle(), [], 0
        for batch in batches:
            for r in batch.to_pylist():
                data = r["payload"].encode("utf-8", "surrogatepass")
                if len(data) >= 1 << 32:
                    raise ValueError("a payload of 4 GB or more does not fit a frame")
                name = f"{'none' if r['key'] is None else r['key']}:{uuid.uuid4().hex}"
                where = bundle.add(record(r["kind"], name, r["url"], data, r["digest"], r["length"], r["record"]))
                index.append((name, r["key"], r["digest"], r["kind"], r["refers_to"], *where))
                size += len(data)
                if size >= BUNDLE_BYTES or len(index) >= 50_000:
                    yield save(bundle, index)
                    bundle, index, size = Bundle(), [], 0
        if index:
            yield save(bundle, index)

    return stored(rows.mapInArrow(tidy(run), schema), "warc-index")


def sweep(index: DataFrame, folder: str) -> None:
    """Delete the bundles that the index does not name: those of failed attempts. Executors list and delete them."""
    spark = index.sparkSession
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.substring_index("path", "/", -1).alias("bundle"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):  # nothing was written
            raise
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                fs.delete_file(f"{root}/{name}")
            yield batch

    files.join(index.select("bundle"), "bundle", "left_anti").mapInArrow(run, "bundle string").write.format("noop").mode("overwrite").save()


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, read back frame by frame and checked against their identifiers and digests.

    ``refers_to_record`` is the record that a revisit names, as the archive has it.
    """
    key, to = index.schema["key"].dataType, index.schema["refers_to"].dataType
    fields = [("page_id", key), ("url", T.StringType()), ("payload", T.BinaryType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", to), ("record_id", T.StringType()), ("refers_to_record", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = file_system(folder)
        unzip = zstandard.ZstdDecompressor()
        give = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=schema.names)
        plain = lambda name: name.removeprefix("<urn:record:").removesuffix(">")
        for batch in batches:
            for name, tab in _by_bundle(batch):
                path = f"{root}/{name}"
                out: list[tuple] = []
                with fs.open_input_file(path) as f:
                    frames = read_table(f, f.size())
                    last, data, held = -1, b"", 0
                    for r in sorted(tab, key=lambda r: (r["frame"], r["start"])):
                        if r["frame"] != last:
                            last = r["frame"]
                            at, packed, size = frames[last]
                            f.seek(at)
                            data = unzip.decompress(f.read(packed), max_output_size=size)
                        head, block, _ = parse(data, r["start"])
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if plain(head["WARC-Record-ID"]) != r["record_id"]:
                            raise ValueError(f"{name}: {r['record_id']} does not stand where the index says")
                        if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload of {r['record_id']} does not have its digest")
                        target = plain(head["WARC-Refers-To"]) if kind == "revisit" else None
                        out.append((r["key"], head.get("WARC-Target-URI"), block if kind == "response" else None, int(head["X-Payload-Length"]), digest, kind, r["refers_to"], r["record_id"], target))
                        held += len(block)
                        if held >= 1 << 20 or len(out) >= 5000:
                            yield give(out)
                            out, held = [], 0
                if out:
                    yield give(out)

    return index.repartition("bundle").mapInArrow(tidy(run), schema)


def _by_bundle(batch: pa.RecordBatch):
    found: dict[str, list] = {}
    for r in batch.to_pylist():
        found.setdefault(r["bundle"], []).append(r)
    return found.items()


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all pages written to archives and read back."""
    folder = new_folder(spark, "warc")
    index = write(classify(table(spark, sf_dir, "pages")), folder)
    return fetch(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN m.newest IS NOT NULL AND m.newest <> p.page_id AND p.payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.newest IS NOT NULL AND m.newest <> p.page_id AND p.payload_bytes >= 1000 THEN m.newest END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
