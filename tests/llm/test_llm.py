"""Operators of doclens.llm against brute force, round trips and held-out accuracy, with their edge cases."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from doclens.llm import bpe, chat, common, decontaminate, fingerprint, jaccard, langid, licenses, sharding, shingles, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
EDGE = [
    (1, None, "en", "s", None),
    (2, "", None, "s", 0),
    (3, "   \n\t ", "en", None, 6),
    (4, "one two", "en", "s", 7),
    (4, "one two", "en", "s", 7),
    (5, LONG, "en", "s", len(LONG)),
    (6, LONG + " tail", "en", "s", None),
    (7, "é İ ß 日本語 😀 <|endoftext|>", "fr", "s", None),
    (None, "no id here at all", "en", "s", None),
    (8, "!!! ???", "en", "s", 7),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


# BPE


def test_bpe_is_the_library(spark, sample, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = ["a" * 3000, "ab" * 700 + "'s", "ΣΑΣ it's we'll 1½Ⅷ", "\x1c\x1d a\x85b", "x<|startoftext|>y"]
    docs = sample.select("doc_id", "text").union(edge.select("doc_id", "text")).union(spark.createDataFrame([(9, t) for t in more], "doc_id long, text string"))
    for r in bpe.encode_decode(docs).collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == own.decode(ids, skip_special_tokens=False)


def test_bpe_tree_is_the_plain_loop():
    rng = random.Random(1)
    merges = {(a, b): (rng.randrange(30), rng.randrange(6)) for a in range(6) for b in range(6) if rng.random() < 0.6}
    for _ in range(300):
        ids = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        want = list(ids)
        while True:
            ranked = [(merges[p][0], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in merges]
            if not ranked:
                break
            i = min(ranked)[1]
            want[i : i + 2] = [merges[want[i], want[i + 1]][1]]
        assert bpe.merged(ids, merges) == want


def test_bpe_words_are_encoded_together(monkeypatch):
    """Words of a slice grow in forests, side by side; a tree alone is left for words beyond the widest forest. All equal the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n)) for n in range(1, 46) for _ in range(20)]
    codec, alone, plain = bpe.Codec(bpe.vocabulary()), [], bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda ids, merges: alone.append(len(ids)) or plain(ids, merges))
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    texts = [" ".join(words), words[-1] + "x" * 62, "y" * 63, "z" * 500 + "!'s <|endoftext|><|ENDOFTEXT|> a\x1cb", "", None, "!'s 're'abc"]
    for ask in ([codec.encode(t) for t in texts], [codec.encode(t) for t in texts]):
        assert ask == [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert min(alone) == 63 and len(alone) < 8, alone
    assert all(len(w) <= bpe.CACHED_CHARS for w in codec.new)


def test_bpe_replaces_clashing_columns(spark):
    got = bpe.encode_decode(spark.createDataFrame([("x", 1)], "text string, IDS int"))
    assert got.columns == ["text", "ids", "decoded"]
    assert bpe.encode_decode(got.limit(0)).count() == 0


def test_bare_rights_line(spark):
    bsd = licenses.TEMPLATES["bsd-text"]
    docs = ["some words\nAll rights reserved.\nmore", f"All rights reserved. {bsd}", f"All rights reserved. {bsd.replace('disclaimer', 'notice')}", licenses.TEMPLATES["all-rights-reserved"], "all rights"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["th"]: r["license"] for r in licenses.scan(frame).collect()}
    assert [got.get(r["th"]) for r in frame.select("doc_id", F.xxhash64("text").alias("th")).orderBy("doc_id").collect()] == ["rights-reserved", "bsd-text", "bsd-text", "all-rights-reserved", None]


# fingerprints


def _sketch(text):
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        seed = 42
        for v in (h[i : i + 5] + [0] * 5)[:5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
        signed = seed - (1 << 64) if seed >> 63 else seed
        out.add(signed)
    return {x for x in out if x < -(1 << 63) + (1 << 64) // fingerprint.SCALE} or {min(out)} if out else out


def _hex(s):
    return "".join(f"{v % (1 << 64):016x}" for v in sorted(s))


def test_fingerprints(spark, sample, tmp_path):
    docs = sample.select("doc_id", "text").union(spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "a b")], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark, str(tmp_path)).collect()}
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert len(got) == len(texts)
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        a, b, c = _sketch(t), _sketch(e), _sketch(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(e.encode()).hexdigest(), _hex(a), _hex(b))
        assert abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12


def test_next_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 0.02)
    monkeypatch.setattr(fingerprint, "RANGES", 4)
    rng = random.Random(4)
    ids = sorted(rng.sample(range(-50, 10**6), 150)) + [10**12, 10**15]
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_next_of_the_greatest_and_least_ids(spark):
    ids = [-(1 << 63), -1, 0, (1 << 63) - 1]
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")).collect()}
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_licence_with_words_put_in(spark):
    mit = licenses.TEMPLATES["mit-text"].split()
    half, n = len(mit) // 2, len(regex.findall(r"[\p{L}\p{N}]+", licenses.TEMPLATES["mit-text"])) - 1
    frame = spark.createDataFrame([(k, " ".join([*mit[:half], *["inserted"] * k, *mit[half:]])) for k in range(1, 60)], "doc_id long, text string")
    got = {r["th"]: r for r in licenses.scan(frame).collect()}
    for r in frame.select("doc_id", F.xxhash64("text").alias("th")).collect():
        k = r["doc_id"]
        whole, one = 2 * (n - 1) / (2 * n + k), 2 * (n // 2 + 1) / (n // 2 + 1 + n)  # both parts, or the longer one
        found = got.get(r["th"])
        assert one < licenses.AT_LEAST and (found is not None) == (whole >= licenses.AT_LEAST), k
        assert found is None or abs(found["dice"] - whole) < 1e-12


def test_next_over_repeated_and_null_ids(spark, edge):
    got = fingerprint.with_next(edge).collect()
    assert len(got) == len(EDGE) and all(r["next_text"] is not None for r in got)
    assert fingerprint.with_next(edge.limit(0)).count() == 0


def test_sketches_merge(spark):
    a, b = LONG[:40_000], LONG[30_000:90_000]
    r = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b")).select(fingerprint.merge(F.col("a"), F.col("b")).alias("m"), fingerprint.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert set(r["m"]) == _sketch(a) | _sketch(b)
    short = [("alpha beta", "gamma delta"), ("alpha beta", LONG), ("", "..."), (None, "a"), ("a", "a")]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(short)], "i int, a string, b string").select("i", "a", "b", fingerprint.sketch(F.col("a")).alias("x"), fingerprint.sketch(F.col("b")).alias("y"))
    got = frame.select("*", fingerprint.resemblance(F.col("x"), F.col("y")).alias("r"), fingerprint.merge(F.col("x"), F.col("y")).alias("m")).orderBy("i").collect()
    assert [x["r"] for x in got] == [0.0, 0.0, 1.0, 0.0, 1.0]
    assert set(got[1]["m"]) == _sketch(LONG) and set(got[0]["m"]) == {min(_sketch("alpha beta") | _sketch("gamma delta"))}
    assert abs(r["c"] - len(_sketch(a) & _sketch(b)) / len(_sketch(a))) < 1e-12


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    data = [(1, "u", big), (2, "u\r\n", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "y" * 10), (7, "u", "y" * 10), (8, "u", "é" * 500), (9, "u", "é" * 500), (None, "u", big), (3, "u", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    (tmp_path / "warc").mkdir()
    (tmp_path / "warc" / "lost.warc.zst").write_bytes(b"half a bundle of a failed attempt")
    index = warc.write(warc.classify(pages), folder)
    got = warc.fetch(index, folder).collect()
    assert len(got) == len(data)
    assert {f.name for f in (tmp_path / "warc").iterdir() if f.suffix == ".zst"} == {r["bundle"] for r in index.collect()}
    target = {r["record_id"]: r for r in got}
    assert len(target) == len(data)
    for r in got:
        if r["record_type"] == "revisit":
            to = target[r["refers_to_record"]]
            assert to["record_type"] == "response" and (to["page_id"], to["payload_digest"]) == (r["refers_to"], r["payload_digest"])
        else:
            assert r["refers_to_record"] is None
    none = warc.write(warc.classify(pages.limit(0)), f"file://{tmp_path}/none")
    assert warc.fetch(none, f"file://{tmp_path}/none").count() == 0
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for key, _, html in data:
        payload = (html or "").encode()
        for r in by[key]:
            newest = {big.encode(): 3, ("é" * 500).encode(): 9}.get(payload, key)
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if newest == key else ("revisit", newest))
            assert r["payload"] == (payload if newest == key else None)


def test_warc_frames_are_seekable():
    import io

    import zstandard

    b = warc.Bundle(frame_bytes=300)
    data = [warc.record("response", f"n{i}", "u", b"p" * (i * 40), "d", i * 40, None) for i in range(12)]
    where = [b.add(x) for x in data]
    raw = b.close()
    frames = warc.read_table(io.BytesIO(raw), len(raw))
    assert len(frames) == where[-1][0] + 1 > 3
    for x, (frame, at) in zip(data, where, strict=True):
        start, packed, plain = frames[frame]
        got = zstandard.ZstdDecompressor().decompress(raw[start : start + packed], max_output_size=plain)
        assert got[at : at + len(x)] == x
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).readall() == b"".join(data)


# Jaccard join


def _brute(data, threshold=0.8):
    sets = []
    for _, text in data:
        w = regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(data)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in range(n):
                if link[todo[-1]][j] and j not in seen:
                    seen.add(j)
                    todo.insert(0, j)
            todo.pop()
        same = [data[j][0] for j in range(n) if sets[j] == sets[i] and sets[i]] or [data[i][0]]
        out.append((data[i][0], min(same), sum(link[i]), min(data[j][0] for j in seen)))
    return sorted(out)


def _near(seed, n):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 8)  # large clusters go in pairs of blocks
    texts = _near(1, 40) + _near(2, 15) + [f"only {i} here and nothing else {i * 7}" for i in range(20)] + ["a b", "A, b!", "a", "", None, "...", LONG, LONG, LONG + " x"]
    data = [(100 + i, t) for i, t in enumerate(texts)]
    got = jaccard.join(spark.createDataFrame(data, "doc_id long, text string")).select("key", "class_id", "n_links", "group_id")
    assert sorted(rows(got)) == _brute(data)


def test_jaccard_of_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 4)
    words = [f"c{i}" for i in range(1900)]
    data = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(400)] + [(500 + i, t) for i, t in enumerate(_near(7, 30))]
    seen = []
    monkeypatch.setattr(jaccard, "_verified", lambda members, threshold, own=jaccard._verified: (seen.append(members), own(members, threshold))[1])
    got = jaccard.join(spark.createDataFrame(data, "doc_id long, text string")).select("key", "class_id", "n_links", "group_id")
    assert sorted(rows(got)) == _brute(data)
    by_bucket = seen[0].select("bucket").where("bucket is not null").distinct().count()
    copies = seen[0].groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert by_bucket > 100 and copies < len(data) / 4  # what pairs of blocks of the whole cluster would need


def test_jaccard_recall(spark):
    rng = random.Random(11)
    data, links = [], 0
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(200)]
        other = list(base)
        for k in rng.sample(range(5, 195, 11), 4):  # four edits far apart change 20 shingles of 196: 176 / 216
            other[k] = "x"
        data += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    want = _brute(data)
    got = sorted(rows(jaccard.join(spark.createDataFrame(data, "doc_id long, text string")).select("key", "class_id", "n_links", "group_id")))
    found, links = sum(r[2] for r in got), sum(r[2] for r in want)
    print(f"recall at likeness 0.81: {found} of {links}")
    assert links == 300 and found >= 0.99 * links


def test_jaccard_letters_newer_than_the_jvm_and_other_ids(spark):
    data = [("a", "\U00011f04 \U00011f05"), ("b", "\U00011f04 \U00011f05"), ("c", "plain"), (None, "plain")]
    got = rows(jaccard.join(spark.createDataFrame(data, "doc_id string, text string")).select("key", "class_id", "n_links"))
    assert sorted(got, key=str) == sorted([("a", "a", 1), ("b", "a", 1), ("c", "c", 0), (None, None, 0)], key=str)


def test_hubs_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_EDGES", 10)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(299, 1000), (5000, 5001)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 5000 if x >= 5000 else 0 for e in edges for x in e}


def test_jaccard_edges(spark, edge):
    got = jaccard.join(edge)
    assert got.count() == len(EDGE)
    assert {(r["class_id"], r["n_links"]) for r in got.collect() if r["key"] == 4} == {(4, 1)}
    assert jaccard.join(edge.limit(0)).count() == 0
    kept = jaccard.stage(spark, edge.withColumn("_th", F.lit(1)), "")
    assert kept.columns == [*edge.columns, "_th"] and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_shingle_sets_are_sets():
    texts = ["", "a", "a b c d", "a b c d e", "A! b-c d e f g a b c d e", "é́x y"]
    at, sets = shingles.shingle_sets(texts)
    for i, t in enumerate(texts):
        w = regex.findall(r"[\p{L}\p{N}\p{M}]+", t.lower())
        assert at[i + 1] - at[i] == len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500 + i) for i in range(1, 80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# decontamination


def test_alignment_is_the_table():
    rng = np.random.RandomState(0)
    for _ in range(40):
        a, b = rng.randint(0, 4, rng.randint(1, 12)), rng.randint(0, 4, rng.randint(0, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max()


def test_decontamination_finds_edits_and_both_ways_agree(spark, edge):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(rng.randrange(15, 50)))) for i in range(12)] + [(98, None), (99, "a b"), (None, "one two three four five six")]
    noise = lambda n: [f"t{rng.randrange(3000)}" for _ in range(n)]
    docs, want = [], {}
    for i, (_, t) in enumerate(items[:12]):
        w = t.split()
        edited = [x for k, x in enumerate(w) if k % 9 != 4] if i % 3 == 1 else [f"z{k}" if k % 6 == 5 else x for k, x in enumerate(w)] if i % 3 == 2 else w
        docs.append((i, " ".join(noise(200) + edited + noise(100))))
        want[i] = i
    docs += [(100 + i, " ".join(noise(300))) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(edge.select("doc_id", "text")).withColumn("score", F.lit("old"))
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.screen(frame, tests)
    other = decontaminate.screen(frame, tests, most_words=0)
    key = lambda df: sorted(((r["doc_id"], r["contaminated"], r["item_id"], r["score"], r["n_items"], r["start_word"], r["end_word"]) for r in df.collect()), key=str)
    assert key(got) == key(other)
    assert {r["doc_id"]: r["item_id"] for r in got.collect() if r["contaminated"]} == want
    short = spark.createDataFrame([("p", "Answer: forty two!"), ("q", "a b"), ("r", "..."), ("s", None), ("t", items[0][1])], "item_id string, text string")
    more = spark.createDataFrame([(500, "the answer forty two is right, a b"), (501, "answer two forty; b a"), (502, "a b answer forty two")], "doc_id long, text string")
    both = [sorted(rows(decontaminate.screen(more, short, most_words=m).select("doc_id", "contaminated", "item_id", "score", "n_items", "start_word", "end_word"))) for m in (1000, 0)]
    assert both[0] == both[1] == [(500, True, "p", 1.0, 2, 1, 4), (501, True, "p", 0.5, 1, 0, 3), (502, True, "p", 1.0, 2, 2, 5)]
    none = decontaminate.screen(frame, tests.limit(0))
    assert none.count() == frame.count() and none.where("contaminated").count() == 0
    assert decontaminate.screen(frame.limit(0), tests).count() == 0


def test_decontamination_misses_no_alignment(spark):
    rng = random.Random(9)
    items = [(i, " ".join(f"t{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(5, 45)))) for i in range(25)]
    docs = [w.split() for _, w in items]  # exact copies, so that edited n-grams are rarer than the intact ones
    for _, t in items:
        w = t.split()
        for k in range(3, 9):
            docs += [[f"z{j}" if j % k == k - 1 else x for j, x in enumerate(w)], [x for j, x in enumerate(w) if j % k != 1]]
        docs += [[y for x in w for y in (x, "z")], [y for j, x in enumerate(w) for y in ((x, "z", "y") if j % 3 == 2 else (x,))]]
        for _ in range(6):
            part = rng.choice([0.2, 0.35, 0.5])
            docs.append([y for x in w for y in ([x] if rng.random() > part else rng.choice([[], ["z"], [x, "y"]]))])
    noise = lambda: [f"t{rng.randrange(400)}" for _ in range(rng.randrange(30))]
    rows = [(i, " ".join([*noise(), *d, *noise()])) for i, d in enumerate(docs)]
    some = [decontaminate.align(w, shingles.word_hashes([t])[1])[::2] for w in map(lambda t: shingles.word_hashes([t])[1], [t for _, t in items]) for _, t in rows[:40]]
    both = decontaminate.align_all([shingles.word_hashes([t])[1] for _, t in items for _ in rows[:40]], [shingles.word_hashes([t])[1] for _ in items for _, t in rows[:40]])
    assert list(zip(*map(list, both), strict=True)) == some
    own = decontaminate.Items([i for i, _ in items], [t for _, t in items])
    want = {}
    for i, t in rows:
        like = [(decontaminate.align(w, shingles.word_hashes([t])[1])[0] / (2 * len(w)), -k) for k, w in zip(own.ids, own.words, strict=True)]
        if max(like)[0] >= decontaminate.AT_LEAST:
            want[i] = (max(like)[0], -max(like)[1], sum(x >= decontaminate.AT_LEAST for x, _ in like))
    frame, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 300
    for most in (decontaminate.MOST_ITEM_WORDS, 0):
        got = decontaminate.screen(frame, tests, most_words=most).where("contaminated").collect()
        assert {r["doc_id"]: (r["score"], r["item_id"], r["n_items"]) for r in got} == want


def test_short_items_are_aligned_too(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(1 + i % 4))) for i in range(16)] + [(90, "alpha beta gamma delta")]
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 14)))) for i in range(150)] + [(900, "alpha beta omega delta"), (901, "gamma alone")]
    own = {i: shingles.word_hashes([t])[1] for i, t in items}
    want = {}
    for d, t in docs:
        score = {i: decontaminate.align(w, shingles.word_hashes([t])[1])[0] for i, w in own.items()}
        like = sorted((-x / (2 * len(own[i])), i) for i, x in score.items() if x >= len(own[i]) and (x > 2 or len(own[i]) == 1))
        want[d] = (True, like[0][1], -like[0][0], len(like)) if like else (False, None, 0.0, 0)
    assert want[900] == (True, 90, 0.625, 1) and not want[901][0] and 20 < sum(w[0] for w in want.values()) < 150
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.MOST_ITEM_WORDS, 0):
        got = decontaminate.screen(frame, tests, most_words=most).collect()
        assert {r["doc_id"]: (r["contaminated"], r["item_id"], r["score"], r["n_items"]) for r in got} == want


def test_rare_seeds_lead_to_all_that_have_enough():
    rng = random.Random(8)
    texts = [" ".join(f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    own = decontaminate.Items(list(range(20)), texts[:20])
    flat = list(own.find(texts))
    own.rank(own.count(texts))
    assert list(own.find(texts)) == flat and len(own.rare.all) < len(own.seeds.all)


def test_alignment_bounds():
    item = np.arange(10, 22, dtype=np.uint64)
    gap = np.concatenate([[1, 2, 3], item[:5], [7, 8], item[5:9], item[10:], [4, 5]]).astype(np.uint64)
    assert decontaminate.align(item, gap) == (2 * 11 - 3, 3, 16)
    assert decontaminate.align(item, item[:0]) == (0, 0, 0)


def test_leaks_are_all_alignments(spark):
    """The whole query beside alignments of every document with every item."""
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    hashed = {r["item_id"]: shingles.word_hashes([r["text"]])[1] for r in items}
    got = {r["doc_id"]: r for r in decontaminate.leaks(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        h = shingles.word_hashes([d["text"] or ""])[1]
        score, _ = decontaminate.align_all(list(hashed.values()), [h] * len(hashed))
        like = sorted(((-x / (2 * len(w)), i) for (i, w), x in zip(hashed.items(), score.tolist(), strict=True)))
        r = got[d["doc_id"]]
        assert r["contaminated"] == (-like[0][0] >= decontaminate.AT_LEAST)
        assert r["n_items"] == sum(-x >= decontaminate.AT_LEAST for x, _ in like)
        if r["contaminated"]:
            assert (r["score"], r["item_id"]) == (-like[0][0], like[0][1])
            again = decontaminate.align(hashed[r["item_id"]], h[r["start_word"] : r["end_word"]])
            assert again == (round(r["score"] * 2 * len(hashed[r["item_id"]])), 0, r["end_word"] - r["start_word"])


# licences


def test_licence_candidates_are_pruned(spark):
    known = licenses.templates(spark, licenses.TEMPLATES)
    frame = spark.createDataFrame([(1, "Permission to use the software is hereby granted"), (2, "Released under the MIT License.")], "doc_id long, text string")
    n = lambda at: licenses.candidates(frame, known, at_least=at).select("th", "template").distinct().count()
    assert 0 < n(licenses.AT_LEAST) < n(0.0)
    long = {r["template"] for r in licenses.candidates(frame, known).select("template").distinct().collect()}
    assert "mit" in long and "mit-text" not in long and "isc-text" not in long


def test_licences(spark, edge):
    line = licenses.TEMPLATES["gpl-3.0"]
    docs = [(1, f"some words\n{line}\nmore"), (2, "LICENSED!! UNDER** the Apache License, Version 2.0."), (3, "licensed under the"), (4, licenses.TEMPLATES["mit-text"].replace("Software", "Work")), (5, f"{line} {line}"), (6, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    got = {r["th"]: r for r in licenses.scan(frame).collect()}
    th = {r["doc_id"]: r["th"] for r in frame.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).where("doc_id < 7 and text like '%icen%' or doc_id = 4").collect()}
    name = lambda i: got[th[i]]["license"] if th.get(i) in got else None
    assert [name(i) for i in (1, 2, 3)] == ["gpl-3.0", "apache-2.0", None]
    assert got[th[1]]["dice"] == 1.0 and (got[th[1]]["first_word"], got[th[1]]["last_word"]) == (2, 13)
    assert got[th[6]]["n_licenses"] == 2
    assert licenses.scan(frame.limit(0)).count() == 0


def test_licences_in_repeated_lines_and_beside_stray_words(spark):
    mit, gpl = licenses.TEMPLATES["mit"], licenses.TEMPLATES["gpl-3.0"]
    rows = [(0, f"{mit}\n{mit}"), (1, f"{gpl} {gpl}"), (2, f"{mit} It falls under the rules"), (3, f"under the terms of the {mit} under the mit"), (4, f"{gpl} " * 40)]
    rng = random.Random(3)
    pool = [w for t in (mit, gpl, licenses.TEMPLATES["isc-text"]) for w in t.split()]
    rows += [(5 + i, " ".join(rng.choice([mit, gpl, *pool, "x", "y"]) for _ in range(rng.randrange(4, 14)))) for i in range(60)]
    rows += [(70, licenses.TEMPLATES["isc-text"] + " and this permission notice")]
    isc = licenses.TEMPLATES["isc-text"].split()
    for i, n in enumerate((1, 5, 6, 7, 8, 12, 15, 16, 17, 18)):  # words put in at one place, and at two
        rows.append((80 + i, " ".join(["before", *isc[:12], *["put"] * n, *isc[12:], "behind"])))
        rows.append((100 + i, " ".join([*isc[:9], *["x"] * (n // 2), *isc[9:21], *["y"] * (n - n // 2), *isc[21:], "of the software"])))
    pairs = lambda t: [(a, b) for w in [regex.findall(r"[\p{L}\p{N}]+", t.lower())] for a, b in zip(w, w[1:], strict=False)]

    def brute(text):
        found = {}
        own = pairs(text)
        for name, t in licenses.TEMPLATES.items():
            want = Counter(pairs(t))
            n = want.total()
            like = [2 * (Counter(own[a : b + 1]) & want).total() / (b - a + 1 + n) for a, g in enumerate(own) if g in want for b in range(a, min(len(own), a + 2 * n)) if own[b] in want]
            if like and max(like) >= licenses.AT_LEAST:
                found[name] = max(like)
        return min(((k == licenses.BARE, -d, k) for k, d in found.items()), default=None), len(found)

    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["th"]: r for r in licenses.scan(frame).collect()}
    th = {r["doc_id"]: r["th"] for r in frame.select("doc_id", F.xxhash64("text").alias("th")).collect()}
    assert [(got[th[i]]["license"], got[th[i]]["dice"]) for i in range(5)] == [("mit", 1.0), ("gpl-3.0", 1.0), ("mit", 1.0), ("mit", 1.0), ("gpl-3.0", 1.0)]
    for i, t in rows:
        best, n = brute(t)
        r = got.get(th[i])
        assert (r is None) == (best is None)
        assert r is None or (-r["dice"], r["license"], r["n_licenses"]) == (best[1], best[2], n)


# sharding


def test_sharding_keeps_all_and_merges(spark, edge, tmp_path):
    store = sharding.shard(edge, f"file://{tmp_path}/a", arrivals=5)
    key = lambda df: sorted(map(str, rows(df.select(*edge.columns))))
    assert key(store.read()) == key(edge)
    assert len(store.runs()) < 4 and store.version() >= 5
    store.append(edge)
    assert store.read().count() == 2 * len(EDGE)
    with pytest.raises(sharding.Conflict):
        store.commit(store.version() - 1, [])
    assert sharding.shard(edge.limit(0), f"file://{tmp_path}/b").runs() == []


def test_sharding_keeps_what_retained_versions_list(spark, edge, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/a")
    for _ in range(4):
        store.append(edge)
    before, n = store.version(), store.read().count()
    held = store.read(before)
    assert store.compact() == 1 and len(store.runs()) == 1
    assert store.read(before).count() == held.count() == store.read().count() == n
    assert store.expire(keep=2) == 0  # the version before the merge still lists its runs
    assert store.expire(keep=1) == 4 and store.versions() == [before + 1] and store.read().count() == n


def test_sharding_with_concurrent_writers(spark, edge, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/a"

    def writer(_):
        store = sharding.Store(spark, root)
        for _ in range(3):
            store.append(edge)
            store.compact()

    sharding.Store(spark, root)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(writer, range(3)))
    store = sharding.Store(spark, root)
    store.compact()
    assert store.read().count() == 9 * len(EDGE)
    assert store.versions() == list(range(1, store.version() + 1))


# chat


def _say(**x):
    return json.dumps(x)


def test_tool_calls(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 9}}, "additionalProperties": False}}
    call = lambda i, args='{"a": 1}', name="add", after=None: {"id": i, "name": name, "arguments": args, "after": after}
    messages = [
        (1, 0, "assistant", _say(tool_calls=[call("x"), call("y", '{"b":1}'), call("z", after=["x"])])),
        (1, 1, "tool", _say(tool_call_id="x", content="é\n")),
        (1, 1, "tool", _say(tool_call_id="x", content="éé")),
        (1, 2, "tool", _say(tool_call_id="q", content="r")),
        (2, 0, "tool", _say(tool_call_id="x", content="early")),
        (2, 1, "assistant", _say(tool_calls=[call("x", "{bad"), call("m", name="none")])),
        (3, 0, "assistant", _say(tool_calls=[call("a", after=["b"]), call("b", after=["c"]), call("c")])),
        (4, 0, "assistant", _say(tool_calls=[call("a", after=["b"]), call("b", after=["a", "d"]), call("c", after=["b"]), call("d")])),
        (5, 0, "user", "plain"),
        (5, 1, "assistant", None),
        (6, 0, "tool", _say(tool_call_id="k", content=None)),
        (6, 1, "assistant", _say(tool_calls=[call("k", '{"a": 9}')])),
    ]
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link(*chat.extract(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")), schema).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {(1, "x"): "ok", (1, "y"): "bad_arguments", (1, "z"): "missing_result", (1, "q"): "orphan_result", (2, "x"): "bad_arguments", (2, "m"): "unknown_tool", (3, "a"): "missing_result", (3, "b"): "missing_result", (3, "c"): "missing_result", (4, "a"): "cycle", (4, "b"): "cycle", (4, "c"): "after_cycle", (4, "d"): "missing_result", (6, "k"): "early_result"}
    assert got[1, "x"]["json"] == '{"arguments":{"a":1},"id":"x","name":"add","result":"é\\n"}' and got[1, "x"]["repeats"] == 1
    assert got[1, "y"]["fault"] == "$.a: missing"
    assert [got[3, k]["depth"] for k in "abc"] == [2, 1, 0]


def test_tool_calls_that_cannot_be_read(spark):
    args = ["[" * 100_000, '{"a": "\\ud800"}', '{"\\udfff": 1}', "[" * 500 + "]" * 500, "NaN", "1e999", None]
    calls = spark.createDataFrame([(1, i, 0, f"c{i}", "t", a, None) for i, a in enumerate(args)], chat.CALLS)
    results = spark.createDataFrame([(1, 99, f"c{i}", "r") for i in range(len(args))], chat.RESULTS)
    got = {r["call_id"]: r for r in chat.link(calls, results, {"t": {"type": ["object", "array"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}}).collect()}
    assert [(got[f"c{i}"]["status"], got[f"c{i}"]["fault"]) for i in range(len(args))] == [("bad_arguments", "$: too deep"), ("ok", None), ("bad_arguments", "$.\\udfff: not allowed"), ("ok", None), ("bad_arguments", "$: not JSON"), ("bad_arguments", "$: not JSON"), ("ok", None)]
    assert json.loads(got["c1"]["json"])["arguments"] == {"a": "\ud800"} and json.loads(got["c0"]["json"])["arguments"] == args[0]
    empty = chat.link(calls.limit(0), results.limit(0), {})
    assert empty.count() == 0


def test_order_of_calls_both_ways(spark):
    rng = random.Random(6)
    data = []
    for conv in range(12):
        for i in range(14):
            after = [f"c{rng.randrange(14)}" for _ in range(rng.randrange(3))] if conv % 3 else [f"c{i + 1}"] if i < 13 else []
            data.append((conv, i, 0, f"c{i}", "t", "{}", after))
    calls, results = spark.createDataFrame(data, chat.CALLS), spark.createDataFrame([], chat.RESULTS)
    key = lambda m: sorted(rows(chat.link(calls, results, {"t": {}}, most_edges=m).select("conv_id", "call_id", "depth", "status")))
    whole = key(chat.MOST_EDGES)
    assert whole == key(0)
    assert {x for _, _, _, x in whole} == {"missing_result", "cycle", "after_cycle"}
    by = {(c, i): d for c, i, d, _ in whole}
    for conv, turn, _, call, _, _, after in data:
        if conv % 3 == 0:
            assert by[conv, call] == 13 - turn
        for to in after:
            forward = any(int(t[1:]) >= u for c, u, _, _, _, _, a in data if c == conv for t in a)
            assert not forward or by[conv, call] == -1 or by[conv, call] > by[conv, to] >= 0


def test_calls_and_results_are_hash_joined(spark):
    calls, results = chat.as_calls(spark.read.parquet(f"{SF}/conversations.parquet"))
    plan = chat.link(calls, results, {"reply": chat.REPLY})._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [conv_id" in plan and "SortMergeJoin" not in plan


def test_conversations_as_calls(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    done = chat.linked(spark, SF).collect()
    assert len(done) == len({(r["conv_id"], r["call_id"]) for r in done}) and {r["depth"] for r in done} == {0, 1, 2}
    got = {r["call_id"]: r for r in done if r["status"] != "message"}
    others = {f"{r['conv_id']}-{r['turn']}": r for r in turns if r["role"] not in ("user", "assistant")}
    assert {r["call_id"]: json.loads(r["json"]) for r in done if r["status"] == "message"} == {k: {"id": k, "role": r["role"], "content": r["text"]} for k, r in others.items()}
    users = {f"{r['conv_id']}-{r['turn']}": r for r in turns if r["role"] == "user"}
    answers = {f"{r['conv_id']}-{r['turn'] - 1}": r for r in turns if r["role"] == "assistant"}
    assert set(got) == set(users) | set(answers)
    for k, r in got.items():
        body = {"id": k}
        if k in users:
            body |= {"name": "reply", "arguments": {"prompt": users[k]["text"], "words": len([w for w in re.split("[ \n]+", users[k]["text"]) if w])}}
        if k in answers:
            body["result"] = answers[k]["text"]
        assert r["json"] == chat.canonical(body)


# language


def _plain_grams(text):
    import unicodedata

    word = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    out = []
    for w in word.split():
        s = [-1, *map(ord, w), -1]
        out += [(c,) for c in s[1:-1]]
        out += zip(s, s[1:], strict=False)
        out += zip(s, s[1:], s[2:], strict=False)
    return out


def _plain_key(gram):
    code = lambda c: langid.END if c < 0 else int(langid._codes()[c])
    return sum(code(c) << (langid.BITS * (2 - i)) for i, c in enumerate(gram))


def _plain_rank(total, ranks):
    return [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], _plain_key(x[0])))[:ranks]]


def test_grams_are_plain_counts():
    texts = ["Ab a, b", "", "日本 x", "!!", "é" * 5, "one two three two", "ไทย 한국 Việt ქართ", "\u0301"] + [""] * langid.TEXTS + ["end"]
    doc, gram, count = langid.gram_counts(texts)
    for i, t in enumerate(texts):
        if t:
            # a space between two words begins one and ends the other, so pairs with it are counted for each
            want = Counter(map(_plain_key, _plain_grams(t)))
            assert {int(g): int(n) for g, n in zip(gram[doc == i], count[doc == i], strict=True)} == want, t
    assert len({_plain_key(g) for t in texts for g in _plain_grams(t)}) == len({g for t in texts for g in _plain_grams(t)})


def test_languages_are_plain_distances(spark):
    """The whole query beside profiles and out-of-place distances made with dictionaries."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    total = {}
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            total.setdefault(r["lang"], Counter()).update(_plain_grams(r["text"]))
    profiles = {k: {g: i for i, g in enumerate(_plain_rank(v, langid.RANKS))} for k, v in total.items()}
    got = {r["doc_id"]: r for r in langid.languages(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own = _plain_rank(Counter(_plain_grams(r["text"] or "")), langid.RANKS)
        far = {k: sum(abs(i - p[g]) if g in p else langid.RANKS for i, g in enumerate(own)) / (max(len(own), 1) * langid.RANKS) for k, p in profiles.items()}
        want = min(sorted(far), key=far.get) if any(map(str.isalpha, r["text"] or "")) else langid.UNKNOWN
        assert got[r["doc_id"]]["lang_pred"] == want
        if want != langid.UNKNOWN:
            assert abs(got[r["doc_id"]]["score"] - 1 / sum(np.exp((far[want] - x) / langid.SPREAD) for x in far.values())) < 1e-9


def test_marks_alone_have_no_language(spark, edge):
    profiles = langid.learn(edge)
    assert profiles.predict(["\u0301\u0302", "a\u0301"])[0] == ["und", "en"]


def test_language_held_out(spark, edge):
    sf = "/root/testdata/sf0.01"
    got = langid.languages(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert {r["doc_id"] for r in got.where("held_out").collect()} == {r["doc_id"] for r in truth.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    profiles = langid.learn(edge)
    out = langid.identify(edge.withColumn("SCORE", F.lit(1)), profiles).collect()
    assert [r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 8)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in out)
    nothing = langid.learn(edge.limit(0))
    assert {r["lang_pred"] for r in langid.identify(edge, nothing).collect()} == {"und"}


# toxicity


def _signs(text, model=None):
    return toxicity.marks([s if s in toxicity.SIGNS else "*" for s in text.split()])


def test_grammar_marks():
    assert _signs("insult") == ["insult-plain"] and _signs("x x") == []
    assert _signs("negation x insult") == ["insult-negated"] and _signs("negation x x x x insult") == ["insult-plain"]
    assert _signs("report x x x x x x insult") == ["insult-reported"]
    assert _signs("quote x insult quote x report") == ["insult-reported"] and _signs("insult x report") == ["insult-plain"]
    assert _signs("target x insult") == ["insult-aimed"] and _signs("target x mild mild") == ["mild-plain", "mild-plain"]
    assert _signs("will x target x violence target") == ["threat"] and _signs("violence self") == ["threat"] and _signs("violence target") == []
    assert _signs("will x x x x x x x x x violence target") == []
    assert _signs("will object x violence") == _signs("object will x violence") == _signs("object vow") == _signs("vow x target") == _signs("will x strike") == ["threat"]
    assert _signs("will negation violence target") == _signs("negation will x strike") == _signs("negation object vow") == _signs("object x x x will") == []
    assert _signs("report x will violence target") == ["threat-reported"] and _signs("quote will violence target quote x report") == []


def test_composition_is_the_cascade():
    rng = random.Random(8)
    for _ in range(400):
        signs = [rng.choice([s for s in toxicity.SIGNS if s not in toxicity.MARKS]) for _ in range(rng.randrange(14))]
        # every path through the parts one behind another; each has one, as they are deterministic
        paths = [(0.0, signs)]
        for part in toxicity.FORWARD_PARTS:
            paths = [(w + v, out) for w, line in paths for out, v in [part.run(line)]]
        assert toxicity.FORWARD.run(signs) == max((p[::-1] for p in paths), key=lambda p: p[1])


def test_weighted_composition():
    a = toxicity.Fst({(0, "x"): (1, "y", 1.5), (1, "x"): (0, "z", 0.25), (1, "*"): (1, None, 0.0)})
    b = toxicity.counter("y", (2.0, 1.0))
    both = toxicity.compose(a, b, ("x", "y", "z", "*"))
    for line in ("x", "xx", "xyxx", "xxxxxx*x"):
        middle, v = a.run(line)
        out, w = b.run(middle)
        assert both.run(line) == (out, v + w)


def test_score_is_the_sum_over_paths(spark):
    """Scores beside a plain enumeration: all marks of all clauses through one counter after another."""
    model = toxicity.Model(words={"bad": "insult", "odd": "mild"}, stems={"zor": "mild"})
    texts = ["You bad one. odd odd zorg; zorx not bad\nHe said: bad", "I will kill you! odd", "", "bad" * 3, "x bad bad bad bad bad bad"]
    for t in texts:
        total = model.base
        marks = []
        for clause in toxicity.CLAUSE.split(t.lower()):
            tokens = toxicity.TOKEN.findall(clause)
            model.seek()
            marks += toxicity.marks([model.sign(x) for x in tokens])
        for m in toxicity.MARKS:
            total += toxicity.counter(m, model.weights[m]).run(marks)[1]
        assert abs(model.score(t) - 1 / (1 + np.exp(-total))) < 1e-12


def test_toxicity_without_labels(spark, edge):
    model = toxicity.learn(edge, spark.createDataFrame([], "doc_id long, toxic int"))
    for t in ("You are a worthless idiot. I will kill you!", "I will find you and kill you", "Kill yourself", "I am going to kill you", "Du bist ein Arschloch", "tu es un connard", "eres un gilipollas"):
        assert model.score(t) >= toxicity.TOXIC_AT, t
    for t in ("A nice day.", None, "", "'You idiot', he said", "She said he is not an idiot", "He will not hurt anyone's feelings", "They beat the eggs"):
        assert model.score(t) < toxicity.TOXIC_AT, t
    assert model.score("She said he is not an idiot") < model.score("you idiot")
    got = toxicity.score(edge.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)


TOXIC_CLAUSES = """I will kill you
I am gonna beat you up tomorrow
we will hurt them
go and hang yourself
you are a pathetic loser
Ich werde dich töten
wir werden euch alle verprügeln
ich werde dich morgen noch umbringen
du bist ein Arschloch
Je vais te tuer
nous allons vous égorger
je te tuerai
tu es un connard
voy a matarte
te voy a matar
vamos a golpearlos
te mataré
eres un gilipollas"""
#: Clauses that have words of violence or insults and do no harm.
CLEAN_CLAUSES = """I will not kill you
he said that he will kill you
"I will kill you", he said
she said you are no fool
they beat the eggs
the process will hang
that is not stupid
he is not an idiot
she was called a loser
Ich werde dich nicht töten
er sagte, ich werde dich töten
das ist kein Idiot
die Uhr wird schlagen
Je ne vais pas te tuer
il est interdit de tuer
elle a dit que tu es un idiot
no voy a matarte
nunca te mataré
dijo que te voy a matar
no eres un idiota"""


def test_clauses_in_four_languages():
    model = toxicity.Model()
    wrong = lambda m: ([t for t in TOXIC_CLAUSES.splitlines() if m.score(t) < toxicity.TOXIC_AT], [t for t in CLEAN_CLAUSES.splitlines() if m.score(t) >= toxicity.TOXIC_AT])
    assert wrong(model) == ([], [])
    plain = toxicity.prior_weights()
    blind = toxicity.Model(weights={m: plain[{"insult": "insult-plain", "mild": "mild-plain"}.get(m.split("-")[0], "threat")] for m in plain})
    missed, alarms = wrong(blind)
    assert not missed and len(alarms) >= 6  # without negation and reported speech
    words = toxicity.Model(weights={m: w if m.startswith("insult") else (0.0,) * toxicity.COUNTED for m, w in plain.items()})
    assert len(wrong(words)[0]) >= 12  # insults alone


def test_marks_decide_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity._model(spark, docs, sf)
    held = docs.join(labels.where("toxic is not null"), "doc_id").where(common.fold("doc_id", 3) == 1).select("text", "toxic").collect()
    toxic, clean = ([r["text"] for r in held if r["toxic"] == y] for y in (1, 0))
    at_least = lambda m, texts: sum(m.score(t) >= toxicity.TOXIC_AT for t in texts)
    hits, alarms = at_least(model, toxic), at_least(model, clean)
    print(f"toxic {hits} of {len(toxic)}, alarms {alarms} of {len(clean)}")
    assert hits >= 0.9 * len(toxic) and alarms <= 0.01 * len(clean)
    off = toxicity.Model(model.words, model.stems, {m: (0.0,) * toxicity.COUNTED for m in model.weights}, model.base)
    assert at_least(off, toxic) == 0
    once = toxicity.Model(model.words, model.stems, {m: w[:1] for m, w in model.weights.items()}, model.base)
    assert at_least(once, toxic) < hits


def test_toxicity_learns_stems(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs, labels = [], []
    for i in range(600):
        w = [word() for _ in range(60)]
        y = int(i % 8 == 0)
        if y:
            for k in range(4):
                w[k * 10] = "zorglub" + rng.choice(["an", "er", "ik", "os"])
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(frame.where("doc_id % 3 <> 1"), known.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert all((got[i] >= toxicity.TOXIC_AT) == bool(y) for i, y in labels if i % 3 == 1)


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs.withColumn("_x", F.lit(1)), SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}").drop("_x")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.select(*before.columns[:5]).exceptAll(before.select(*before.columns[:5])).count() == 0
    assert docs.where("n_tokens <> size(ids)").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in whole.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_stages_on_edges(spark, edge):
    import corpus_pipeline

    for frame in (edge, edge.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, frame, SF)
            assert got.count() <= frame.count() and got.columns[:5] == edge.columns, name
