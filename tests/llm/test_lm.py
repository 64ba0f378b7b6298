"""Language-model scores: counts and base against plain Python, probabilities that sum to one, held-out gain, plain scoring."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from doclens.llm import lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def write(spark, rows, path):
    spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, rid string, train int").repartition(3).write.parquet(f"{path}/documents.parquet")


def corpus():
    rnd = random.Random(1)
    heads = {w: [rnd.choice("abcdefgh") + str(rnd.randrange(60)) for _ in range(3)] for w in range(40)}
    rows = []
    for k in range(400):
        w, out = rnd.randrange(40), []
        for _ in range(rnd.randrange(1, 60)):
            x = rnd.choice(heads[w])
            out.append(x)
            w = zlib.crc32(x.encode()) % 40
        rows.append((k, " ".join(out)))
    rows += [(500, None), (501, ""), (502, " \t\n\x0b\x0c\r "), (503, "É É é\xa0É a\x1cb"), (504, "rare" * 30_000 + " Rare"), (None, "a1 b2"), (3, rows[3][1]), (3, rows[3][1]), (505, "日本 \U0001f600 ẞ")]
    rows.append((506, " ".join(f"w{k}" for k in range(5000))))
    return rows


def test_counts_and_base_equal_plain_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 300)
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (300,))
    rows = corpus()
    write(spark, rows, tmp_path)
    count = Counter()
    for k, text in rows:
        if k is not None and zlib.crc32(str(k).encode()) % 5 != 1:
            count.update(tokens(text))
    n, v = sum(count.values()), len(count)
    want = []
    for k, text in rows:
        t = tokens(text)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((k is not None and zlib.crc32(str(k).encode()) % 5 == 1, len(t), sum(count[w] > 0 for w in t), n, round(base, 6), k))
    got = lm.lm_scores(spark, str(tmp_path)).collect()
    assert sorted(((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.doc_id) for r in got), key=str) == sorted(want, key=str)
    own = [r.score for r in got if r.doc_id == 3]
    assert len(own) == 3 and max(own) - min(own) < 1e-9
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # by far: followers are learned


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(k, t, k % 5 == 0, k % 5 != 0) for k, t in corpus() if k is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, train boolean")
    counts = lm.word_counts(docs).cache()
    voc = lm.vocabulary(counts, docs.where("train").count(), dictionary=400)
    enc = lm.encoded(docs, voc).cache()
    return rows, voc, lm.train(enc, voc), {r["word"]: r["c"] for r in counts.collect()}


def test_probabilities_of_all_tokens_sum_to_one(learned):
    _, voc, model, _ = learned
    every = np.concatenate([np.arange(lm.SHORT), lm.SHORT + np.arange(lm.BUCKETS)])
    for one, two in [(0, 0), (1, 5), (7, lm.SHORT + 3), (lm.SHORT + 31, 2)]:
        p = 10 ** model.log_probs(np.full(len(every), one), np.full(len(every), two), every)
        assert abs(p.sum() - 1) < 1e-5
    # in a bucket: all its words, and one for those never seen
    assert np.allclose((voc.bucket_tokens + 0.5 * voc.bucket_types + 0.5) / 10 ** voc.bucket_norm(), 1)


def test_scores_equal_a_plain_walk_over_the_tokens(spark, learned):
    rows, voc, model, count = learned
    rank = {w: int(r) for w, r in zip(voc.words, voc.rank, strict=True) if r >= 0}
    norm = voc.bucket_norm()
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, train boolean")
    enc = {r["doc_id"]: r for r in lm.encoded(docs, voc).collect()}
    for k, text, *_ in rows[::37] + rows[-8:]:
        one = two = lm.END
        want = 0.0
        for w in tokens(text):
            b = lm.bucket(w) if w else 0
            token = lm.END if w is None else rank.get(w, lm.SHORT + b)
            want += model.log_probs(np.array([one]), np.array([two]), np.array([token]))[0]
            if token >= lm.SHORT:
                want += math.log10(count.get(w, 0) + 0.5) - norm[b]
            one, two = token, one
        r = enc[k]
        got = model.texts([r["ids"]])[0] + r["rest"] + sum(math.log10(count[w] + 0.5) for w in r["tail"])
        assert abs(got - want) < 1e-3 * max(1, abs(want)) * 0.01


def test_contexts_do_not_cross_texts():
    blobs = [np.array(x, np.uint16).tobytes() for x in ([5, 6, 7], [], [8], [9, 3])]
    token, one, two, of = lm.contexts(blobs)
    assert token.tolist() == [5, 6, 7, 0, 0, 8, 0, 9, 3, 0]
    assert one.tolist() == [0, 5, 6, 7, 0, 0, 8, 0, 9, 3]
    assert two.tolist() == [0, 0, 5, 6, 0, 0, 0, 0, 0, 9]
    assert of.tolist() == [0, 0, 0, 0, 1, 2, 2, 3, 3, 3]


def test_words_of_slices():
    texts = pa.array(["x" * 50, "A bÉ\x0bC", None, " d "], pa.large_string()).slice(1)
    flat, of = lm.words(texts)
    assert flat.to_pylist() == ["a", "bÉ", "c", "d"] and of.tolist() == [0, 0, 0, 2]


def test_classes_have_equal_sizes_and_split_what_differs():
    x = np.zeros((64, 8))
    x[:32, 0], x[32:, 1] = 1, 1
    groups = lm.bisected(x, 4)
    assert [len(g) for g in groups] == [16] * 4 and all((g < 32).all() or (g >= 32).all() for g in groups)


def test_empty_table_and_no_training_texts(spark, tmp_path):
    write(spark, [], tmp_path / "a")
    assert lm.lm_scores(spark, str(tmp_path / "a")).count() == 0
    docs = spark.createDataFrame([(1, "a b", True, False)], "doc_id long, text string, held_out boolean, train boolean")
    r = lm.score(docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0 and r.score < 0
