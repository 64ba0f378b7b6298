"""Language-model scores of texts by a hashed maximum-entropy model with class-factored softmax.

Tokens are lower-cased (A-Z) words between white space and an end after each text. Counts of all words are gathered by
shuffle. The ``DICTIONARY`` most frequent words go to every task with their counts, whatever the corpus' size; the
others are joined by shuffle, where no word has more than a bounded share of the rows.

The model has CLASSES x MEMBERS words that it predicts by context (the end among them), in classes of equal size cut from their
neighbours' counts by repeated bisection, and ``BUCKETS`` of other words by their last two letters:

    P(token | context) = P(class | context) * P(word | class, context)    for a predicted word
    P(token | context) = P(bucket | context) * (c + 0.5) / (N_b + 0.5 * (V_b + 1))    for any other, c its count

Features are the word before (bigram), the word before that alone (skip) and both (trigram), hashed to rows of two tables:
of weights for classes and buckets, and, hashed with the class, of weights for its members. Where they are silent the model is the unigram.
Training: ``UPDATES`` updates, each over another part of all training texts (every text is learned from once). Each task takes gradient steps
from the present weights; the changed rows are added up by row, weighted by use, after a shuffle. Weights have a fixed size.

Defined cases: a null text is empty and has one token, the end. Texts without an id are scored, neither held out nor learned
from. Without training texts N and V are 0. Texts are read whole. Repeated rows get equal scores. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import bound_arrow, fold, new_folder, slices, stored, table, tidy

#: Words with their counts that every task holds, at most.
DICTIONARY = 200_000
CLASSES, MEMBERS, BUCKETS = 32, 64, 32
SHORT = CLASSES * MEMBERS
#: Rows of either table of weights; a power of two, up to 2**16.
ROWS = 1 << 14
UPDATES = 4
STEP, MINI = 0.3, 4096
#: A weight's greatest size.
MOST = 10.0
#: Tokens that a task learns from at least, if there are so many: it sends its changed rows, which are bounded in size.
TASK_TOKENS = 2_000_000
#: Columns of a word's counts of neighbours.
NEAR = 128
#: Bytes of text taken at once, and tokens scored at once.
CHARS, TOKENS = 1 << 22, 1 << 12
END = 0

WIDE = CLASSES + BUCKETS
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of the texts, and the text that each belongs to."""
    # a copy, as the kernels read offsets of slices wrongly
    texts = texts.take(pa.array(np.arange(len(texts))))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    some = pc.not_equal(flat, "")
    return flat.filter(some), of[some.to_numpy(zero_copy_only=False)]


def bucket(word: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word[-2:].encode()) % buckets


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text").cast(pa.large_string())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, c): how often each word stands in all texts (text, train) and in the training texts."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, chars=CHARS):
            flat, of = words(_texts(part))
            coded = flat.dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)[of]
            n = np.bincount(at, minlength=len(coded.dictionary))
            c = np.bincount(at[train], minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["word", "n", "c"])

    return docs.select("text", "train").mapInArrow(tidy(run), "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the corpus, and the bounded part of them that every task holds."""

    n_tokens: int
    n_types: int
    #: The dictionary's least count in all texts: rarer words are joined by shuffle.
    least: int
    words: list[str]
    counts: np.ndarray
    #: The word's number among those predicted by context, or -1. The end is number 0.
    rank: np.ndarray
    #: Counts of the predicted words by number, and of each bucket's tokens and types.
    short: np.ndarray
    bucket_tokens: np.ndarray
    bucket_types: np.ndarray

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.n_tokens + 0.5 * (self.n_types + 1)))

    def bucket_norm(self) -> np.ndarray:
        return np.log10(self.bucket_tokens + 0.5 * (self.bucket_types + 1))


def vocabulary(counts: DataFrame, n_texts: int, dictionary: int = DICTIONARY) -> Vocabulary:
    """counts: (word, n, c) as written; n_texts: training texts. Only sums and the dictionary reach the driver."""
    ends = int(n_texts > 0)
    total = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    size = F.floor(F.log2("n") * 8)
    bins = sorted(((r[0], r[1]) for r in counts.groupBy(size.alias("b")).count().collect()), reverse=True)  # 8 for each power of two
    held, least_bin = 0, None
    for b, k in bins:
        if held + k > dictionary:
            break
        held, least_bin = held + k, b
    least = 1 if not bins or least_bin == bins[-1][0] else int(np.ceil(2 ** (least_bin / 8) - 1e-9)) if least_bin is not None else 1 << 62
    rows = counts.where(F.col("n") >= least).select("word", "c").collect()  # at most as many as the dictionary's bound
    rows.sort(key=lambda r: (-r["c"], r["word"]))
    names, c = [r["word"] for r in rows], np.array([r["c"] for r in rows], np.int64)
    rank = np.full(len(names), -1, np.int64)
    k = min(SHORT - 1, int((c > 0).sum()))
    rank[:k] = np.arange(1, k + 1)
    short = np.zeros(SHORT, np.int64)
    short[END], short[1 : k + 1] = n_texts, c[:k]
    by = counts.where("c > 0").groupBy((F.crc32(F.expr("right(word, 2)").cast("binary")) % BUCKETS).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    tokens, types = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in by:
        tokens[r["b"]], types[r["b"]] = r["c"], r["v"]
    for w, n in zip(names[:k], c[:k], strict=True):
        tokens[bucket(w)] -= n
        types[bucket(w)] -= 1
    return Vocabulary((total[0] or 0) + n_texts, total[1] + ends, least, names, c, rank, short, tokens, types)


ENCODED = "rid long, doc_id long, held_out boolean, part int, n_tokens long, n_known long, base double, rest double, ids binary, tail array<string>"


def encoded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """A row for each text (doc_id, text, held_out, train): the numbers of its tokens, sums over its words in the dictionary, and its other words.

    base: the sum of log10(c + 0.5) over the tokens in the dictionary. rest: the same over those of them that no context predicts, less the
    bucket's norm for every token of a bucket. part: the update that learns from it, -1 for none.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    sent = spark.sparkContext.broadcast(voc)  # bounded by DICTIONARY
    local: dict[str, tuple] = {}

    def ready() -> tuple:
        if not local:
            v = sent.value
            local["v"] = (pa.array(v.words, pa.large_string()), v, np.log10(v.counts + 0.5), v.bucket_norm(), float(np.log10(v.short[END] + 0.5)))
        return local["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, v, logs, norms, end_log = ready()
        for part in slices(batches, chars=CHARS):
            n = part.num_rows
            flat, of = words(_texts(part))
            coded = flat.dictionary_encode()
            own, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            where = pc.fill_null(pc.index_in(own, value_set=names), -1).to_numpy(zero_copy_only=False)
            known_word = where >= 0
            rank = np.where(known_word, v.rank[where], -1) if len(v.rank) else np.full(len(own), -1)
            log = np.where(known_word, logs[where], 0.0) if len(logs) else np.zeros(len(own))
            seen = known_word & (v.counts[where] > 0) if len(logs) else known_word
            far = np.flatnonzero(rank < 0)
            kind = np.zeros(len(own), np.int64)
            kind[far] = [bucket(w) for w in own.take(pa.array(far)).to_pylist()]
            number = np.where(rank >= 0, rank, SHORT + kind).astype(np.uint16)
            # the part of P(word | bucket) that is known here: other words' log10(c + 0.5) follows by the join
            rest = np.where(rank < 0, log - norms[kind], 0.0)
            size = np.bincount(of, minlength=n)
            cuts = np.concatenate([[0], np.cumsum(size)])
            ids, gone = number[at], ~known_word[at]
            tails, tail_of = flat.filter(pa.array(gone)), of[gone]
            tail_cuts = np.concatenate([[0], np.cumsum(np.bincount(tail_of, minlength=n))])
            sums = [np.bincount(of, weights=x[at], minlength=n) for x in (log, rest)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("rid"), part.column("doc_id"), part.column("held_out"), part.column("part"),
                    pa.array(size + 1, pa.int64()), pa.array(np.bincount(of, weights=seen[at], minlength=n).astype(np.int64) + int(v.short[END] > 0), pa.int64()),
                    pa.array(sums[0] + end_log), pa.array(sums[1]),
                    pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(tail_cuts, pa.int32()), tails.cast(pa.string())),
                ],
                names=[x.split()[0] for x in ENCODED.split(", ")],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.when(F.col("train"), F.pmod(F.xxhash64("doc_id"), F.lit(UPDATES))).otherwise(-1).cast("int").alias("part"), "text")
    return rows.mapInArrow(tidy(run), ENCODED)


def contexts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, word before, word before that, text) of texts given by their numbers; an end stands before and after each."""
    sizes = np.array([len(b) // 2 for b in blobs], np.int64)
    flat = np.frombuffer(b"".join(b + b"\0\0" for b in blobs), np.uint16).astype(np.int64)
    of = np.repeat(np.arange(len(blobs)), sizes + 1)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(blobs) else np.zeros(0, np.int64)
    one = np.concatenate([[END], flat[:-1]]) if len(flat) else flat
    two = np.concatenate([[END], one[:-1]]) if len(flat) else flat
    one, two = one.copy(), two.copy()
    one[first] = END
    two[first] = END
    after = first[sizes > 0] + 1
    two[after] = END
    return flat, one, two, of


def _hashed(x: np.ndarray, k: int) -> np.ndarray:
    return ((x.astype(np.uint64) + np.uint64(1)) * _ODD[k] >> np.uint64(64 - (ROWS - 1).bit_length())).astype(np.uint16)


class Model:
    """Weights of fixed size: ``wide`` for classes and buckets, ``deep`` for the members of classes, with the scales of each row's steps.

    Weights stay within MOST and biases are logarithms of shares, so exponentials need no shift.
    """

    def __init__(self, voc: Vocabulary, classes: np.ndarray):
        """classes: the predicted words by class and place, -1 where there is none."""
        self.cls, self.slot = np.zeros(SHORT, np.int64), np.zeros(SHORT, np.int64)
        for k, some in enumerate(classes):
            for j, w in enumerate(some):
                if w >= 0:
                    self.cls[w], self.slot[w] = k, j
        mass = np.where(classes >= 0, voc.short[np.maximum(classes, 0)] + 0.5, 0.0)
        wide = np.concatenate([mass.sum(1), voc.bucket_tokens + 0.5 * (voc.bucket_types + 1)])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.deep_bias = np.nan_to_num(np.log(mass / mass.sum(1, keepdims=True)), nan=0.0, neginf=-1e4).astype(np.float32)
            self.wide_bias = np.nan_to_num(np.log(wide / wide.sum()), neginf=-1e4).astype(np.float32)
        self.wide, self.deep = np.zeros((ROWS, WIDE), np.float32), np.zeros((ROWS, MEMBERS), np.float32)
        self.wide_scale, self.deep_scale = np.ones(ROWS, np.float32), np.ones(ROWS, np.float32)

    def copy(self) -> Model:
        out = Model.__new__(Model)
        out.__dict__.update(self.__dict__ | {k: getattr(self, k).copy() for k in ("wide", "deep", "wide_scale", "deep_scale")})
        return out

    def outcome(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class or bucket, place in the class, whether it is predicted)."""
        short = tokens < SHORT
        w = np.where(short, tokens, 0)
        return np.where(short, self.cls[w], CLASSES + tokens - SHORT), self.slot[w], short

    @staticmethod
    def wide_rows(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        return [_hashed(one, 0), _hashed(two, 1), _hashed(one * 65536 + two, 2)]

    @staticmethod
    def deep_rows(one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
        return [_hashed(one * 1024 + cls, 3), _hashed(two * 1024 + cls, 4)]

    @staticmethod
    def logits(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
        z = np.take(weights, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(weights, r, axis=0)
        z += bias
        return z

    @staticmethod
    def _log(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms of the outcomes' probabilities; z is overwritten."""
        own = z[np.arange(len(y)), y].astype(np.float64)
        np.exp(z, out=z)
        return own - np.log(z @ np.ones(z.shape[1], np.float32)).astype(np.float64)

    def log_probs(self, one: np.ndarray, two: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """log10 of the tokens' probabilities; for those of a bucket that of the bucket."""
        y, j, short = self.outcome(tokens)
        out = self._log(self.logits(self.wide, self.wide_rows(one, two), self.wide_bias), y)
        s = np.flatnonzero(short)
        if len(s):
            out[s] += self._log(self.logits(self.deep, self.deep_rows(one[s], two[s], y[s]), np.take(self.deep_bias, y[s], axis=0)), j[s])
        return out / np.log(10)

    def texts(self, blobs: list[bytes]) -> np.ndarray:
        """The sum of ``log_probs`` over each text."""
        out, tokens = np.zeros(len(blobs)), contexts(blobs)
        for a in range(0, len(tokens[0]), TOKENS):
            token, one, two, of = (x[a : a + TOKENS] for x in tokens)
            first = of[0]
            sums = np.bincount(of - first, weights=self.log_probs(one, two, token))
            out[first : first + len(sums)] += sums
        return out

    @staticmethod
    def _step(weights: np.ndarray, scale: np.ndarray, used: np.ndarray, rows: list[np.ndarray], z: np.ndarray, y: np.ndarray) -> None:
        """One gradient step of the log likelihood, the step of a row falling with the squares of its gradients."""
        n = len(y)
        np.exp(z, out=z)
        z *= (-1 / (z @ np.ones(z.shape[1], np.float32)))[:, None]
        z[np.arange(n), y] += 1
        flat = np.concatenate(rows)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        at = flat[start]
        g = np.add.reduceat(np.take(z, order % n, axis=0), start, axis=0)
        scale[at] += np.einsum("ij,ij->i", g, g)
        g *= (STEP / np.sqrt(scale[at]))[:, None]
        g += np.take(weights, at, axis=0)
        weights[at] = np.clip(g, -MOST, MOST, out=g)
        used[at] += np.diff(np.append(start, len(flat)))

    def train(self, blobs: list[bytes], used: tuple[np.ndarray, np.ndarray]) -> None:
        """Steps over the texts' tokens; ``used`` counts how often each row took part."""
        token, one, two, _ = contexts(blobs)
        for a in range(0, len(token), MINI):
            t, p, q = token[a : a + MINI], one[a : a + MINI], two[a : a + MINI]
            y, j, short = self.outcome(t)
            rows = self.wide_rows(p, q)
            self._step(self.wide, self.wide_scale, used[0], rows, self.logits(self.wide, rows, self.wide_bias), y)
            s = np.flatnonzero(short)
            if len(s):
                rows = self.deep_rows(p[s], q[s], y[s])
                self._step(self.deep, self.deep_scale, used[1], rows, self.logits(self.deep, rows, np.take(self.deep_bias, y[s], axis=0)), j[s])


def _added(parts: DataFrame) -> DataFrame:
    """(kind, row, n, delta): per row the deltas' sum weighted by n; rows are dealt by number, and a task holds its rows only."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for kind, row, k, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "row", "n", "delta")), strict=True):
                d = np.frombuffer(blob, np.float32).astype(np.float64) * k
                have = held.get((kind, row))
                if have is None:
                    held[kind, row] = [k, d]
                else:
                    have[0] += k
                    have[1] += d
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([(held[k][1] / max(held[k][0], 1)).astype(np.float32).tobytes() for k in keys], pa.binary())], names=["kind", "row", "n", "delta"])

    return parts.repartition(n, "kind", "row").mapInArrow(tidy(run), "kind int, row int, n long, delta binary")


def _rows(kind: int, n: np.ndarray, delta: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64()), pa.array([delta[i].astype(np.float32).tobytes() for i in at], pa.binary())], names=["kind", "row", "n", "delta"])


def bisected(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Row numbers in ``parts`` groups (a power of two) of sizes that differ by one at most, split along the greatest spread."""
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        out = []
        for g in groups:
            y = x[g] - x[g].mean(0) if len(g) else x[g]
            v = np.ones(x.shape[1])
            v[::2] = -0.5
            for _ in range(20):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) or 1.0
            order = g[np.argsort(y @ v, kind="stable")]
            out += [order[: (len(g) + 1) // 2], order[(len(g) + 1) // 2 :]]
        groups = out
    return groups


def word_classes(enc: DataFrame, tasks: int) -> np.ndarray:
    """Classes of the predicted words by the words around them, over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros((SHORT, 2 * NEAR))
        for b in batches:
            token, one, _, _ = contexts(b.column("ids").to_pylist())
            column = lambda x: np.where(x < SHORT, np.where(x < NEAR // 2, x, NEAR // 2 + x % (NEAR // 4)), 3 * NEAR // 4 + (x - SHORT) % (NEAR // 4))
            for w, other, at in ((token, one, 0), (one, token, NEAR)):
                ok = w < SHORT
                near += np.bincount(w[ok] * 2 * NEAR + at + column(other[ok]), minlength=near.size).reshape(near.shape)
        # plain sums: each row counts once
        yield _rows(0, (near.sum(1) > 0).astype(np.int64), near)

    parts = enc.where("part >= 0").select("ids").coalesce(UPDATES * tasks).mapInArrow(tidy(run), "kind int, row int, n long, delta binary")
    x = np.zeros((SHORT, 2 * NEAR))
    for r in _added(parts).collect():  # SHORT rows at most
        x[r["row"]] = np.frombuffer(r["delta"], np.float32) * r["n"]
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    out = np.full((CLASSES, MEMBERS), -1, np.int64)
    for k, g in enumerate(bisected(x, CLASSES)):
        out[k, : len(g)] = g
    return out


def train(enc: DataFrame, voc: Vocabulary) -> Model:
    """The model, learned from the rows of ``encoded`` that belong to an update."""
    spark = enc.sparkSession
    tasks = max(1, round(voc.n_tokens / UPDATES / TASK_TOKENS))
    model = Model(voc, word_classes(enc, tasks))
    for u in range(UPDATES):
        sent = spark.sparkContext.broadcast(model)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, old = None, sent.value
            used = (np.zeros(ROWS, np.int64), np.zeros(ROWS, np.int64))
            for b in batches:
                for part in slices(iter([b]), "ids", CHARS):
                    now = now or old.copy()
                    now.train(part.column("ids").to_pylist(), used)
            if now is not None:
                yield _rows(0, used[0], np.column_stack([now.wide - old.wide, now.wide_scale - old.wide_scale]))
                yield _rows(1, used[1], np.column_stack([now.deep - old.deep, now.deep_scale - old.deep_scale]))

        parts = enc.where(F.col("part") == u).select("ids").coalesce(tasks).mapInArrow(tidy(run), "kind int, row int, n long, delta binary")
        for r in _added(parts).collect():  # two tables of ROWS rows at most
            delta = np.frombuffer(r["delta"], np.float32)
            weights, scale = ((model.wide, model.wide_scale), (model.deep, model.deep_scale))[r["kind"]]
            weights[r["row"]] += delta[:-1]
            scale[r["row"]] += delta[-1]
        sent.unpersist()
    return model


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text, held_out, train)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    counts = stored(word_counts(docs), "words")
    voc = vocabulary(counts, docs.where("train").count())
    path = new_folder(spark, "encoded")
    encoded(docs, voc).write.partitionBy("part").parquet(path)  # an update reads its part alone
    enc = spark.read.schema(ENCODED).parquet(path)
    model = train(enc, voc)
    sent = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(iter([b]), "ids", CHARS):
                got = sent.value.texts(part.column("ids").to_pylist()) + part.column("rest").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "base")), pa.array(got)], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "got"])

    scored = enc.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "rest", "ids").mapInArrow(tidy(run), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, got double")
    rare = counts.where(F.col("n") < voc.least).select("word", "c")
    tail = enc.select("rid", F.explode("tail").alias("word")).join(rare, "word")
    sums = tail.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("t"), F.count(F.when(F.col("c") > 0, 1)).alias("k"))
    out = scored.join(sums, "rid", "left")
    t = F.coalesce("t", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(voc.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + t - F.col("n_tokens") * F.lit(voc.base_norm)).alias("base_score"), (F.col("got") + t).alias("score"),
    )


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: scores of all documents, learned from the folds other than 1 of 5."""
    part = fold("doc_id", 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(part == 1, F.lit(False)).alias("held_out"), F.coalesce(part != 1, F.lit(False)).alias("train"))
    return score(docs)
