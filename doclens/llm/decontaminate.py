"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A seed is two successive words of a test item that a document has side by side or with one word between. A local alignment
of likeness 0.5 or more with an item of n words, n >= LEAST_WORDS, has (n - 3) / 3 of them at least: let its steps from one match to the next
be c seeds, a steps to the next item word over two or more other words (cost 2 at least), and b over item words (cost 1
at least, as each takes two places of the item). Then its score is at most 2c + b + 2, and n >= 1 + a + 2b + c; with a score of
n or more, c >= a + b - 1, so 3c + 3 >= n. The seeds of an item of fewer words are its words, and two of them are needed, as a lone
match is no likeness (but for an item of one word).

Of an item's m seeds of which r are needed, the m - r + 1 rarest are looked for first: a document that has r has one of these. Rare is
by occurrences in all documents. In documents that have a rare seed, all seeds are counted; one with r of an item's seeds is
aligned with the item, word by word, around all places that the seeds point to; the local alignment's score, divided by the item's
score with itself, is the item's likeness. So no item at AT_LEAST or more is missed, however often its words stand in the corpus. A
document is contaminated if that is AT_LEAST or more. Below it, likeness is given for items of LEAST_WORDS or more of which the
document has three successive words, aligned around these. An item without a word identifies nothing.

Items whose number of words is within MOST_ITEM_WORDS are sent to all executors, and documents are read twice where they lie, once
to count seeds; beyond it seeds are counted and joined by shuffle. Both ways give the same rows. Null texts are empty. Documents without a candidate have score 0 and no
item. Ties go to the least item id. start_word and end_word bound the best item's alignment. Texts are read whole; repeated
rows give repeated results. Rows with a null id are treated as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_type

from doclens.llm.common import bound_arrow, free, slices, table, tidy, without
from doclens.llm.shingles import mix, word_hashes

N = 3
LEAST_WORDS = 5
#: Tells hashes of single words from those of pairs.
SINGLE = np.uint64(0xA0761D6478BD642F)
# The bound on seeds holds for these values.
MATCH, MISMATCH, GAP = 2, 1, 1
AT_LEAST = 0.5
#: 16 MB of hashes.
MOST_ITEM_WORDS = 2_000_000
#: Entries of items' seeds looked at together; one document may have more.
MOST_ENTRIES = 1 << 22
#: Cells of a row of the alignments made together; one alignment may have more.
MOST_CELLS = 1 << 15


def grams(doc: np.ndarray, h: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hash, whether it lies in one text) at each word but the last n - 1."""
    if len(h) < n:
        return h[:0], np.zeros(0, bool)
    m = len(h) - n + 1
    run = np.zeros(m, np.uint64)
    for k in range(n):
        run = run * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + m]
    return mix(run), doc[:m] == doc[n - 1 :]


def pairs(doc: np.ndarray, h: np.ndarray, gaps: tuple[int, ...] = (1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first) of all two words of a text that are so many places apart."""
    out = []
    for k in gaps:
        at = np.flatnonzero(doc[:-k] == doc[k:])
        out.append((mix(h[at] * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + k]), at))
    return np.concatenate([h[:0], *(g for g, _ in out)]), np.concatenate([np.zeros(0, np.int64), *(at for _, at in out)])


def seed_grams(doc: np.ndarray, h: np.ndarray, gaps: tuple[int, ...], singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the pairs of words and, if asked, of the single words."""
    gram, at = pairs(doc, h, gaps)
    return (np.concatenate([gram, mix(h + SINGLE)]), np.concatenate([at, np.arange(len(h))])) if singles else (gram, at)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (best score, place in ``words`` where it starts, place after its end)."""
    places = np.arange(len(words) + 1)
    row, start, ramp = np.zeros(len(words) + 1, np.int64), places, GAP * places
    best, first, end = 0, 0, 0
    for w in item:
        step, origin = np.zeros_like(row), places.copy()
        step[1:] = row[:-1] + np.where(words == w, MATCH, -MISMATCH)
        origin[1:] = start[:-1]
        down = row - GAP > step
        step, origin = np.where(down, row - GAP, step), np.where(down, start, origin)
        step, origin = np.where(step > 0, step, 0), np.where(step > 0, origin, places)
        lifted = step + ramp
        row = np.maximum.accumulate(lifted)  # gaps in the item
        start = origin[np.maximum.accumulate(np.where(lifted == row, places, 0))]
        row = row - ramp
        at = int(row.argmax())
        if row[at] > best:
            best, first, end = int(row[at]), int(start[at]), at
    return best, first, end


def align_all(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Score and end by ``align`` of each item and text, many at a time; 0 and 1 stand for no word."""
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    n, width = np.array([len(x) for x in items], np.int64), np.array([len(x) for x in texts], np.int64)
    order = np.lexsort((n, np.ceil(np.log2(width + 1))))
    a = 0
    while a < len(order):
        b, room = a + 1, width[order[a]]
        while b < len(order) and max(room, width[order[b]]) * (b + 1 - a) <= MOST_CELLS:
            room = max(room, width[order[b]])
            b += 1
        part = order[a:b]
        most = int(n[part].max())
        kind = np.int16 if room + (MATCH + 1) * most < 1 << 14 else np.int64
        own, words = np.ones((most, b - a), np.uint64), np.zeros((room, b - a), np.uint64)
        for k, r in enumerate(part):
            own[: n[r], k], words[: width[r], k] = items[r], texts[r]
        row, step = np.zeros((room + 1, b - a), kind), np.zeros((room + 1, b - a), kind)
        ramp = (GAP * np.arange(room + 1)).astype(kind)[:, None]
        top, last = np.zeros(b - a, kind), np.zeros(b - a, np.int64)
        for w in own:
            step[0] = 0
            np.multiply(words == w, kind(MATCH + MISMATCH), out=step[1:])
            step[1:] += row[:-1]
            step[1:] -= kind(MISMATCH)
            row -= kind(GAP)
            np.maximum(step, row, out=step)
            np.maximum(step, kind(0), out=step)
            step += ramp
            np.maximum.accumulate(step, axis=0, out=step)
            step -= ramp
            row, step = step, row
            now = row.max(axis=0)
            up = np.flatnonzero(now > top)
            if len(up):
                top[up], last[up] = now[up], row[:, up].argmax(axis=0)
        best[part], end[part] = top, last
        a = b
    return best, end


class Seeds:
    """N-grams of the items: which items have each, how often, and where."""

    def __init__(self, own: list[np.ndarray]):
        flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        order = np.lexsort((item, flat))
        self.all, self.item = flat[order], item[order]
        self.known, first = np.unique(self.all, return_index=True)
        self.first = np.append(first, len(self.all))
        # most n-grams of a text are dropped by their hash's upper bits
        bits = min(24, max(10, (16 * len(self.known)).bit_length()))
        self.shift, self.mask = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.mask[self.known >> self.shift] = True
        places = [np.searchsorted(self.known, g) for g in own]
        self.sorted = [(np.sort(k), np.argsort(k, kind="stable")) for k in places]

    def hits(self, doc: np.ndarray, gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place in ``known``, place in the words) of the n-grams that an item has, by document."""
        if not len(self.known):
            return doc[:0], at[:0], at[:0]
        some = np.flatnonzero(self.mask[gram >> self.shift])
        where = np.minimum(np.searchsorted(self.known, gram[some]), len(self.known) - 1)
        same = self.known[where] == gram[some]
        some, where = some[same], where[same]
        order = np.argsort(doc[some], kind="stable")
        some = some[order]
        return doc[some], where[order], at[some]

    def counts(self, doc: np.ndarray, known: np.ndarray, n_items: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, item's places whose n-gram the document has), documents in order, a few at a time."""
        if not len(doc):
            return
        key = np.unique(doc * len(self.known) + known)
        d, g = key // len(self.known), key % len(self.known)
        size = self.first[g + 1] - self.first[g]
        part = np.cumsum(size) // MOST_ENTRIES
        new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        starts = new[np.concatenate([[True], part[new[1:]] != part[new[:-1]]])]
        for a, b in zip(starts, np.append(starts[1:], len(d)), strict=True):
            n = size[a:b]
            entry = np.arange(n.sum()) + np.repeat(self.first[g[a:b]] - np.cumsum(n) + n, n)
            both, often = np.unique(np.repeat(d[a:b], n) * n_items + self.item[entry], return_counts=True)
            yield both // n_items, both % n_items, often

    def shifts(self, i: int, known: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The item's supposed first places in a document, from its hits."""
        own, place = self.sorted[i]
        low, high = np.searchsorted(own, known), np.searchsorted(own, known, side="right")
        some = np.flatnonzero(high > low)
        n = high[some] - low[some]
        entry = np.arange(n.sum()) + np.repeat(low[some] - np.cumsum(n) + n, n)
        return np.unique(np.repeat(at[some], n) - place[entry])


class Items:
    """Test items as word hashes, with their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        doc, h, _, _ = word_hashes([t or "" for t in texts])
        ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
        rows = [(i, h[a:b]) for i, a, b in zip(ids, np.concatenate([[0], ends]), ends, strict=False) if b > a and i is not None] if len(texts) else []
        rows.sort(key=lambda r: r[0])
        self.ids = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.singles = bool((sizes < LEAST_WORDS).any())
        own = [(np.zeros(len(w), np.int64), w) for w in self.words]
        self.seeds = Seeds([pairs(d, w, (1,))[0] if len(w) >= LEAST_WORDS else mix(w + SINGLE) for d, w in own])
        self.runs = Seeds([grams(d, w)[0] if len(w) >= LEAST_WORDS else w[:0] for d, w in own])
        self.least = np.where(sizes >= LEAST_WORDS, np.maximum(1, -(-(sizes - 3) // 3)), np.minimum(2, sizes))
        self.rank(np.zeros(len(self.seeds.known), np.int64))

    def count(self, texts: list[str]) -> np.ndarray:
        """Occurrences of each known seed in the texts."""
        doc, h, _, _ = word_hashes(texts)
        gram, at = seed_grams(doc, h, (1, 2), self.singles)
        return np.bincount(self.seeds.hits(doc[at], gram, at)[1], minlength=len(self.seeds.known))

    def rank(self, often: np.ndarray) -> None:
        """Take each item's rarest seeds of which a document has one if it has as many as it needs; any numbers are right, true ones fast."""
        own = [(k[np.lexsort((k, often[k]))], r) for (k, _), r in zip(self.seeds.sorted, self.least.tolist(), strict=True)]
        self.rare = Seeds([self.seeds.known[k[: len(k) - r + 1]] for k, r in own])

    def windows(self, i: int, size: int, shift: np.ndarray) -> list[tuple[int, int]]:
        """Parts of a document of ``size`` words to align with item i; shift: its supposed first places, ascending."""
        n = len(self.words[i])
        cut = np.flatnonzero(np.diff(shift) > 3 * n + 1)  # at AT_LEAST, n words at most are inserted
        return [(max(0, a - n), min(size, b + 2 * n + 1)) for a, b in zip(shift[np.append(0, cut + 1)].tolist(), shift[np.append(cut, -1)].tolist(), strict=True)]

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text, item's place, likeness, items at AT_LEAST, start, end in words) of the texts that have candidates."""
        if not self.ids:
            return
        doc, h, _, _ = word_hashes(texts)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        many, n = set(), len(self.ids)
        gram, at = seed_grams(doc, h, (1, 2), self.singles)
        own = doc[at]
        has = np.zeros(len(texts), bool)
        has[self.rare.hits(own, gram, at)[0]] = True
        some = has[own]
        near = self.seeds.hits(own[some], gram[some], at[some])
        for d, i, often in self.seeds.counts(*near[:2], n):
            some = often >= self.least[i]
            many.update((d[some] * n + i[some]).tolist())
        gram, whole = grams(doc, h)
        at = np.flatnonzero(whole)
        run = self.runs.hits(doc[at], gram[at], at)
        runs = {k for d, i, _ in self.runs.counts(*run[:2], n) for k in (d * n + i).tolist()}
        parts: list[tuple[int, int, int, int]] = []
        for d, i in (divmod(k, n) for k in sorted(many | runs)):
            seeds, (own, known, at) = (self.seeds, near) if d * n + i in many else (self.runs, run)
            a, b = np.searchsorted(own, (d, d + 1))
            parts += [(d, i, *w) for w in self.windows(i, int(cut[d + 1] - cut[d]), seeds.shifts(i, known[a:b], at[a:b] - cut[d]))]
        score, ends = align_all([self.words[i] for _, i, _, _ in parts], [h[cut[d] + a : cut[d] + b] for d, _, a, b in parts])
        scored = [(d, i, int(x), a, b, a + int(e)) for (d, i, a, b), x, e in zip(parts, score, ends, strict=True)]
        scored = [p for p in scored if len(self.words[p[1]]) >= LEAST_WORDS or self.holds(p[1], p[2])]
        scored.sort(key=lambda p: p[:2])
        for d, own in groupby(scored, lambda p: p[0]):
            best, count = (-1, 0.0, -1, -1, -1), 0
            for i, same in groupby(own, lambda p: p[1]):
                _, _, top, low, high, end = max(same, key=lambda p: p[2])  # the first of equal ones
                like = top / (MATCH * len(self.words[i]))
                count += like >= AT_LEAST
                if like > best[1]:
                    best = (i, like, low, high, end)
            if best[0] >= 0:
                i, like, low, high, _ = best
                _, start, end = align(self.words[i], h[cut[d] + low : cut[d] + high])
                yield d, i, like, count, low + start, low + end

    def holds(self, i: int, score: int) -> bool:
        """Whether a score is likeness at AT_LEAST: not of a lone match, but for an item of one word."""
        n = len(self.words[i])
        return score >= AT_LEAST * MATCH * n and (n == 1 or score > MATCH)


#: The item's id has the type that it has in the items.
COLUMNS = [("contaminated", T.BooleanType()), ("item_id", None), ("score", T.DoubleType()), ("n_items", T.LongType()), ("start_word", T.LongType()), ("end_word", T.LongType())]


def screen(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", prefix: str = "", most_words: int = MOST_ITEM_WORDS) -> DataFrame:
    """Append contaminated, item_id, score, n_items, start_word and end_word (each with ``prefix``) to every row.

    They take the place of input columns of those names.
    """
    names = [prefix + c for c, _ in COLUMNS]
    docs = without(docs, *names)
    spark = docs.sparkSession
    bound_arrow(spark)
    tests = items.select(F.col(item_key).alias("id"), F.col(item_text).alias("text")).where("id is not null").distinct()
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), *(T.StructField(n, t or tests.schema["id"].dataType) for n, (_, t) in zip(names, COLUMNS, strict=True))])
    kinds = [to_arrow_type(f.dataType) for f in schema[-len(names) :]]
    if size > 2 * most_words:  # a word has two characters at least, with its space
        return _screen_by_join(docs, tests, text, names, schema)
    rows = tests.collect()  # bounded by the check above
    own = Items([r["id"] for r in rows], [r["text"] for r in rows])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, often = plain.value, None
        for part in slices(batches, "text"):
            more = tests.count([t or "" for t in part.column("text").to_pylist()])
            often = more if often is None else often + more
        if often is not None:
            some = np.flatnonzero(often)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(often[some])], names=["seed", "n"])

    if own.ids:
        plain = spark.sparkContext.broadcast(own)
        often = np.zeros(len(own.seeds.known), np.int64)
        counted = docs.select(F.col(text).alias("text")).mapInArrow(tidy(count), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        for r in counted.collect():  # two for each item word at most, bounded as the items are
            often[r["seed"]] = r["n"]
        own.rank(often)
    sent = spark.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for part in slices(batches, text):
            found: list[tuple] = [(False, None, 0.0, 0, None, None)] * part.num_rows
            for k, i, like, n, s, e in tests.find([t or "" for t in part.column(text).to_pylist()]):
                found[k] = (like >= AT_LEAST, tests.ids[i], like, n, s, e)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds))], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def _screen_by_join(docs: DataFrame, tests: DataFrame, text: str, names: list[str], schema: T.StructType) -> DataFrame:
    """The same for items of any number: seeds are counted and joined by shuffle, and a pair of row and item is aligned at a time.

    An item brings its rarest seeds and its runs of three words. A row is known by a hash of its text; rows of equal text share the result.
    """
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))

    def cut(batches: Iterator[pa.RecordBatch], gaps: tuple[int, ...], singles: bool) -> Iterator[pa.RecordBatch]:
        """Seeds (kind 2, single words 1) and runs (kind 3); ``words`` is the text's number of words."""
        for part in slices(batches, "text"):
            doc, h, _, _ = word_hashes([t or "" for t in part.column("text").to_pylist()])
            sizes = np.bincount(doc, minlength=part.num_rows)
            run, whole = grams(doc, h)
            found = [(2, *pairs(doc, h, gaps)), (3, mix(run[whole] + np.uint64(N)), np.flatnonzero(whole))]
            for kind, own, at in [*found, (1, mix(h + SINGLE), np.arange(len(h)))] if singles else found:
                for a in range(0, len(at), 200_000):
                    d = doc[at[a : a + 200_000]]
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(d)), pa.array(own[a : a + 200_000].view(np.int64)), pa.array(sizes[d].astype(np.int32)), pa.array(np.full(len(d), kind, np.int32))], names=["key", "gram", "words", "kind"])

    id_type = tests.schema["id"].dataType
    id_kind = to_arrow_type(id_type)
    form = T._parse_datatype_string("key long, gram long, words int, kind int")
    item_form = T.StructType([T.StructField("key", id_type), *form[1:]])
    every = tests.select(F.col("id").alias("key"), "text").mapInArrow(lambda b: cut(b, (1,), True), item_form).where(f"(words < {LEAST_WORDS}) = (kind = 1)").withColumnRenamed("key", "id")
    singles = not every.where("kind = 1").isEmpty()
    texts = docs.select(th.alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    doc_grams = texts.mapInArrow(tidy(lambda b: cut(b, (1, 2), singles)), form)
    often = doc_grams.groupBy("gram").agg(F.count("*").alias("n")).join(every.select("gram").distinct(), "gram", "left_semi")
    least = F.when(F.col("words") >= LEAST_WORDS, F.greatest(F.lit(1), F.ceil((F.col("words") - 3) / 3))).otherwise(F.least(F.lit(2), F.col("words")))
    order = W.partitionBy("id")
    ranked = every.where("kind < 3").join(often, "gram", "left").select("id", "gram", least.alias("r"), F.count("*").over(order).alias("m"), F.row_number().over(order.orderBy(F.coalesce("n", F.lit(0)), "gram")).alias("at"))
    item_grams = ranked.where("at <= m - r + 1").select("id", "gram").unionByName(every.where("kind = 3").select("id", "gram")).distinct()
    hits = doc_grams.select("key", "gram").distinct().join(item_grams, "gram").select("key", "id").distinct()
    near = hits.join(texts, "key").join(tests.select("id", F.col("text").alias("item")), "id").select("key", "id", "text", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = [(r["key"], r["id"], *f[2:]) for r in part.to_pylist() for f in Items([r["id"]], [r["item"]]).find([r["text"] or ""])]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate((pa.int64(), id_kind, pa.float64(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "id", "score", "n", "s", "e"])

    out_form = T.StructType([form["key"], T.StructField("id", id_type), *T._parse_datatype_string("score double, n long, s long, e long")])
    scored = near.mapInArrow(tidy(run), out_form).where("score > 0")
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("score"), "id", "s", "e")).alias("b"), F.sum("n").alias("n"))
    name = free(docs, "_key")
    own = docs.withColumn(name, th)
    joined = own.join(best, own[name] == best["key"], "left")
    b = best["b"]
    values = [F.coalesce(-b["score"] >= AT_LEAST, F.lit(False)), b["id"], F.coalesce(-b["score"], F.lit(0.0)), F.coalesce(best["n"], F.lit(0).cast("long")), b["s"], b["e"]]
    return joined.select(*(own[c] for c in docs.columns), *(v.alias(n) for v, n in zip(values, names, strict=True)))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: whether each document holds a benchmark item, which, and how like it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return screen(docs, table(spark, sf_dir, "benchmark")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    prefix = free(docs, "_decon_")
    return screen(docs, table(spark, sf_dir, "benchmark"), prefix=prefix).where(~F.col(f"{prefix}contaminated")).select(*docs.columns)
