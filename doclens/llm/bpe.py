"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tree's root holds the lowest rank, leftmost first; a merge changes three leaves at most and each
change climbs to the root, until the root holds no rank. The trees of all words of a slice that are not
remembered grow side by side, as rows of arrays. Words are remembered by each worker in a cache bounded in
bytes, as a word's ids depend on the word alone.

Input: a frame with the text column. Null and empty texts give no ids and an empty decoded text. Texts
are never cut. Repeated rows give repeated results; other columns pass through unchanged.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.common import bound_arrow, slices, table, tidy, without

NO_PAIR = 1 << 62
#: Bytes, about, of each generation of words and chunks that a worker remembers; when full, the older one goes. (A chunk is
#: what stands between white space.) A longer chunk or word is not remembered.
CACHE_BYTES, CACHED_CHARS = 56 << 20, 64
#: Bytes of an entry beside its characters: the key, the ids and the decoded text as objects.
ENTRY_BYTES = 280
#: Leaves of a tree in a forest, and words of a forest at most; a word of more symbols than fit has a tree of its own.
WIDTHS, MOST_WORDS = (8, 16, 32, 64), 16_384
#: In a forest: no pair, no symbol (beside a word's ends), and the bits of a key that hold the position, below the rank.
NO_KEY, NO_ID, PLACE = np.int32(2**31 - 1), np.int32(2**30), 6
#: The Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


CONTROLS = re.compile("[\x1c-\x1f]")
WHITE = re.compile(f"[{SPACES}]+")


class PairTree:
    """Segment tree of keys ``rank << 32 | position``; its root is the leftmost pair of lowest rank."""

    def __init__(self, keys: list[int]):
        self.width = width = 1 << max(0, (len(keys) - 1).bit_length())
        level = keys + [NO_PAIR] * (width - len(keys))
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        self.node = [NO_PAIR]
        for level in reversed(levels):
            self.node += level

    def root(self) -> int:
        return self.node[1]

    def put(self, at: int, key: int) -> None:
        node, i = self.node, at + self.width
        node[i] = key
        while i > 1:
            other = node[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if node[i] == key:
                return
            node[i] = key


def merged(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply ``merges`` ((left, right) to (rank, new id)) to the symbols of one word."""
    n = len(ids)
    if n < 2:
        return ids
    find = merges.get
    pairs = [find(p) for p in zip(ids, ids[1:], strict=False)]
    keys = [NO_PAIR if p is None else p[0] << 32 | i for i, p in enumerate(pairs)]
    tree = PairTree(keys)
    node, put = tree.node, tree.put
    if node[1] >= NO_PAIR:
        return ids
    ids = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (key := node[1]) < NO_PAIR:
        i = key & 0xFFFFFFFF
        j = after[i]
        ids[i] = new = find((ids[i], ids[j]))[1]
        ids[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NO_PAIR)
        if k < n:
            before[k] = i
            pair = find((new, ids[k]))
            put(i, NO_PAIR if pair is None else pair[0] << 32 | i)
        else:
            put(i, NO_PAIR)
        if (h := before[i]) >= 0:
            pair = find((ids[h], new))
            put(h, NO_PAIR if pair is None else pair[0] << 32 | h)
    return [x for x in ids if x >= 0]


class Ranks:
    """Ranks of many pairs at once, and by rank the ids that the merges make."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        if len(merges) >> (31 - PLACE):
            raise ValueError(f"more than {1 << (31 - PLACE)} merges")
        left_right = np.array(list(merges), np.int64).reshape(-1, 2)
        rank_new = np.array(list(merges.values()), np.int32).reshape(-1, 2)
        keys = left_right[:, 0] << 32 | left_right[:, 1]
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(rank_new[order, 0], NO_KEY)
        self.made = np.zeros(rank_new[:, 0].max(initial=0) + 1, np.int32)
        self.made[rank_new[:, 0]] = rank_new[:, 1]

    def keyed(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``rank << PLACE | place`` of each pair, or ``NO_KEY``."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at] << PLACE | place, NO_KEY).astype(np.int32)


def merged_all(ids: np.ndarray, sizes: np.ndarray, width: int, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """``merged`` for many words of ``width - 2`` symbols at most, given and returned one after the other with their sizes.

    Row w of ``node`` is the tree of word w, its root at 1 and its leaves from ``width``; symbols stand from 1 on. Each round merges, in every
    word that has one, the leftmost pair of lowest rank.
    """
    m = len(sizes)
    row = np.repeat(np.arange(m), sizes)
    place = np.arange(1, len(ids) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbol = np.full(m * width, NO_ID, np.int32)
    symbol[row * width + place] = ids
    node = np.full((m, 2 * width), NO_KEY, np.int32)
    inner = np.flatnonzero(row[1:] == row[:-1])
    node[row[inner], width + place[inner]] = ranks.keyed(ids[inner], ids[inner + 1], place[inner])
    half = width // 2
    while half:
        node[:, half : 2 * half] = np.minimum(node[:, 2 * half : 4 * half : 2], node[:, 2 * half + 1 : 4 * half : 2])
        half //= 2
    node = node.ravel()
    after, before = np.arange(1, m * width + 1), np.arange(-1, m * width - 1)
    tree = np.arange(m) * 2 * width
    while True:
        key = node[tree + 1]
        on = key < NO_KEY
        tree, key = tree[on], key[on]
        if not len(tree):
            break
        base = tree >> 1
        i = base + (key & (1 << PLACE) - 1)
        j, h = after[i], before[i]
        k = after[j]
        new = ranks.made[key >> PLACE]
        symbol[i], symbol[j] = new, -1
        after[i], before[k] = k, i
        at = np.concatenate([h, i, j]) - np.tile(base, 3)
        trees = np.tile(tree, 3)
        put = np.full(len(at), NO_KEY, np.int32)
        n = 2 * len(tree)
        put[:n] = ranks.keyed(np.concatenate([symbol[h], new]), np.concatenate([new, symbol[k]]), at[:n])
        at += width
        node[trees + at] = put
        for _ in range(width.bit_length() - 1):
            at >>= 1
            two = trees + 2 * at
            node[trees + at] = np.minimum(node[two], node[two + 1])
    left = (symbol >= 0) & (symbol < NO_ID)
    return symbol[left], left.reshape(m, width).sum(1)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(1)
def _classes() -> tuple[str, str]:
    """Bracket contents of the letters and of the numbers, which ``re`` does not name."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in runs:
            own = runs[kind]
            if own and own[-1][1] == c - 1:
                own[-1][1] = c
            else:
                own.append([c, c])
    return tuple("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs[k]) for k in "LN")


class Codec:
    """Encoder and decoder for one tokenizer file of the word-end kind (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["unk_token"] or not model["end_of_word_suffix"]:
            raise ValueError("not a word-end BPE file with NFC, white-space and lower-case normalisation")
        self.vocab: dict[str, int] = model["vocab"]
        self.words = {i: w for w, i in self.vocab.items()}
        self.end = model["end_of_word_suffix"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.words |= {i: w for w, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters, numbers = _classes()
        self.pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")
        self.ranks = Ranks(self.merges)
        #: Ids of the 256 bytes, and of those that end a word; -1: not in the vocabulary.
        letters = [c for _, c in sorted(byte_letters().items())]
        self.byte_ids, self.end_ids = (np.array([self.vocab.get(c + end, -1) for c in letters], np.int32) for end in ("", self.end))
        # no chunk holds a space
        self.fixed = {" " + c: (np.int32(i).tobytes(), c) for c, i in self.special.items()}
        self.new: dict[str, tuple[bytes, str]] = dict(self.fixed)
        self.old: dict[str, tuple[bytes, str]] = {}
        self.long: list[str] = []
        self.room = CACHE_BYTES

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() would look at its neighbours
                return "".join(c.lower() for c in text)
        return text.lower()

    def keep(self, key: str, got: tuple[bytes, str]) -> None:
        self.new[key] = got
        self.room -= ENTRY_BYTES + len(key) + len(got[0]) + len(got[1])
        if len(key) > CACHED_CHARS:
            self.long.append(key)

    def turn(self) -> None:
        """Forget what is too long, and the older generation when the newer one is full."""
        for key in self.long:
            self.new.pop(key, None)
        self.long = []
        if self.room < 0:
            self.old, self.new, self.room = self.new, dict(self.fixed), CACHE_BYTES

    def learn_words(self, words: list[str]) -> None:
        for a in range(0, len(words), MOST_WORDS):
            own = words[a : a + MOST_WORDS]
            raw = [w.encode("utf-8", "surrogatepass") for w in own]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(raw), np.uint8)
            ids = self.byte_ids[data]
            ids[ends - 1] = self.end_ids[data[ends - 1]]
            if not (known := ids >= 0).all():
                sizes, ids = np.add.reduceat(known, ends - sizes, dtype=np.int64), ids[known]
            row_sizes, low = np.repeat(sizes, sizes), 0
            for width in WIDTHS:
                some = np.flatnonzero((sizes >= low) & (sizes <= width - 2))
                if len(some):
                    done, counts = merged_all(ids[(row_sizes >= low) & (row_sizes <= width - 2)], sizes[some], width, self.ranks)
                    self.keep_all([own[x] for x in some.tolist()], done, counts)
                low = width - 1
            ends = np.cumsum(sizes)
            for x in np.flatnonzero(sizes >= low).tolist():
                done = np.array(merged(ids[ends[x] - sizes[x] : ends[x]].tolist(), self.merges), np.int32)
                self.keep_all([own[x]], done, np.array([len(done)]))

    def keep_all(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember the words' ids (as int32 bytes) and decoded texts. Without a decoder in the file tokens are joined by one space."""
        data, tokens, a = ids.astype(np.int32).tobytes(), list(map(self.words.__getitem__, ids.tolist())), 0
        for word, b in zip(words, np.cumsum(counts).tolist(), strict=True):
            self.keep(word, (data[4 * a : 4 * b], " ".join(tokens[a:b])))
            a = b

    def unknown(self, keys: Iterable[str]) -> list[str]:
        """The keys that are not remembered; those of the older generation go over to the newer one."""
        find, none = self.old.get, []
        for key in set(keys).difference(self.new):
            if (got := find(key)) is None:
                none.append(key)
            else:
                self.keep(key, got)
        return none

    def learn(self, chunks: Iterable[str]) -> None:
        """Remember chunks without white space; no word goes beyond one, and a word alone is a chunk."""
        words = {c: [c] if c.isalpha() else self.pattern.findall(c) for c in self.unknown(chunks)}
        self.learn_words(self.unknown(chain.from_iterable(words.values())))
        for chunk, own in words.items():
            if len(own) > 1:
                got = [self.new[w] for w in own]
                self.keep(chunk, (b"".join([x[0] for x in got]), " ".join([x[1] for x in got if x[0]])))

    def chunks(self, text: str) -> list[str]:
        """The normalised chunks, in order; a special token has a space before it."""
        done: list[str] = []
        for piece in self.split.split(text) if self.split and "<" in text else [text]:
            if piece in self.special:
                done.append(" " + piece)
            elif piece:
                normal = self.normal(piece)
                # split() also parts at four control characters that are no white space in Unicode
                done += normal.split() if not CONTROLS.search(normal) else [c for c in WHITE.split(normal) if c]
        return done

    def many(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        """Ids and decoded text of each text."""
        lists, done = [self.chunks(t or "") for t in texts], []
        self.learn(chain.from_iterable(lists))
        for own in lists:
            got = list(map(self.new.__getitem__, own))
            done.append((np.frombuffer(b"".join([x[0] for x in got]), np.int32), " ".join([x[1] for x in got if x[0]])))
        self.turn()
        return done

    def encode(self, text: str | None) -> list[int]:
        return self.many([text])[0][0].tolist()


_codec: dict[int, Codec] = {}


def _shared_codec(blob) -> Codec:
    """One codec for each worker process and file."""
    if (key := blob.id if hasattr(blob, "id") else id(blob)) not in _codec:
        _codec.clear()
        _codec[key] = Codec(blob.value)
    return _codec[key]


def vocabulary(path: str | None = None, most: int = 64 << 20) -> str:
    """The tokenizer file's text; it is sent to all executors, so its size is checked."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        text = f.read(most + 1)
    if len(text) > most:
        raise ValueError(f"{path} is larger than {most}")
    return text


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Append ``ids`` (array<int>) and ``decoded`` (string) to every row.

    They take the place of input columns of those names.
    """
    docs = without(docs, "ids", "decoded")
    spark = docs.sparkSession
    bound_arrow(spark)
    blob = spark.sparkContext.broadcast(vocabulary(path))
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _shared_codec(blob)
        for part in slices(batches, text):
            done = codec.many(part.column(text).to_pylist())
            sizes = np.cumsum([0, *(len(x[0]) for x in done)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([x[0] for x in done])))
            yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([x[1] for x in done], pa.string())], names=[*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(tidy(run), schema)


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole text encoded and decoded, as digests."""
    done = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: documents with their ids and number of tokens; the round trip's digest stands for the decoded text."""
    done = encode_decode(without(docs, "n_tokens", "decoded_sha256"))
    return done.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2(F.encode("decoded", "UTF-8"), 256)}).drop("decoded")
