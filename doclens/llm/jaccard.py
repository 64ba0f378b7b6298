"""N-gram Jaccard join: MinHash banding, then verification on the full shingle sets.

Documents are sets of shingles of five words. A signature of BANDS times ROWS minima is cut into bands;
documents that share a band's hash are candidates. At Jaccard s a pair is found with probability
1 - (1 - s**ROWS)**BANDS: 0.999993 at 0.8 with 30 bands of 5 rows. Every candidate pair is
verified on the full sets, so no pair below the threshold is ever linked.

Documents of equal sets form a class first, so exact copies in any number cost one row. Candidate classes are
the members of a band's bucket. Buckets that overlap are put together by connected components, and such a
cluster is verified in one task if it is small. A larger one is verified in pairs of blocks, either of the whole cluster or of each
of its buckets, whichever moves fewer texts: a dense cluster shares most buckets, a long chain of small
buckets does not. In both, the pairs verified are just those that share a band's hash, each once (a bucket leaves out pairs that an
earlier band has), and no task holds more than two blocks. What leaves a task is a count of links and
a spanning forest, never all pairs.

Result for each row: ``class_id`` (least id with the same set), ``n_links`` (other documents at the threshold
or above, copies included) and ``group_id`` (least id of the group that links connect). Null, empty and
wordless texts have no set: they link to nothing and are classes of their own. Rows that repeat an id
are documents each. Texts are read whole. Ids may be of any type that can be ordered. Null ids are kept, with themselves as class and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.common import bound_arrow, components, free, slices, stored, table, tidy
from doclens.llm.shingles import WORDS, mix, shingle_sets

THRESHOLD = 0.8
BANDS, ROWS = 30, 5
#: Classes and shingles that a block of a large cluster holds, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 400, 400_000


def band_hashes(at: np.ndarray, sets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) hashes; only for non-empty sets."""
    rng = np.random.RandomState(20240601)
    seeds = rng.randint(0, 1 << 62, bands * rows).astype(np.uint64)
    odds = rng.randint(0, 1 << 62, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(at) - 1, bands), np.uint64)
    for k in range(bands * rows):
        low = np.minimum.reduceat((sets ^ seeds[k]) * odds[k], at[:-1])
        b = k // rows
        if k % rows == 0:
            out[:, b] = np.uint64(b + 1)
        out[:, b] = mix(out[:, b] * np.uint64(31) + low)
    return out


def _set_id(at: np.ndarray, sets: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(sets), at[:-1]) * np.uint64(3) + mix(np.bitwise_xor.reduceat(sets, at[:-1])) + np.diff(at).astype(np.uint64))


def signatures(rows: DataFrame) -> DataFrame:
    """(key, th, node, size, bands) from (key, th, text); node and what follows are null for a text without a set and for a null key."""
    bound_arrow(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, sets = shingle_sets([t or "" for t in part.column("text").to_pylist()], WORDS)
            some = np.diff(at) > 0
            place = np.full(part.num_rows, -1)
            place[some] = np.arange(some.sum())
            own = np.append(at[:-1][some], at[-1])
            bands = band_hashes(own, sets) if some.any() else np.zeros((0, BANDS), np.uint64)
            nodes = _set_id(own, sets) if some.any() else np.zeros(0, np.uint64)
            none = ~some | part.column("key").is_null().to_numpy(zero_copy_only=False)
            take = pa.array(np.where(none, 0, place), mask=none)
            spread = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("th"), *(x.take(take) for x in (pa.array(nodes.view(np.int64)), pa.array(np.diff(own)), spread))], names=["key", "th", "node", "size", "bands"])

    return rows.mapInArrow(tidy(run), T.StructType([rows.schema["key"], *T._parse_datatype_string("th long, node long, size long, bands array<long>")]))


def _same(bands: np.ndarray) -> np.ndarray:
    """Which rows share a band's hash with which."""
    mask = np.zeros((len(bands), len(bands)), bool)
    for b in range(bands.shape[1]):
        order = np.argsort(bands[:, b], kind="stable")
        col = bands[order, b]
        cut = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1], [True]]))
        for s, e in zip(cut, cut[1:], strict=False):
            if e - s > 1:
                own = order[s:e]
                mask[np.ix_(own, own)] = True
    return mask


def _pairs(bands: np.ndarray, side: np.ndarray, cross: bool, bucket: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (i < j in order of place) of a block, or of two blocks: those that share a band's hash; in a bucket
    those for which it is the first."""
    mask = _same(bands) if bucket is None else ~_same(bands[:, : int(np.flatnonzero(bands[0] == bucket)[0])])
    if cross:
        mask &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(mask, 1))


def verify(nodes: np.ndarray, weights: np.ndarray, bands: np.ndarray, texts: list[str], side: np.ndarray, cross: bool, threshold: float, bucket: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node (weighted by the other class's size), and its root in a spanning forest of the links."""
    i, j = _pairs(bands, side, cross, bucket)
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    if not len(i):
        return links, nodes
    at, sets = shingle_sets(texts, WORDS)
    size = np.diff(at)
    # sizes alone bound the similarity
    fit = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[fit], j[fit]
    shared = _shared(at, sets, i, j)
    ok = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
    i, j = i[ok], j[ok]
    np.add.at(links, i, weights[j])
    np.add.at(links, j, weights[i])
    while len(i):  # least node of each component, by repeated minima
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return links, nodes[root]


def _shared(at: np.ndarray, sets: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets i and j, for many pairs."""
    if len(i) <= 64 or len(i) < 2 * (len(at) - 1):
        return np.array([len(np.intersect1d(sets[at[a] : at[a + 1]], sets[at[b] : at[b + 1]], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    place = np.full(len(at) - 1, -1)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = place[owner] >= 0
    owner, own = place[owner[keep]], sets[keep]
    _, column, often = np.unique(own, return_inverse=True, return_counts=True)
    some = often[column] > 1  # a shingle of one set is in no intersection
    owner, column = owner[some], np.unique(column[some], return_inverse=True)[1]
    total = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        m = np.zeros((len(used), width), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        total += m @ m.T
    return np.rint(total[place[i], place[j]]).astype(np.int64)


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) for each row of (part, x, y, bucket, side, node, n, bands, text), by block pair."""
    keys = ("part", "x", "y", "bucket")
    parts = members.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None

        def close() -> pa.RecordBatch:
            side = np.array([r["side"] for r in held])
            nodes = np.array([r["node"] for r in held], np.int64)
            links, root = verify(nodes, np.array([r["n"] for r in held], np.int64), np.array([r["bands"] for r in held], np.int64), [r["text"] for r in held], side, key[1] != key[2], threshold, key[3])
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(root)], names=["node", "links", "root"])

        for batch in batches:
            for r in batch.to_pylist():
                now = tuple(r[k] for k in keys)
                if now != key and held:
                    yield close()
                    held = []
                key = now
                held.append(r)
        if held:
            yield close()

    return parts.mapInArrow(tidy(run), "node long, links long, root long")


def _blocks(classes, shingles):
    """Blocks for so many classes with so many shingles."""
    return F.greatest(F.ceil(classes / BLOCK_CLASSES), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _placed(classes: DataFrame) -> DataFrame:
    """(part, x, y, bucket, side, node, ...): the blocks' pairs that each class with candidates goes to."""
    hashes = classes.select("node", "size", F.explode("bands").alias("h"))
    buckets = hashes.groupBy("h").agg(F.min("node").alias("least"), F.count("*").alias("members"), F.sum("size").alias("shingles")).where("members > 1")
    buckets = buckets.select("h", "least", _blocks(F.col("members"), F.col("shingles")).alias("parts"))
    shared = stored(hashes.select("node", "h").join(buckets, "h"), "buckets")
    clusters = stored(components(shared.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()).withColumnRenamed("root", "comp"), "clusters")
    facts = clusters.join(classes.select("node", "size"), "node").groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    facts = stored(facts.select("comp", "n", _blocks(F.col("n"), F.col("shingles")).alias("blocks")), "cluster-sizes")
    # copies of texts that the pairs of blocks of the buckets need, for clusters of more than one block
    large = clusters.join(facts.where("blocks > 1"), "comp")
    split = large.join(shared, "node").groupBy("comp").agg(F.sum("parts").alias("copies"), F.max(F.col("n") * F.col("blocks")).alias("whole")).where("copies < whole").select("comp")
    split = stored(split, "split")
    no_bucket = F.lit(None).cast("long").alias("bucket")
    whole = clusters.join(facts, "comp").join(split, "comp", "left_anti").select(F.col("comp").alias("part"), no_bucket, "node", "blocks")
    alone = clusters.join(split, "comp", "left_semi").select("node").join(shared, "node").select(F.col("h").alias("part"), F.col("h").alias("bucket"), "node", F.col("parts").alias("blocks"))
    own = whole.unionByName(alone).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a class goes to each pair of blocks that has its own
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("own", b).alias("x"), F.greatest("own", b).alias("y")))
    return own.withColumn("p", F.explode(spread)).select("part", "p.x", "p.y", "bucket", F.col("own").alias("side"), "node")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, th, class_id, n_links, group_id) of every row; th is a hash of the row's text."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    signed = stored(signatures(rows), "signatures")
    some = signed.where("node is not null")
    # one row for each set; all of a class have the same bands
    classes = some.groupBy("node").agg(F.min(F.struct("key", "th")).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    classes = stored(classes.select("node", F.col("first.key").alias("rep"), F.col("first.th").alias("rep_th"), "n", "size", "bands"), "classes")
    placed = stored(_placed(classes), "placed")
    texts = rows.select(F.col("key").alias("rep"), F.col("th").alias("rep_th"), "text").where("text is not null")
    with_text = placed.select("node").distinct().join(classes, "node").join(texts, ["rep", "rep_th"]).dropDuplicates(["node"]).select("node", "n", "bands", "text")
    checked = stored(_verified(placed.join(with_text, "node").select("part", "x", "y", "bucket", "side", "node", "n", "bands", "text"), threshold), "links")
    # a large cluster's forests meet again here; a small one's are whole already
    roots = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "top")
    linked = checked.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "rep", "n").join(linked, "node", "left").join(roots, "node", "left").select("node", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "node").alias("top"))
    groups = known.groupBy("top").agg(F.min("rep").alias("group_id"))
    known = known.join(groups, "top").select("node", F.col("rep").alias("class_id"), (F.col("links") + F.col("n") - 1).alias("n_links"), "group_id")
    done = some.select("key", "th", "node").join(known, "node").select("key", "th", "class_id", "n_links", "group_id")
    # rows without a set are classes of their own
    rest = signed.where("node is null").select("key", "th", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("group_id"))
    return done.unionByName(rest)


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: class, number of links and group of every document."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("key").alias("doc_id"), "class_id", "n_links", "group_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the least id stays, once."""
    kept = join(docs).where("key is null or key = group_id").select(F.col("key").alias("_key"), F.col("th").alias("_kept")).distinct()
    name = free(docs, "_th")
    own = docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return own.join(kept, own["doc_id"].eqNullSafe(kept["_key"]) & (own[name] == kept["_kept"]), "left_semi").dropDuplicates(["doc_id", name]).drop(name)


#: Exact, for small tables: all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS sh FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b, (c = x.n AND c = y.n) AS same FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT a AS node, b AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id,
  least(d.doc_id, coalesce((SELECT min(b) FROM l WHERE l.a = d.doc_id AND same), d.doc_id)) AS class_id,
  coalesce((SELECT count(*) FROM l WHERE l.a = d.doc_id), 0) AS n_links,
  least(d.doc_id, coalesce((SELECT min(seen) FROM r WHERE r.node = d.doc_id), d.doc_id)) AS group_id
FROM documents d
"""
