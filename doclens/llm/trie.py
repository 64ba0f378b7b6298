"""Conversation prefix trie with rolled-up counts, built as succinct level-order tries.

A node is a distinct sequence of first turns. Its key is two 64-bit sums (by exclusive or) of hashes of (depth, turn), so the
keys of a conversation's prefixes are running sums and node facts are plain aggregations, whatever a node's share of the rows.

Most nodes belong to one sequence only: their subtree is a chain, and the facts that every row carries (length, words up to
here and in all) give all their figures. Only nodes that several sequences pass go on. Below ``UPPER`` levels, windows
of ``WINDOW`` levels are cut in shards by their top nodes, from the deepest window up: numpy orders a shard's nodes by level,
sets the LOUDS bits (for each node a one for each child and a zero) and the labels, and rolls figures up by
``add.at`` from the last level to the first. A shard of more than ``MOST_NODES`` nodes, and the heavy upper levels, are
merged one level after the other by grouping on the parent, which adds up before it shuffles.

Defined cases: rows without a conversation id are left out. Null roles and texts are empty. Null turns come first; equal
turns are ordered by role, then by the SHA-256 of role and text. An empty table gives no rows, as a trie without members has no root.
Repeated rows are turns of their own. Texts are read whole but only their digests and word counts are shuffled. The
remainder of a negative id is negative (c % 20 rounds towards zero).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.llm.common import new_folder, stored, stored_at, table, tidy

#: Levels from the root that are merged on their own, and levels of a window of shards below them.
UPPER, WINDOW = 3, 64
#: Nodes of a shard that one task builds, and nodes that it takes from the shuffle at once.
MOST_NODES, AT_ONCE = 1 << 20, 1 << 18
#: Ids of members whose numbers are joined to one text at once.
IDS = 4096
#: Conversations with one common opening.
OPENING = 20

NODE = "k1 long, k2 long, depth int, p1 long, p2 long"


class Louds:
    """A forest in level order: for each node a one for each child and a zero. Nodes are numbered by level, roots first."""

    def __init__(self, parent: np.ndarray, labels: np.ndarray, n_roots: int):
        """``parent`` in level order, ascending, -1 for roots."""
        self.n_roots, self.labels = n_roots, labels
        self.degree = np.bincount(parent[n_roots:], minlength=len(parent))
        ends = np.cumsum(self.degree) + np.arange(len(parent))
        bits = np.ones(len(parent) * 2 - n_roots, bool)
        bits[ends] = False
        self.bits, self.n = np.packbits(bits), len(parent)

    @classmethod
    def of(cls, depth: np.ndarray, key: np.ndarray, above: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray]:
        """The trie of nodes in any order, the order by level of those nodes, and the parents in that order.

        key and above: numbers of a node and its parent, unique for nodes; a node without its parent among them is a root.
        """
        by_key = np.argsort(key, kind="stable")
        at = np.minimum(np.searchsorted(key[by_key], above), len(key) - 1)
        has = key[by_key][at] == above
        # level by level, children in the order of their parents
        order = np.flatnonzero(~has)
        order = order[np.lexsort((key[order], depth[order]))]
        parent_of = np.where(has, by_key[at], -1)
        place = np.full(len(key), -1, np.int64)
        parts, parents, n = [order], [np.full(len(order), -1, np.int64)], 0
        kids = np.argsort(parent_of, kind="stable")
        kids = kids[np.searchsorted(parent_of[kids], 0) :]
        first, last = np.searchsorted(parent_of[kids], np.arange(len(key))), np.searchsorted(parent_of[kids], np.arange(len(key)), side="right")
        while len(order):
            place[order] = np.arange(n, n + len(order))
            n += len(order)
            count = last[order] - first[order]
            if not count.sum():
                break
            above_at = np.repeat(place[order], count)
            start = np.repeat(first[order] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            order = kids[start + np.arange(count.sum())]
            parts.append(order)
            parents.append(above_at)
        order, parent = np.concatenate(parts), np.concatenate(parents)
        return cls(parent, labels[order], len(parts[0])), order, parent

    def parents(self) -> np.ndarray:
        """Every node's parent, read from the bits alone."""
        bits = np.unpackbits(self.bits, count=self.n * 2 - self.n_roots).astype(bool)
        ones = np.flatnonzero(bits)
        zeros_before = ones - np.arange(len(ones))
        return np.concatenate([np.full(self.n_roots, -1, np.int64), zeros_before])

    def children(self, node: int) -> range:
        start = self.n_roots + int(self.degree[:node].sum())
        return range(start, start + int(self.degree[node]))

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees: from the last level to the first, every level is added to its parents."""
        out, parent = values.copy(), self.parents()
        starts, lo, hi = [], 0, self.n_roots
        while lo < hi:
            starts.append((lo, hi))
            lo, hi = hi, hi + int(self.degree[lo:hi].sum())
        for a, b in reversed(starts[1:]):
            np.add.at(out, parent[a:b], out[a:b])
        return out


def _digest(role: str, text: str) -> Column:
    """SHA-256 of a turn, in which the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256))


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of every conversation, numbered from 1. Texts end here."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    slim = rows.select("conv_id", "turn", "role", _digest("role", "text").alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return slim.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, digest, words): every conversation with the opening of conversation c - c % 20 and its own turns behind.

    turns: of ``ordered``. part is 0 for the opening's turns and 1 for own ones.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    own = turns.where(F.col("pos") > h("conv_id")).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "words")
    some = turns.where((F.col("conv_id") % OPENING == 0) & (F.col("pos") <= 3))
    near = F.sequence(F.col("conv_id") - (OPENING - 1), F.col("conv_id") + (OPENING - 1))
    each = some.select(F.col("conv_id").alias("base"), "pos", "digest", "words", F.explode(near).alias("conv_id"))
    each = each.where((F.col("conv_id") - F.col("conv_id") % OPENING == F.col("base")) & (F.col("pos") <= h("conv_id")))
    known = turns.where("pos = 1").select("conv_id")
    return own.unionByName(each.join(known, "conv_id", "left_semi").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "words"))


def prefixes(rows: DataFrame) -> DataFrame:
    """A row for each conversation and prefix: keys of it, its parent and the whole sequence, and the facts that chains need."""
    by = W.partitionBy("conv_id").orderBy("part", "pos")
    run, whole = by.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("conv_id")
    rows = rows.withColumn("depth", F.row_number().over(by))
    rows = rows.withColumn("h1", F.xxhash64("digest", "depth")).withColumn("h2", F.xxhash64("depth", "digest", F.lit("second")))
    rows = rows.select("conv_id", "depth", "digest", "words", "h1", "h2", F.bit_xor("h1").over(run).alias("k1"), F.bit_xor("h2").over(run).alias("k2"), F.sum("words").over(run).alias("so_far"))
    total = lambda e: e.over(whole)
    rows = rows.select("*", total(F.bit_xor("h1")).alias("w1"), total(F.bit_xor("h2")).alias("w2"), total(F.sum("words")).alias("in_all"), total(F.count("*")).cast("int").alias("length"))
    p1, p2 = F.col("k1").bitwiseXOR(F.col("h1")), F.col("k2").bitwiseXOR(F.col("h2"))
    # the top of the window of levels that a node lies in
    top = F.when(F.col("depth") >= UPPER, (F.col("depth") - UPPER) % WINDOW == 0)
    a1, a2 = (F.last(F.when(top, F.col(k)), True).over(W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)) for k in ("k1", "k2"))
    return rows.select("conv_id", "depth", "digest", "words", "k1", "k2", p1.alias("p1"), p2.alias("p2"), "w1", "w2", "length", (F.col("in_all") - F.col("so_far") + F.col("words")).alias("rest"), a1.alias("a1"), a2.alias("a2"))


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards, whose nodes lie behind one another, to a row each: LOUDS bits, labels, keys in level order and rolled-up figures."""

    def shards(columns: dict[str, np.ndarray]) -> Iterator[tuple]:
        new = np.flatnonzero(np.concatenate([[True], (np.diff(columns["a1"]) != 0) | (np.diff(columns["a2"]) != 0)]))
        for a, b in zip(new, [*new[1:], len(columns["a1"])], strict=True):
            part = {k: v[a:b] for k, v in columns.items()}
            ids = np.stack([np.concatenate([part["k1"], part["p1"]]), np.concatenate([part["k2"], part["p2"]])], axis=1)
            order = np.lexsort((ids[:, 1], ids[:, 0]))
            step = np.concatenate([[0], np.cumsum((np.diff(ids[order], axis=0) != 0).any(1))])
            number = np.empty(len(ids), np.int64)
            number[order] = step
            trie, at, _ = Louds.of(part["depth"], number[: b - a], number[b - a :], part["label"])
            leaves, saved = trie.rollup(part["leaves"][at]), trie.rollup(part["saved"][at])
            yield part["a1"][0], part["a2"][0], trie.n, trie.n_roots, trie.bits.tobytes(), trie.labels.tobytes(), part["k1"][at].tolist(), part["k2"][at].tolist(), (part["kids"][at] + trie.degree).tolist(), leaves.tolist(), saved.tolist()

    schema = pa.schema([(n, t) for n, t in zip(("a1", "a2", "n_nodes", "n_roots", "bits", "labels", "k1", "k2", "kids", "leaves", "saved"), [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 5, strict=True)])
    names, held, n = ("a1", "a2", "k1", "k2", "p1", "p2", "depth", "label", "kids", "leaves", "saved"), [], 0

    def done(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in shards(columns):
            rows.append(row)
            if sum(r[2] for r in rows) > AT_ONCE // 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({k: batch.column(k).to_numpy(zero_copy_only=False) for k in names})
        n += batch.num_rows
        if n >= AT_ONCE:
            all_ = {k: np.concatenate([h[k] for h in held]) for k in names}
            cut = np.flatnonzero((all_["a1"] != all_["a1"][-1]) | (all_["a2"] != all_["a2"][-1]))
            cut = cut[-1] + 1 if len(cut) else 0  # the last shard may go on
            if cut:
                yield from done({k: v[:cut] for k, v in all_.items()})
            held, n = [{k: v[cut:].copy() for k, v in all_.items()}], n - cut
    if n:
        yield from done({k: np.concatenate([h[k] for h in held]) for k in names})


SHARD = "a1 long, a2 long, n_nodes long, n_roots long, bits binary, labels binary, k1 array<long>, k2 array<long>, kids array<long>, leaves array<long>, saved array<long>"
_FIGURES = ("kids", "leaves", "saved")


def succinct(nodes: DataFrame) -> DataFrame:
    """A row for each shard (a1, a2) of nodes: its LOUDS trie and the figures of its nodes in level order.

    nodes: ``NODE`` and a1, a2, label long, and the figures kids, leaves, saved that nodes have of their own or from below.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select("a1", "a2", "k1", "k2", "p1", "p2", "depth", "label", *_FIGURES).repartition(n, "a1", "a2").sortWithinPartitions("a1", "a2")
    return dealt.mapInArrow(tidy(build), SHARD)


def _from_below(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes with what their children below this level or window add to them."""
    up = below.groupBy("p1", "p2").agg(F.count("*").alias("u_kids"), F.sum("leaves").alias("u_leaves"), F.sum("saved").alias("u_saved"))
    joined = nodes.join(up.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "u_kids", "u_leaves", "u_saved"), ["k1", "k2"], "left")
    return joined.select(*(c for c in nodes.columns if c not in _FIGURES), *((F.col(c) + F.coalesce(f"u_{c}", F.lit(0))).alias(c) for c in _FIGURES))


def rolled(shared: DataFrame) -> DataFrame:
    """Every node that several sequences pass, with kids, leaves and saved of its whole subtree.

    shared: ``NODE``, a1, a2, label, and own figures, the sums of chains below included.
    """
    spark, root = shared.sparkSession, new_folder(shared.sparkSession, "trie")
    deepest = shared.agg(F.max("depth")).first()[0]
    if deepest is None:
        return shared
    starts = [*range(min(UPPER, deepest + 1)), *range(UPPER, deepest + 1, WINDOW)]
    parts, below = [], None
    for k, start in reversed(list(enumerate(starts))):
        end = start + 1 if start < UPPER else start + WINDOW
        own = shared.where((F.col("depth") >= start) & (F.col("depth") < end))
        own = own if below is None else _from_below(own, below)
        if start < UPPER:
            done, tops = own, None
        else:
            own = stored_at(own, f"{root}/own-{k}")
            heavy = own.groupBy("a1", "a2").count().where(F.col("count") > MOST_NODES).select("a1", "a2")
            heavy = stored_at(heavy, f"{root}/heavy-{k}")
            light = own.join(heavy, ["a1", "a2"], "left_anti")
            each = succinct(light).select(F.explode(F.arrays_zip("k1", "k2", *_FIGURES)).alias("x")).select("x.*")
            done = light.drop(*_FIGURES).join(each, ["k1", "k2"])
            if not heavy.isEmpty():  # level by level, by sums that are formed before the shuffle
                rest = own.join(heavy, ["a1", "a2"], "left_semi")
                level = None
                for d in range(min(end, deepest + 1) - 1, start - 1, -1):
                    here = rest.where(F.col("depth") == d)
                    level = stored_at(here if level is None else _from_below(here, level), f"{root}/level-{k}-{d}")
                    done = done.unionByName(level)
            tops = F.col("depth") == start
        done = stored_at(done.select(*shared.columns), f"{root}/done-{k}")
        below = done if tops is None else done.where(tops)
        parts.append(done)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ends(members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the digest of the members' ids that end at a node, ascending. Ids become text in parts of ``IDS``."""
    part = F.floor(F.col("conv_id") / IDS)
    texts = members.groupBy("k1", "k2", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0][0] for o in out], pa.int64()), pa.array([o[0][1] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["k1", "k2", "ends_sha256"])

        for batch in batches:
            for k1, k2, ids in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if (k1, k2) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256(ids.encode())
            if len(out) >= 10_000:
                yield flush()
                out.clear()
        if key is not None:
            out.append((key, digest.hexdigest()))
        if out:
            yield flush()

    return texts.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids").mapInArrow(tidy(run), "k1 long, k2 long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations; see the module's text."""
    turns = stored(ordered(conversations), "turns")
    rows = stored(prefixes(rebuilt(turns)), "prefixes")
    members = turns.where("pos = 1").select("conv_id")
    empty = F.sha2(F.lit(""), 256)
    facts = rows.groupBy("k1", "k2").agg(
        *(F.min(c).alias(c) for c in ("depth", "p1", "p2", "a1", "a2", "conv_id", "words", "length", "rest")),
        F.count("*").alias("n_convs"),
        F.min(F.xxhash64("digest")).alias("label"),
        ((F.min("w1") == F.max("w1")) & (F.min("w2") == F.max("w2"))).alias("alone"),
    )
    facts = stored(facts, "nodes")
    chains = facts.where("alone").select("*", (F.col("depth") < F.col("length")).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("rest")).alias("saved"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = {"k1": 0, "k2": 0, "depth": 0, "words": 0, "label": 0}
    root = root.select("conv_id", "n_convs", *(F.lit(v).cast("int" if k == "depth" else "long").alias(k) for k, v in zero.items()), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2", "a1", "a2")))
    several = facts.where("not alone").select(*root.columns).unionByName(root)
    own = several.select("*", F.lit(0).cast("long").alias("kids"), F.lit(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    full = stored(rolled(stored(_from_below(own, chains), "shared")), "rolled")
    full = full.withColumn("leaves", F.greatest("leaves", F.lit(1)))  # a root alone
    last = rows.where("depth = length").select("conv_id", "k1", "k2")
    at_root = members.join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    parents = full.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    all_ = chains.select(*(c for c in full.columns if c in chains.columns)).unionByName(full.select(*(c for c in full.columns if c in chains.columns)))
    # a chain's parent that is in no other sequence has the chain's own members
    out = all_.join(parents, ["p1", "p2"], "left").join(ends(last.unionByName(at_root)), ["k1", "k2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the nodes of the trie of all rebuilt conversations."""
    return nodes(table(spark, sf_dir, "conversations"))


#: CRC-32 of a number's decimal text, bit by bit: a character goes in, then eight shifts.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({c}::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end))"

SQL = f"""
with o as (select conv_id, coalesce(role, '') role, coalesce(text, '') text,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) pos
           from conversations where conv_id is not null),
c as (select distinct conv_id, {_CRC.format(c="conv_id")} % 4 h from o),
r as (select c.conv_id, 1 part, o.pos, role, text from o join c using (conv_id) where pos > h
      union all select c.conv_id, 0, o.pos, role, text from c join o on o.conv_id = c.conv_id - c.conv_id % 20 and o.pos <= c.h),
d as (select conv_id, row_number() over w as depth, string_agg(sha256(length(role) || ':' || role || text), '/') over w as key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) words
      from r window w as (partition by conv_id order by part, pos)),
p as (select conv_id, depth, key, coalesce(lag(key) over (partition by conv_id order by depth), '') above, words from d
      union all select conv_id, 0, '', null, 0 from c),
n as (select key, any_value(above) above, any_value(depth) depth, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * any_value(words) own from p group by key),
last as (select conv_id, arg_max(key, depth) key from p group by 1),
fin as (select key, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) e from last group by 1),
kids as (select above key, count(*) k from n where above is not null group by 1),
pairs as (select distinct a.key up, b.key from p a join p b on a.conv_id = b.conv_id and a.depth <= b.depth),
sums as (select up key, sum(n.own) saved, count(*) filter (where kids.k is null) leaves from pairs join n on n.key = pairs.key left join kids on kids.key = pairs.key group by 1)
select n.conv_id::bigint conv_id, n.depth::bigint depth, q.conv_id::bigint parent_conv_id, n.n_convs::bigint n_convs, coalesce(kids.k, 0)::bigint n_children,
       sums.leaves::bigint n_leaves, sums.saved::bigint saved_tokens, coalesce(fin.e, sha256('')) ends_sha256
from n join sums on sums.key = n.key left join kids on kids.key = n.key left join fin on fin.key = n.key left join n q on q.key = n.above
"""
