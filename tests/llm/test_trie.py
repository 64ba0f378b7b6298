"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from doclens.llm import trie


def plain(rows):
    """Rows of the query's contract."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    key = lambda x: (x[0], x[1], x[2].encode(), hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest())
    turns = {c: [x[2:] for x in sorted(v, key=key)] for c, v in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids, own = {}, {}
    for seq, some in members.items():
        own[seq] = (len(some) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        below = kids.get(seq, [])
        leaves[seq] = sum(leaves[k] for k in below) or 1
        saved[seq] = own[seq] + sum(saved[k] for k in below)
    out = []
    for seq, some in members.items():
        end = ",".join(str(c) for c in sorted(some) if len(full[c]) == len(seq))
        above = min(members[seq[:-1]]) if seq else None
        out.append((min(some), len(seq), above, len(some), len(kids.get(seq, [])), leaves[seq], saved[seq], hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 45), *range(-25, -18), 1001]:
        for t in range(rnd.choice([1, 1, 2, 4, 6])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "", None, "c\td\x0b e f", "日本 語"])))
    long_ = [(t, "user", f"w{t} again") for t in range(30)]
    for c, n, end in [(60, 30, "x"), (64, 30, "y"), (65, 30, "x"), (80, 12, "z"), (100, 20, "x")]:
        rows += [(c, t, r, x) for t, r, x in long_[:n]] + [(c, 99, "user", end)]
    for c in range(2000, 2400, 20):  # many copies and a common first turn
        rows += [(c, 0, "user", "hello there"), (c, 1, "assistant", "yes"), (c, 2, "user", f"so {c % 3}")]
    rows += [(7, None, "user", "first"), (7, None, "user", "also"), (7, 1, "user", "tie"), (7, 1, "tie", "tie"), (7, 1, "user", "tie")]
    rows += [(None, 0, "user", "nobody"), (555, 0, None, None), (60, 5, "user", "x" * 100_000)]
    return rows


def write(spark, rows, path):
    spark.createDataFrame([(*r, "d", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, k1 int").write.parquet(f"{path}/conversations.parquet")


def test_whole_query_equals_plain_prefixes(spark, tmp_path):
    write(spark, cases(), tmp_path)
    got = sorted((tuple(r) for r in trie.prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(cases())


def test_windows_and_heavy_shards_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "UPPER", 1)
    monkeypatch.setattr(trie, "WINDOW", 10)
    monkeypatch.setattr(trie, "MOST_NODES", 9)
    rows = [r for r in cases() if r[0] is not None and 60 <= r[0] <= 2100]
    write(spark, rows, tmp_path)
    assert sorted((tuple(r) for r in trie.prefix_trie(spark, str(tmp_path)).collect()), key=str) == plain(rows)


def test_empty_table(spark, tmp_path):
    write(spark, [], tmp_path)
    assert trie.prefix_trie(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_louds_reads_back_its_parents_and_sums(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    above = np.array([-1 if i == 0 or rng.random() < 0.05 else int(rng.integers(0, i)) for i in range(n)])
    depth = np.zeros(n, int)
    for i in range(n):
        depth[i] = 0 if above[i] < 0 else depth[above[i]] + 1
    key = rng.permutation(n)
    mix = rng.permutation(n)
    above_key = np.where(above < 0, n + 5, key[above])
    t, at, parent = trie.Louds.of(depth[mix], key[mix], above_key[mix], np.arange(n)[mix])
    assert (t.parents() == parent).all() and sorted(at) == list(range(n))
    node = t.labels  # the original numbers in level order
    assert (np.diff(depth[node]) >= 0).all()
    for i in range(n):
        assert sorted(node[list(t.children(i))]) == sorted(np.flatnonzero(above == node[i]))
    value = rng.integers(0, 100, n)
    want = value.copy()
    for i in range(n - 1, -1, -1):
        if above[i] >= 0:
            want[above[i]] += want[i]
    assert (t.rollup(value[node]) == want[node]).all()
