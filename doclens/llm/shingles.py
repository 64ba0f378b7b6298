"""Word shingles of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROOT = 0xD6E8FEB86659FD93


@lru_cache(1)
def _word_letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = unicodedata.category(chr(c))[0] in "LNM"
    return out


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _ROOT, np.uint64)
        up[0] = 1
        down = np.full(n, pow(_ROOT, -1, 1 << 64), np.uint64)
        down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document's position, word's hash, start, end) of all words, in order; the text is lower-cased.

    start and end are code-point offsets in the lower-cased text. A word is a run of letters, marks and digits.
    """
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    cp = np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    is_word = _word_letters()[cp]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    room = 1 << (len(cp) - 1).bit_length()
    up, down = _powers(max(room, 1 << 16))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(cp.astype(np.uint64) + _STEP) * up[: len(cp)])])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.searchsorted(firsts, start, side="right") - 1
    return doc, h, start - firsts[doc], end - firsts[doc]


def shingle_hashes(doc: np.ndarray, h: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document's position, shingle's hash) from words in order; a document of fewer than n words is one shingle."""
    if not len(h):
        return doc, h
    count = np.bincount(doc)
    short = (count[doc] < n).astype(bool)
    acc = h * np.uint64(3)
    ok = np.zeros(len(h), bool)
    if len(h) >= n:
        acc = np.zeros(len(h), np.uint64)
        m = len(h) - n + 1
        run = np.zeros(m, np.uint64)
        for k in range(n):
            run = run * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + m]
        acc[:m] = run
        ok[:m] = doc[:m] == doc[n - 1 :]
    out_doc, out = doc[ok], mix(acc[ok])
    if short.any():
        d, w = doc[short], h[short]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        place = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
        part = mix(w + _STEP * (place + 1).astype(np.uint64))
        out_doc = np.concatenate([out_doc, d[first]])
        out = np.concatenate([out, mix(np.add.reduceat(part, first))])
    return out_doc, out


def shingle_sets(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each text's set, all sets one behind another); each set is ascending and distinct."""
    doc, h, _, _ = word_hashes(texts)
    d, s = shingle_hashes(doc, h, n)
    if len(d) and (d[1:] < d[:-1]).any():
        order = np.argsort(d, kind="stable")
        d, s = d[order], s[order]
    ends = np.cumsum(np.bincount(d, minlength=len(texts)))
    sets = [np.unique(s[a:b]) for a, b in zip(np.concatenate([[0], ends]), ends, strict=False)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return at, np.concatenate(sets) if sets else s
