"""Sets of word shingles of a batch of texts, as sorted 64-bit hashes, computed with array operations over its bytes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Texts are worked on in runs of about so many bytes, which bounds the memory at some hundred bytes for each.
RUN = 1 << 18
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers that leaves no pattern (the finaliser of MurmurHash3)."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, RUN), _BASE if kind == "up" else _BACK, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind]


def runs(texts: list[bytes]):
    """Slices of the texts' indices whose bytes amount to about RUN; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > RUN:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every word; words are runs of other bytes than ASCII white space, A-Z lower-cased."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[_LOWER[data]] * _power("up", len(data))[: len(data)], dtype=np.uint64)])
    word = mixed((total[end] - total[start]) * _power("down", len(data))[start]) + (end - start).astype(np.uint64)
    where = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(where, start, "right") - 1
    return word, doc


def shingle_sets(texts: list[bytes], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of them by text): each text's distinct shingles of k words, ascending, one text after the other.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. A text of fewer than k words has its whole
    sequence as one shingle, one without words has none.
    """
    word, doc = words(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    h = word.copy()
    for j in range(1, k):
        h[: len(h) - j] = mixed(h[: len(h) - j] * _BASE) + word[j:] if len(h) > j else h[: len(h) - j]
    last = np.cumsum(n_words)
    full = np.arange(len(word)) + k <= last[doc] if len(word) else np.zeros(0, bool)
    h, d = h[full], doc[full]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        own = np.empty(len(short), np.uint64)
        for x, i in enumerate(short):
            v = np.array([n_words[i]], np.uint64)
            for w in word[last[i] - n_words[i] : last[i]]:
                v = mixed(v * _BASE + w)
            own[x] = v[0]
        h, d = np.concatenate([h, own]), np.concatenate([d, short])
    h = mixed(h)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=len(texts))
