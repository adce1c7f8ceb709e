"""Language-model scoring with an Elias-Fano n-gram trie of order three.

p(w | u v) = f(w | u v) + b(u v) * p(w | v), likewise p(w | v) over the add-one p(w) = (c(w) + 1) / (N + V + 1). With c
occurrences of an n-gram among n of its context, which has d distinct successors, f = (c - D) / n and b = D * d / n:
interpolated absolute discounting of every n-gram that trains, also those seen once. Each level of the trie holds log f
and log b as numbers of 16 bits on a fixed scale; probabilities of all words add up to one but for that rounding.

Nothing of the corpus comes to the driver or is broadcast. Texts are rewritten once as runs: a bounded stretch of tokens
as places in the run's own list of words. A run sends each of its distinct words, and then each distinct n-gram of
three words, once, packed by shard of the middle word. A shard adds them up, which gives the pairs as well, builds its
tries, looks the n-grams of each run up in them and answers with codes. A run thus weighs once for each n-gram however
often its texts hold it. A middle word of very many occurrences is dealt over shards by the word before, so its pairs
are sent by themselves; a context of very many occurrences is dealt over shards by its successors. As no shard sees all
of these, b is MASS / (n + MASS) for such a context, and f = (1 - b) * c / n. Last, every run meets its answers and
scores its texts.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm import shingles
from meltemi.llm.packing import deltas, distinct, packed, small, unpacked
from meltemi.llm.shared import bucketed, pruned, short_batches, written

#: D and MASS of each order.
DISCOUNT = {2: 0.8, 3: 0.8}
MASS = {2: 500.0, 3: 50.0}
#: Steps of a code for a factor of ten, and the code of what the trie doesn't hold.
STEPS, ABSENT = 128, 65535
#: Tokens of a run and bytes of text for each shard, which bound the memory of tasks.
RUN_TOKENS = 1 << 19
SHARD_BYTES = 6 << 20
#: Contexts of more than HOT occurrences go to SALT shards, of more than SALT * HOT to SALT * SALT, and so on.
HOT, SALT, DEPTH = 1 << 17, 16, 3
#: Places of the table that tells such contexts; with very many of them it deals others as well, alike in all runs.
SLOTS = 1 << 22
#: Numbers of a sequence, and keys, that meet at once; with a key for every DENSE numbers or more, sequences are decoded in order.
STRETCH, DENSE = 1 << 18, 8
END, BEGIN = np.uint64(0x0E0E0E0E0E0E0E0E), np.uint64(0x0B0B0B0B0B0B0B0B)
#: Bits of a word that tell it apart from others beside the same word.
BITS = 24
LOW, WIDTH = np.uint64((1 << BITS) - 1), np.uint64(BITS)
FRAGMENTS = "run long, shard int, payload binary"


# --- codes -----------------------------------------------------------------------


def coded(x: np.ndarray) -> np.ndarray:
    """Codes of probabilities above zero."""
    return np.clip(np.rint(-np.log10(x) * STEPS), 0, ABSENT - 1).astype(np.uint16)


def valued(code: np.ndarray) -> np.ndarray:
    return np.where(code == ABSENT, 0.0, 10.0 ** (-code.astype(float) / STEPS))


# --- Elias-Fano ----------------------------------------------------------------


class Bits:
    """A packed string of bits with select over its ones or zeros, by counts of ones at every BLOCK words."""

    BLOCK = 4

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts

    @classmethod
    def arrays(cls, ones: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, counts) of a string with ones at the ascending places given."""
        words = np.zeros(-(-(size + 1) // (64 * cls.BLOCK)) * cls.BLOCK, np.uint64)
        np.bitwise_or.at(words, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        count = np.bitwise_count(words).reshape(-1, cls.BLOCK).sum(1, dtype=np.int64)
        return words, np.concatenate([[0], np.cumsum(count)])

    def select(self, i: np.ndarray, bit: int = 1) -> np.ndarray:
        """Place of the i-th (from 0) one or zero."""
        width = 64 * self.BLOCK
        if bit:
            block = np.searchsorted(self.counts, i, "right") - 1
            left = i - self.counts[block]
        else:
            zeros = np.arange(len(self.counts)) * width - self.counts
            block = np.searchsorted(zeros, i, "right") - 1
            left = i - zeros[block]
        at = block * self.BLOCK
        for _ in range(self.BLOCK - 1):
            n = np.bitwise_count(self.words[at]).astype(np.int64)
            n = n if bit else 64 - n
            on = left >= n
            left = np.where(on, left - n, left)
            at = np.where(on, at + 1, at)
            if not on.any():
                break
        word = self.words[at] if bit else ~self.words[at]
        place = at * 64
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= n
            left = np.where(on, left - n, left)
            place = np.where(on, place + half, place)
            word = np.where(on, word >> np.uint64(half), word)
        return place


class EliasFano:
    """An ascending sequence of 64-bit numbers: `width` low bits each, packed, and the high parts in unary."""

    def __init__(self, n: int, width: int, base: int, low: np.ndarray, words: np.ndarray, counts: np.ndarray):
        self.n, self.width, self.base, self.low, self.high = n, width, np.uint64(base), low, Bits(words, counts)
        self.mask = np.uint64((1 << width) - 1)

    @staticmethod
    def parts(a: np.ndarray) -> tuple[tuple[int, int, int], list[np.ndarray]]:
        n, base = len(a), int(a[0]) if len(a) else 0
        x = a - np.uint64(base)
        width = min(58, max(0, (int(x[-1]) // n).bit_length() - 1)) if n else 0
        high = (x >> np.uint64(width)).astype(np.int64)
        bit = np.arange(n) * width
        low = np.zeros((n * width >> 6) + 2, np.uint64)
        if width:
            v, s = x & np.uint64((1 << width) - 1), (bit & 63).astype(np.uint64)
            np.bitwise_or.at(low, bit >> 6, v << s)
            over = s > np.uint64(64 - width)
            np.bitwise_or.at(low, (bit[over] >> 6) + 1, v[over] >> (np.uint64(64) - s[over]))
        return (n, width, base), [low, *Bits.arrays(high + np.arange(n), n + (int(high[-1]) if n else 0) + 1)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        s = (bit & 63).astype(np.uint64)
        after = np.where(s > 0, self.low[(bit >> 6) + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        return ((self.low[bit >> 6] >> s) | after) & self.mask if self.width else np.zeros(len(i), np.uint64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (((self.high.select(i) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)) + self.base

    def _bucket(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers with each key's high part start and end; keys are within the sequence's range."""
        h = ((key - self.base) >> np.uint64(self.width)).astype(np.int64)
        start = np.where(h > 0, self.high.select(np.maximum(h - 1, 0), 0) - h + 1, 0)
        return start, self.high.select(h, 0) - h

    def within(self, lo: np.ndarray, hi: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Index of each key among the numbers lo to hi (without hi), -1 where it isn't there.

        The zeros of the unary part bound the numbers that share a key's high part; few low parts are left to compare.
        """
        out = np.full(len(key), -1)
        if not self.n:
            return out
        at = np.flatnonzero((lo < hi) & (key >= self.base) & (key <= self.get(np.array([self.n - 1]))[0]))
        key = key[at]
        start, end = self._bucket(key)
        lo, end = np.maximum(lo[at], start), np.minimum(hi[at], end)
        hi, low = end.copy(), (key - self.base) & self.mask
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) // 2
            less = self._low(mid) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
        some = np.flatnonzero(lo < end)
        hit = some[self._low(lo[some]) == low[some]]
        out[at[hit]] = lo[hit]
        return out

    def values(self, lo: int, hi: int) -> np.ndarray:
        """The numbers lo to hi (without hi), decoded one after the other."""
        if lo >= hi:
            return np.zeros(0, np.uint64)
        first, last = self.high.select(np.array([lo, hi - 1])) >> 6
        bits = np.unpackbits(self.high.words[first : last + 1].view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits) + (first << 6)
        before = int(self.high.counts[first // Bits.BLOCK]) + int(np.bitwise_count(self.high.words[first // Bits.BLOCK * Bits.BLOCK : first]).sum())
        i = np.arange(lo, hi)
        return (((ones[lo - before : hi - before] - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)) + self.base

    def merged(self, key: np.ndarray) -> np.ndarray:
        """As find(), of ascending keys: a stretch of them meets the stretch of the sequence that its ends enclose."""
        out = np.full(len(key), -1)
        if not self.n or not len(key):
            return out
        a, b = np.searchsorted(key, self.base), np.searchsorted(key, self.get(np.array([self.n - 1]))[0], "right")
        for k in range(a, b, STRETCH):
            own = key[k : min(b, k + STRETCH)]
            start, end = self._bucket(own[[0, -1]])
            for lo in range(int(start[0]), int(end[1]), STRETCH):
                seq = self.values(lo, min(int(end[1]), lo + STRETCH))
                x, y = np.searchsorted(own, seq[0]), np.searchsorted(own, seq[-1], "right")
                at = np.searchsorted(seq, own[x:y])
                out[k + x : k + y] = np.where(seq[at] == own[x:y], lo + at, out[k + x : k + y])
        return out

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it isn't in the sequence."""
        if len(key) * DENSE > self.n:
            key, back = np.unique(key, return_inverse=True)
            return self.merged(key)[back]
        return self.within(np.zeros(len(key), np.int64), np.full(len(key), self.n), key)


class Trie:
    """Two levels in one stretch of memory, of a file or of none: contexts, pointers, successors, codes of f and of b.

    Contexts and pointers ascend; a successor counts as its context's index times 2**BITS plus its own bits, so all of
    them ascend, too, and those of one context fill the range between its pointers.
    """

    LEVELS = 3

    def __init__(self, data):
        head = np.frombuffer(data, np.int64, 64)
        spans = [(int(head[2 * k]), int(head[2 * k + 1])) for k in range(11)]
        cut = [np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at) for (at, size), kind in zip(spans, [*[np.uint64, np.uint64, np.int64] * 3, np.uint16, np.uint16])]
        shape = head[22:31].tolist()
        self.contexts, self.pointers, self.successors = (EliasFano(*shape[3 * k : 3 * k + 3], *cut[3 * k : 3 * k + 3]) for k in range(self.LEVELS))
        self.f, self.b = cut[9:]

    @staticmethod
    def laid_out(context: np.ndarray, b: np.ndarray, owner: np.ndarray, word: np.ndarray, f: np.ndarray) -> list[bytes]:
        """The bytes of a trie. Ascending contexts with their b; owner (index of the context), word and f by (owner, word)."""
        pointers = np.searchsorted(owner, np.arange(len(context) + 1)).astype(np.uint64)
        levels = [EliasFano.parts(x) for x in (context, pointers, (owner.astype(np.uint64) << WIDTH) | word)]
        arrays = [a for _, x in levels for a in x] + [coded(f), coded(b)]
        head, at = np.zeros(64, np.int64), 512
        for k, a in enumerate(arrays):
            head[2 * k : 2 * k + 2] = at, a.nbytes
            at += -(-a.nbytes // 8) * 8
        head[22:31] = np.array([x for shape, _ in levels for x in shape], np.uint64).astype(np.int64)
        return [head.tobytes(), *(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)]

    @classmethod
    def mapped(cls, *levels: np.ndarray) -> Trie:
        parts = cls.laid_out(*levels)
        m = mmap.mmap(-1, sum(map(len, parts)))
        for p in parts:
            m.write(p)
        return cls(m)

    def of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index or -1, code of b or 0) of each context."""
        i = self.contexts.find(context)
        return i, np.where(i >= 0, self.b[np.maximum(i, 0)], 0).astype(np.uint16) if len(self.b) else np.zeros(len(i), np.uint16)

    def codes(self, i: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of f of each successor of the contexts of index i, searched between the pointers of its context."""
        out = np.full(len(i), ABSENT, np.uint16)
        at = np.flatnonzero(i >= 0)
        if len(at):
            x = i[at]
            j = self.successors.within(self.pointers.get(x).astype(np.int64), self.pointers.get(x + 1).astype(np.int64), (x.astype(np.uint64) << WIDTH) | word[at])
            out[at[j >= 0]] = self.f[j[j >= 0]]
        return out


# --- runs ------------------------------------------------------------------------


def _texts(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def _pieces(texts: list[bytes]):
    """(text's index, piece, is it the last) of at most shingles.RUN bytes, cut at white space; a longer word is whole."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > shingles.RUN:
            end = at + shingles.RUN
            while end < len(t) and t[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            yield i, t[at:end], False
            at = end
        yield i, t[at:], True


def tokens(texts: list[bytes]):
    """(hash, index of its text) of tokens in stretches of bounded size: each text's lower-cased words and then one end."""
    held, size = [], 0

    def done():
        word, piece = shingles.words([p for _, p, _ in held])
        n = np.bincount(piece, minlength=len(held))
        ends = np.array([e for _, _, e in held])
        base = np.cumsum(n + ends) - (n + ends)
        out = np.full(int((n + ends).sum()), END, np.uint64)
        out[base[piece] + np.arange(len(word)) - (np.cumsum(n) - n)[piece]] = word
        return out, np.repeat(np.array([i for i, _, _ in held]), n + ends)

    for p in _pieces(texts):
        if held and size + len(p[1]) > shingles.RUN:
            yield done()
            held, size = [], 0
        held.append(p)
        size += len(p[1])
    if held:
        yield done()


def token_runs(texts: list[bytes], most: int = RUN_TOKENS):
    """(hashes, texts' indices, the two tokens before, does the first text go on, does the last one) of bounded size."""
    h, d, n, lead, on = [], [], 0, (BEGIN, BEGIN), False

    def cut(last):
        nonlocal h, d, n, lead, on
        hh, dd = np.concatenate(h), np.concatenate(d)
        more = not last and hh[-1] != END
        out = (hh, dd, lead, on, more)
        before = np.concatenate([np.array([*(lead if on else (BEGIN, BEGIN))], np.uint64), hh])
        own = int((dd == dd[-1]).sum()) + (2 if on and dd[0] == dd[-1] else 0)
        lead = tuple(np.concatenate([np.full(2, BEGIN), before[len(before) - own :]])[-2:]) if more else (BEGIN, BEGIN)
        h, d, n, on = [], [], 0, more
        return out

    for hh, dd in tokens(texts):
        if not len(hh):
            continue
        for i in range(0, len(hh), most):
            part = slice(i, i + most)
            if n and n + len(hh[part]) > most:
                yield cut(False)
            h.append(hh[part])
            d.append(dd[part])
            n += len(hh[part])
    if n:
        yield cut(True)


def runs_of(docs: DataFrame, most: int) -> DataFrame:
    """The texts of (doc_id, text, train) as runs: run, ids and train of its texts, uid of each, shape and tokens.

    shape: numbers of tokens by text, the tokens before, and whether the first and the last text go on in other runs.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rewritten(batches):
        top = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        run = uid = 0
        for b in batches:
            first = uid
            for h, d, lead, begun, more in token_runs(_texts(b.column(1)), most):
                at = int(d[0])
                ids = b.column(0).slice(at, int(d[-1]) - at + 1)
                words, place, often = np.unique(h, return_inverse=True, return_counts=True)
                # Frequent words first, so that their places are short; in hash order otherwise.
                order = np.lexsort((words, -np.floor(np.log2(often))))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                words, place = words[order], rank[place]
                shape = packed(small(np.bincount(d - at)), np.array(lead, np.uint64), np.array([begun, more], np.uint8))
                own = np.arange(len(ids)) + first + at + top
                train = b.column(2).slice(at, len(ids))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                cols = [pa.array([top + run], pa.int64()), one(ids), one(train), one(pa.array(own, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([shape], pa.binary()), pa.array([packed(deltas(words))], pa.binary()), pa.array([packed(small(place))], pa.binary())], ["run", "ids", "train", "uid", "shape", "words", "tokens"])
                run += 1
            uid += b.num_rows

    schema = f"run long, ids array<{kind}>, train array<boolean>, uid array<long>, shape binary, words binary, tokens binary"
    return docs.select("doc_id", "text", "train").mapInArrow(rewritten, schema)


class Run:
    """One row of runs_of(), unpacked."""

    def __init__(self, row: dict):
        self.words = np.cumsum(unpacked(row["words"])[0], dtype=np.uint64)
        self.place = unpacked(row["tokens"])[0]
        self.n, lead, (self.begun, self.more) = unpacked(row["shape"])
        self.train = np.array(row["train"], bool)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.h = self.words[self.place]
        first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])
        second = np.concatenate([[False], first[:-1]])
        self.v = np.where(first, BEGIN, np.concatenate([[BEGIN], self.h[:-1]]))
        self.u = np.where(first | second, BEGIN, np.concatenate([[BEGIN, BEGIN], self.h[:-2]])[: len(self.h)])
        if self.begun:
            self.v[0], self.u[0] = lead[1], lead[0]
            if len(self.h) > 1 and not first[1]:
                self.u[1] = lead[1]

    def context(self, order: int) -> np.ndarray:
        one = context(self.u if order == 3 else self.v)
        return followed(one >> np.uint64(24), self.v & LOW) if order == 3 else one


def context(word: np.ndarray) -> np.ndarray:
    """The hash of a context of one word; all but its last 24 bits tell contexts apart."""
    return shingles.mixed(word, 0xC2)


def followed(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context of two words, from 40 bits of the context of the first and BITS of the second."""
    return shingles.mixed(shingles.mixed(ctx, 0xC3) + word * np.uint64(0x9E3779B97F4A7C15))


def _new(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of the keys."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _slots(ctx: np.ndarray) -> np.ndarray:
    return (ctx % np.uint64(SLOTS)).astype(np.int64)


def _totals(key: tuple[np.ndarray, ...], first: np.ndarray, salts: np.ndarray, shards: int):
    """Occurrences of dealt contexts for each shard that may hold a successor: (shard, *key, occurrences), by shard."""
    o = np.lexsort(key[::-1])
    new = np.flatnonzero(_new(*(k[o] for k in key))) if len(o) else o
    n, at = np.diff(np.append(new, len(o))), o[new]
    many = salts[at].astype(np.int64)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    shard = ((np.repeat(first[at], many) + step.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    o = np.argsort(shard, kind="stable")
    return shard[o], *(np.repeat(k[at], many)[o] for k in key), np.repeat(n, many)[o]


class Pairs:
    """The distinct pairs of a run whose first word is dealt, in the order in which they are sent: by shard, context, word."""

    def __init__(self, run: Run, shards: int, level: np.ndarray, salt: int):
        ctx = run.context(2)
        deal = level[_slots(ctx)]
        self.tokens = np.flatnonzero(deal)
        ctx, h, deal, train = ctx[self.tokens], run.h[self.tokens], deal[self.tokens], run.train[run.doc][self.tokens]
        salts = np.minimum(np.uint64(shards), np.uint64(salt) ** deal.astype(np.uint64))
        first = (ctx >> np.uint64(20)) % np.uint64(shards)
        # 40 bits tell contexts apart.
        key = ((first + shingles.mixed(h, 0x5A) % salts) % np.uint64(shards) << np.uint64(40)) | (ctx >> np.uint64(24))
        o = np.lexsort((h & LOW, key))
        k, w = key[o], (h & LOW)[o]
        new, newk = _new(k, w), _new(k)
        self.gram_of, self.ctx_of = np.empty(len(o), np.int64), np.empty(len(o), np.int64)
        self.gram_of[o], self.ctx_of[o] = np.cumsum(new) - 1, np.cumsum(newk) - 1
        at = np.flatnonzero(new)
        self.key, self.w, self.ctx_at = k[at], w[at], np.flatnonzero(newk[at])
        self.count = np.bincount(self.gram_of, weights=train, minlength=len(at)).astype(np.int64)
        self.dealt = _totals(((ctx >> np.uint64(24))[train],), first[train], salts[train], shards)

    def fragments(self):
        """(shard, payload): contexts, their numbers of successors, those and their counts; dealt contexts and occurrences."""
        shard, (hot, ctx40, times) = (self.key >> np.uint64(40)).astype(np.int64), self.dealt
        ctx = self.key[self.ctx_at] & np.uint64((1 << 40) - 1)
        n = np.diff(np.append(self.ctx_at, len(self.key)))
        for s in np.union1d(shard, hot).tolist():
            a, b = np.searchsorted(shard, [s, s + 1])
            i, j = np.searchsorted(self.ctx_at, [a, b])
            x, y = np.searchsorted(hot, [s, s + 1])
            yield s, packed(deltas(ctx[i:j]), small(n[i:j]), self.w[a:b].astype(np.uint32), small(self.count[a:b]), ctx40[x:y], small(times[x:y]))


class Triples:
    """The distinct n-grams (u, v, w) of a run in the order in which they are sent: by shard, v, u, w; and its pairs by shard, v, w."""

    def __init__(self, run: Run, shards: int, level: dict[int, np.ndarray], salt: int):
        ctx, u, w = run.context(2), run.u & LOW, run.h & LOW
        train = run.train[run.doc]
        deal, deal3 = level[2][_slots(ctx)], level[3][_slots(run.context(3))]
        salts = [np.minimum(np.uint64(shards), np.uint64(salt) ** d.astype(np.uint64)) for d in (deal, deal3)]
        first = (ctx >> np.uint64(20)) % np.uint64(shards) + shingles.mixed(u, 0x51) % salts[0]
        key = ((first + np.where(deal3 > 0, shingles.mixed(run.h, 0x5A) % salts[1], np.uint64(0))) % np.uint64(shards) << np.uint64(40)) | (ctx >> np.uint64(24))
        # Ranks within the run are short, so that an n-gram is one number, which is sorted far faster than three.
        keys, k = np.unique(key, return_inverse=True)
        low = distinct(run.words & LOW, u[:2], np.array([BEGIN & LOW]))
        r = np.searchsorted(low, run.words & LOW)[run.place]
        before = np.concatenate([r[:2], r[:-2]])[: len(r)]
        other = np.flatnonzero(low[before] != u)
        before[other] = np.searchsorted(low, u[other])
        bits, more = len(low).bit_length(), len(keys).bit_length()
        if 2 * bits + more > 63:
            raise ValueError("a run of too many tokens")
        shift, two = np.uint64(bits), np.uint64(2 * bits)
        self._v, self._w = k.astype(np.uint64), r.astype(np.uint64)
        self._gram, self._shift = (self._v << two) | (before.astype(np.uint64) << shift) | self._w, shift
        x = np.sort((self._gram << np.uint64(1)) | train)
        at = np.flatnonzero(_new(x >> np.uint64(1)))
        seen = np.concatenate([np.zeros(1, np.int64), np.cumsum(x & np.uint64(1), dtype=np.int64)])
        self.count = seen[np.append(at[1:], len(x))] - seen[at]
        x = x[at] >> np.uint64(1)
        self.key, mask = keys[(x >> two).astype(np.int64)], np.uint64((1 << bits) - 1)
        self.uw = (low[((x >> shift) & mask).astype(np.int64)] << WIDTH) | low[(x & mask).astype(np.int64)]
        self.ctx_at, self.v_at = np.flatnonzero(_new(x >> shift)), np.flatnonzero(_new(x >> two))
        dealt = np.zeros(len(keys), np.uint8)
        dealt[k] = deal > 0
        self.hot = dealt[(x[self.v_at] >> two).astype(np.int64)]
        on = np.flatnonzero((deal3 > 0) & train)
        self.dealt = _totals(((ctx >> np.uint64(24))[on], u[on]), first[on], salts[1][on], shards)

    def places(self) -> tuple[np.ndarray, ...]:
        """Of each token its n-gram, its context, the middle word and the pair, as numbers in the order in which they are sent."""
        gram_of, ctx_of, pair_of = (np.empty(len(self._gram), np.int64) for _ in range(3))
        o = np.argsort(self._gram)
        x = self._gram[o]
        gram_of[o], ctx_of[o] = np.cumsum(_new(x)) - 1, np.cumsum(_new(x >> self._shift)) - 1
        pair = (self._v << self._shift) | self._w
        o = np.argsort(pair)
        pair_of[o] = np.cumsum(_new(pair[o])) - 1
        return gram_of, ctx_of, self._v.astype(np.int64), pair_of

    def fragments(self):
        """(shard, payload): v, are they dealt, their numbers of u; u, their numbers of w; w and their counts; dealt (v, u) and occurrences."""
        shard, (hot, v40, u32, times) = (self.key >> np.uint64(40)).astype(np.int64), self.dealt
        v = self.key[self.v_at] & np.uint64((1 << 40) - 1)
        n_w = np.diff(np.append(self.ctx_at, len(self.key)))
        n_u = np.diff(np.append(np.searchsorted(self.ctx_at, self.v_at), len(self.ctx_at)))
        for s in np.union1d(shard, hot).tolist():
            a, b = np.searchsorted(shard, [s, s + 1])
            i, j = np.searchsorted(self.ctx_at, [a, b])
            c, d = np.searchsorted(self.v_at, [a, b])
            x, y = np.searchsorted(hot, [s, s + 1])
            u, w = (self.uw[self.ctx_at[i:j]] >> WIDTH).astype(np.uint32), (self.uw[a:b] & LOW).astype(np.uint32)
            yield s, packed(deltas(v[c:d]), self.hot[c:d], small(n_u[c:d]), u, small(n_w[i:j]), w, small(self.count[a:b]), v40[x:y], u32[x:y].astype(np.uint32), small(times[x:y]))


def _rows(batches, columns):
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in columns}


def _sent(got: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    run, shard, payload = zip(*got) if got else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(shard, pa.int32()), pa.array(payload, pa.binary())], ["run", "shard", "payload"])


COLUMNS = ["words", "tokens", "shape", "train"]
ANSWERS = "run long, shard int, payload binary, n long, v long, hot array<int>, hotter array<int>, hottest array<int>"


def _answer(rows: list[tuple[int, int, bytes]], totals: tuple | None, hot: list[np.ndarray]) -> pa.Table:
    """Answers by run, then one row of the shard's own: tokens, words, and the slots of contexts that are to be dealt."""
    run, shard, payload = (list(x) for x in zip(*rows)) if rows else ([], [], [])
    n = len(rows)
    none = lambda k: [None] * n + [k]
    t = totals or (None, None)
    cols = [pa.array([*run, None], pa.int64()), pa.array([*shard, None], pa.int32()), pa.array([*payload, None], pa.binary()), pa.array(none(t[0]), pa.int64()), pa.array(none(t[1]), pa.int64())]
    return pa.Table.from_arrays([*cols, *(pa.array(none(x), pa.list_(pa.int32())) for x in hot)], ["run", "shard", "payload", "n", "v", "hot", "hotter", "hottest"])


def _dealt(ctx: np.ndarray, count: np.ndarray, hot: int, salt: int) -> list[np.ndarray]:
    """Slots of the contexts of more than hot, salt * hot, salt**2 * hot occurrences."""
    return [np.unique(ctx[count > hot * salt**k] % np.uint64(SLOTS)).astype(np.int32) for k in range(DEPTH)]


def _unigrams(runs: DataFrame, shards: int, hot: int, salt: int) -> DataFrame:
    """Each run's words with their counts in training texts, by shard of the word; a run's words are sent once."""

    def ask(batches):
        for row in _rows(batches, ["run", *COLUMNS]):
            r = Run(row)
            order = np.argsort(r.words)
            words = r.words[order]
            count = np.bincount(r.place, weights=r.train[r.doc], minlength=len(words)).astype(np.int64)[order]
            shard = ((words >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
            cut = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            yield _sent([(row["run"], int(shard[i]), packed(deltas(words[i:j]), small(count[i:j]))) for i, j in zip(cut, [*cut[1:], len(shard)])])

    def answer(t: pa.Table) -> pa.Table:
        parts = [unpacked(p) for p in t["payload"].to_pylist()]
        words = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(known)).astype(np.int64)
        cut = np.cumsum([0, *map(len, words)]).tolist()
        rows = [(run, s, packed(small(count[at[i:j]]))) for run, s, i, j in zip(t["run"].to_pylist(), t["shard"].to_pylist(), cut, cut[1:])]
        # A word is the context of pairs.
        return _answer(rows, (int(count.sum()), int((count > 0).sum())), _dealt(context(known), count, hot, salt))

    return runs.select("run", *COLUMNS).mapInArrow(ask, FRAGMENTS).groupBy("shard").applyInArrow(answer, ANSWERS)


def _cat(parts: list, k: int, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]).astype(kind, copy=False)


def _sums(parts: list, k: int) -> np.ndarray:
    """The numbers whose differences each part holds."""
    return np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(p[k], dtype=np.uint64) for p in parts)])


def _spans(parts: list, k: int) -> list[tuple[int, int]]:
    cut = np.cumsum([0, *(len(p[k]) for p in parts)]).tolist()
    return list(zip(cut, cut[1:]))


def _searched(trie: Trie, i: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Codes of f, each distinct (context's index, word) looked up once."""
    key = (np.where(i < 0, 1 << 31, i).astype(np.uint64) << WIDTH) | word
    key, back = np.unique(key, return_inverse=True)
    known = int(np.searchsorted(key, np.uint64(1 << 31) << WIDTH))
    out = np.full(len(key), ABSENT, np.uint16)
    if known * DENSE > trie.successors.n:
        # Nearly all successors are asked for, in their order.
        j = trie.successors.merged(key[:known])
        out[:known][j >= 0] = trie.f[j[j >= 0]]
        return out[back]
    for k in range(0, known, STRETCH):
        own = key[k : min(known, k + STRETCH)]
        out[k : k + len(own)] = trie.codes((own >> WIDTH).astype(np.int64), own & LOW)
    return out[back]


def _pairs(runs: DataFrame, shards: int, level: np.ndarray, hot: int, salt: int) -> DataFrame:
    """Codes of f and b for each run's pairs whose first word is dealt."""

    def ask(batches):
        for row in _rows(batches, ["run", *COLUMNS]):
            yield _sent([(row["run"], s, p) for s, p in Pairs(Run(row), shards, level, salt).fragments()])

    def answer(t: pa.Table) -> pa.Table:
        parts = [unpacked(p) for p in t["payload"].to_pylist()]
        asked, successors, w = _sums(parts, 0), _cat(parts, 1, np.int64), _cat(parts, 2, np.uint64)
        trie, often = built(2, np.repeat(asked, successors), w, _cat(parts, 3, np.int64), _cat(parts, 4, np.uint64), _cat(parts, 5, np.int64), hot)
        i, b = trie.of(asked)
        f = _searched(trie, np.repeat(i, successors), w)
        ids = zip(t["run"].to_pylist(), t["shard"].to_pylist(), _spans(parts, 2), _spans(parts, 0))
        return _answer([(run, s, packed(f[x:y], b[c:d])) for run, s, (x, y), (c, d) in ids], None, _dealt(*often, hot, salt))

    return runs.select("run", *COLUMNS).mapInArrow(ask, FRAGMENTS).groupBy("shard").applyInArrow(answer, ANSWERS)


def _triples(runs: DataFrame, shards: int, level: dict[int, np.ndarray], hot: int, salt: int) -> DataFrame:
    """Codes of f and b for each run's n-grams of three words, and for its pairs whose first word isn't dealt."""

    def ask(batches):
        for row in _rows(batches, ["run", *COLUMNS]):
            yield _sent([(row["run"], s, p) for s, p in Triples(Run(row), shards, level, salt).fragments()])

    def answer(t: pa.Table) -> pa.Table:
        parts = [unpacked(p) for p in t["payload"].to_pylist()]
        cut = [_spans(parts, k) for k in (0, 3, 5)]
        v, dealt, n_u = _sums(parts, 0), _cat(parts, 1, np.uint8) > 0, _cat(parts, 2, np.int64)
        u, n_w = _cat(parts, 3, np.uint64), _cat(parts, 4, np.int64)
        w, m = _cat(parts, 5, np.uint64), _cat(parts, 6, np.int64)
        far = _cat(parts, 7, np.uint64), _cat(parts, 8, np.uint64), _cat(parts, 9, np.int64)
        parts = None
        words = distinct(v, far[0])
        # A context of two words is the first one's bits after the place of the second one.
        pair = lambda a, b: (np.searchsorted(words, a).astype(np.uint64) << WIDTH) | b
        ctx = pair(np.repeat(v, n_u), u)
        trie, _ = built(3, np.repeat(ctx, n_w), w, m, pair(*far[:2]), far[2], hot)
        i, b3 = trie.of(ctx)
        f3 = _searched(trie, np.repeat(i, n_w), w)
        # Pairs come from the same counts: once by v and w in each fragment.
        own = np.repeat(np.repeat(np.arange(len(v)), n_u), n_w)
        near = ~dealt[own]
        trie, _ = built(2, v[own[near]], w[near], m[near], np.zeros(0, np.uint64), np.zeros(0, np.int64), hot)
        pairs = distinct((own.astype(np.uint64) << WIDTH) | w)
        own = (pairs >> WIDTH).astype(np.int64)
        i, b2 = trie.of(v)
        i[dealt] = -1
        f2 = _searched(trie, i[own], pairs & LOW)
        rows = []
        for run, s, (a, b), (c, d), (x, y) in zip(t["run"].to_pylist(), t["shard"].to_pylist(), *cut):
            p, q = np.searchsorted(own, [a, b])
            rows.append((run, s, packed(f3[x:y], b3[c:d], f2[p:q], b2[a:b])))
        return _answer(rows, None, [np.zeros(0, np.int32)] * DEPTH)

    return runs.select("run", *COLUMNS).mapInArrow(ask, FRAGMENTS).groupBy("shard").applyInArrow(answer, ANSWERS)


def built(order: int, ctx: np.ndarray, w: np.ndarray, m: np.ndarray, dealt: np.ndarray, times: np.ndarray, hot: int) -> tuple[Trie, tuple[np.ndarray, np.ndarray]]:
    """The trie of n-grams (ctx, w) with their counts m, which may repeat; and those of more than `hot`.

    dealt and times: contexts whose successors are in other shards, too, and parts of their occurrences.
    """
    on = m > 0
    contexts = distinct(ctx[on], dealt)
    key = (np.searchsorted(contexts, ctx[on]).astype(np.uint64) << WIDTH) | w[on]
    order_ = np.argsort(key)
    key, c = key[order_], m[on][order_].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, c = key[new], np.add.reduceat(c, new) if len(new) else c
    owner = (key >> WIDTH).astype(np.int64)
    n = np.bincount(owner, weights=c, minlength=len(contexts))
    known = np.bincount(owner, minlength=len(contexts))
    total = np.bincount(np.searchsorted(contexts, dealt), weights=times, minlength=len(contexts))
    spread = total > 0
    n = np.where(spread, total, n)
    b = np.where(spread, MASS[order] / (n + MASS[order]), DISCOUNT[order] * known / np.maximum(n, 1))
    f = np.where(spread[owner], (1 - b[owner]) * c / n[owner], (c - DISCOUNT[order]) / n[owner])
    common = np.flatnonzero(c > hot)
    return Trie.mapped(contexts, b, owner, key & LOW, f), (followed(contexts[owner[common]], key[common] & LOW), c[common])


def _levels(answers: DataFrame, always: np.ndarray) -> np.ndarray:
    """For each slot how far its contexts are dealt; at most SLOTS / 32 rows come to the driver."""
    level = np.zeros(SLOTS, np.uint8)
    for k, c in enumerate(["hot", "hotter", "hottest"][:DEPTH]):
        words = answers.where(f"{c} is not null").select(F.explode(c).alias("b")).groupBy(F.shiftright("b", 5).alias("w"))
        for r in words.agg(F.bit_or(F.expr("shiftleft(1L, b & 31)")).alias("m")).collect():
            level[r.w * 32 + np.flatnonzero([(r.m >> i) & 1 for i in range(32)])] = k + 1
    level[(always % np.uint64(SLOTS)).astype(np.int64)] = DEPTH
    return level


def scored(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 7 = 2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (base 10 logarithms).

    held_out is an expression over doc_id; such rows don't train. Null text counts as empty and has its end token
    alone. Repeated rows train, and are scored, as often as they occur; null ids train. Without training rows N and V are
    0 and both scores agree. Texts of any length are worked on in stretches.
    """
    short_batches(docs.sparkSession)
    d = pruned(docs, id_col, text_col).toDF("doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, hot, salt = int(max(8, -(-size // SHARD_BYTES))), HOT, SALT
    kind = d.schema["doc_id"].dataType.simpleString()
    runs = bucketed(runs_of(d.withColumn("train", ~F.expr(f"coalesce({held_out}, false)")), RUN_TOKENS), "runs", "run", size // (8 * RUN_TOKENS))
    uni = written(_unigrams(runs, shards, hot, salt), "unigrams")
    n_train, n_words = (x or 0 for x in uni.agg(F.sum("n"), F.sum("v")).first())
    # Each text has an occurrence of the contexts before its first word.
    begin = np.array([BEGIN])
    levels = {2: _levels(uni, context(begin))}
    pairs = written(_pairs(runs, shards, levels[2], hot, salt), "pairs")
    levels[3] = _levels(pairs, followed(context(begin) >> np.uint64(24), begin & LOW))
    triples = _triples(runs, shards, levels, hot, salt)
    answers = None
    for order, x in ((1, uni), (2, pairs), (3, triples)):
        x = x.where("run is not null").select("run", F.lit(order).alias("order"), "shard", "payload")
        answers = x if answers is None else answers.union(x)

    def finished(own: pa.Table, got: pa.Table) -> pa.Table:
        row = next(_rows(own.to_batches(), ["run", *COLUMNS, "uid"]))
        r, ids = Run(row), own["ids"].combine_chunks().flatten()
        got = got.sort_by([("order", "ascending"), ("shard", "ascending")])
        parts = {k: [unpacked(p) for o, p in zip(got["order"].to_pylist(), got["payload"].to_pylist()) if o == k] for k in (1, 2, 3)}
        c = np.empty(len(r.words))
        c[np.argsort(r.words)] = np.concatenate([p[0] for p in parts[1]])
        c = c[r.place]
        p1 = (c + 1) / (n_train + n_words + 1)
        cat = lambda order, k: valued(_cat(parts[order], k, np.uint16))
        g, few = Triples(r, shards, levels, salt), Pairs(r, shards, levels[2], salt)
        gram_of, ctx_of, v_of, pair_of = g.places()
        f, b = cat(3, 2)[pair_of], cat(3, 3)[v_of]
        f[few.tokens], b[few.tokens] = cat(2, 0)[few.gram_of], cat(2, 1)[few.ctx_of]
        p = cat(3, 0)[gram_of] + cat(3, 1)[ctx_of] * (f + b * p1)
        of = lambda x: np.bincount(r.doc, weights=x, minlength=len(r.n))
        whole = np.ones(len(r.n), bool)
        whole[0] &= not r.begun
        whole[-1] &= not r.more
        cols = [ids, pa.array(row["uid"], pa.int64()), pa.array(whole), pa.array(~r.train), pa.array(r.n.astype(np.int64)), pa.array(of(c > 0).astype(np.int64)), pa.array(of(np.log10(p1))), pa.array(of(np.log10(p)))]
        return pa.Table.from_arrays(cols, ["doc_id", "uid", "whole", "held_out", "n_tokens", "n_known", "base_score", "score"])

    schema = f"doc_id {kind}, uid long, whole boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = written(runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(finished, schema), "scores")
    sums = [F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]
    parts = out.where("not whole").groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    names = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score"]
    return out.where("whole").select(*names).union(parts.select(*names))
