"""N-gram Jaccard join by PartEnum signatures.

Two sets of sizes in neighbouring bands whose Jaccard similarity reaches the threshold differ in at most k elements, k
known by band. The domain of hashes is cut into n1 * n2 parts; with at most k differences one of the n1 first-level
parts has at most K of them, so some n2 - K of its n2 second-level parts agree entirely. A set's signatures are the
sums over all such subsets of parts; similar sets share one. A part without elements says nothing. So there are some
spare parts, and similar sets agree in more subsets than there are spare ones: unless both have more empty subsets than
that, they share one with elements. A set that has more gets signatures of a further cut as well.

Signatures travel packed, and of those that a task's own rows share only one goes on, so that a very common one weighs
once for each piece of the input. Sets that share a signature are candidates. Before any set travels, parities of hashed
bits tell pairs apart that are too far from each other for certain: no more bits differ than elements do. In turns each
set meets its nearest candidate among two sets for each of its signatures, of other linked parts than its own, which
links most of what is alike; then only pairs of sets meet that are in different parts and still share a signature. Each
time sets meet in tasks of bounded size and are compared exactly.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.components import components
from meltemi.llm.packing import deltas, packed, unpacked
from meltemi.llm.shared import pruned, short_batches, trimmed, written
from meltemi.llm.shingles import mixed, runs, shingle_sets

#: Second-level parts and the differences that one first-level part may hold.
N2, K = 2, 1
LEVELS = 4
#: Sets that meet one set in a task, and rows of one signature that do.
BLOCK, GROUP = 512, 4096
#: Signatures that a task sorts at once (some 50 MB), and bytes of text for each shard of signatures.
PIECE, SHARD_BYTES = 1 << 19, 8 << 20
#: The turns end when one adds less than this part of all links.
TURN = 50
#: Pairs of candidates told apart at once.
PAIRS = 1 << 18
#: Bits of the filter that keeps texts without candidates from being shuffled: 512 KB at any size of the corpus.
FILTER_BITS = 1 << 22
SUBSETS = tuple(itertools.combinations(range(N2), N2 - K))


class Bands:
    """Band of a size and differences allowed in each band, for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.right, self.parts, self.spare = num, den, [0], [], []

    def _longer(self) -> None:
        left = self.right[-1] + 1
        self.right.append(max(left, left * self.den // self.num))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """From 1; sets at the threshold are in the same band or in neighbouring ones."""
        while self.right[-1] < sizes.max(initial=0):
            self._longer()
        return np.searchsorted(np.array(self.right), sizes)

    def differences(self, band: np.ndarray) -> np.ndarray:
        while len(self.right) <= band.max(initial=0):
            self._longer()
        return 2 * np.array(self.right)[band] * (self.den - self.num) // (self.den + self.num)

    def cuts(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first-level parts, empty parts that a set may have) of each band's cuts."""
        at = band.max(initial=0) + 1
        if len(self.parts) < at:
            every = np.arange(len(self.parts), at)
            for b, k in zip(every.tolist(), self.differences(every).tolist()):
                # Sets of the lower of the two bands that meet here are the smallest ones.
                n1 = self._parts(k, max(1, int(self.right[b] * (self.num / self.den) ** 1.5)))
                self.parts.append(n1)
                self.spare.append(n1 * N2 - k - 1)
        return np.array(self.parts)[band], np.array(self.spare)[band]

    @staticmethod
    def _parts(k: int, n: int) -> int:
        """First-level parts for which a set of n elements is expected to need the fewest signatures, all cuts together."""
        if not k:
            return 1
        least = -(-(k + 1) // (K + 1))
        n1 = np.arange(least, least + 8 + least // 2)
        mean = n1 * N2 * np.exp(-n / (n1 * N2))
        spare = n1 * N2 - k - 1
        # Chance of more empty parts than spare ones, by the normal law.
        more = [0.5 * math.erfc((s + 0.5 - m) / math.sqrt(2 * m + 1e-9)) for s, m in zip(spare.tolist(), mean.tolist())]
        return int(n1[np.argmin(n1 * (1 + 1.3 * np.array(more)))])


def signatures(h: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) for sets given as by shingle_sets()."""
    out, owner = [], []
    own = bands.of(n)
    doc = np.repeat(np.arange(len(n)), n)
    g = mixed(h, 0x5EED)
    for up in (0, 1):
        band = own + up
        exact = bands.differences(band) == 0
        n1, spare = bands.cuts(band)
        wanted = np.asarray(n) > 0
        for level in range(LEVELS):
            if not wanted.any():
                break
            m = wanted[doc]
            d, hh, gg = doc[m], mixed(h[m], 0xABCD + 7919 * level), g[m]
            width = np.where(wanted, n1 * N2, 0)
            base = np.cumsum(width) - width
            first = ((hh >> np.uint64(32)) % n1[d].astype(np.uint64)).astype(np.int64)
            second = np.where(exact[d], 0, ((hh & np.uint64(0xFFFFFFFF)) % np.uint64(N2)).astype(np.int64))
            at = base[d] + first * N2 + second
            sums, count = np.zeros(width.sum(), np.uint64), np.bincount(at, minlength=width.sum())
            np.add.at(sums, at, gg)
            many = np.where(wanted, n1, 0)
            who = np.repeat(np.arange(len(n)), many)
            place = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            sums, count = sums.reshape(-1, N2), count.reshape(-1, N2)
            empty = np.zeros(len(n), np.int64)
            subsets = []
            for x, subset in enumerate(SUBSETS):
                s, c = sums[:, subset].sum(1, dtype=np.uint64), count[:, subset].sum(1)
                # Without differences the whole set is the one signature.
                held = ~exact[who] if x else np.ones(len(who), bool)
                empty += np.bincount(who[held & (c == 0)], minlength=len(n))
                subsets.append((x, s, c, held))
            again = wanted & (empty > spare)
            for x, s, c, held in subsets:
                keep = held & ((c > 0) | again[who] & (level == LEVELS - 1))
                # Band, level, first-level part and subset take part in the sum.
                tag = (band[who].astype(np.uint64) << np.uint64(32)) + (place * len(SUBSETS) + x).astype(np.uint64) + np.uint64(level << 60)
                out.append(mixed(s + mixed(tag))[keep])
                owner.append(who[keep])
            wanted = again
    return np.concatenate(out), np.concatenate(owner)


def _texts(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def nodes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever document holds it."""
    end = np.cumsum(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h, 0xFACE), dtype=np.uint64)])
    return mixed(total[end] - total[end - n] + n.astype(np.uint64)).view(np.int64)


def parities(h: np.ndarray, n: np.ndarray, bands: Bands) -> list[bytes]:
    """For each set the parity of its elements in each of a power of two of places, sixteen times its allowed differences."""
    allowed = bands.differences(bands.of(n))
    words = 1 << np.ceil(np.log2(np.maximum(1, allowed / 4))).astype(np.int64)
    first = np.cumsum(words) - words
    doc = np.repeat(np.arange(len(n)), n)
    at = (mixed(h, 0xB175) & (words[doc] * 64 - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, first[doc] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return [out[i : i + k].tobytes() for i, k in zip(first.tolist(), words.tolist())]


def near(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketch: list[bytes], num: int, den: int) -> np.ndarray:
    """Bits that differ between the parities of sets i and j (pairwise), or -1 where they can't reach num / den."""
    a, b = n[i], n[j]
    out = np.full(len(i), -1)
    words = np.array([len(x) // 8 for x in sketch], np.int64)
    ok = np.flatnonzero(np.minimum(a, b) * den >= np.maximum(a, b) * num)
    # Places are powers of two, so the halves of a longer one add up to a shorter one.
    for k in np.unique(words[i[ok]]).tolist():
        for m in np.unique(words[j[ok[words[i[ok]] == k]]]).tolist():
            at = ok[(words[i[ok]] == k) & (words[j[ok]] == m)]
            width = min(k, m)
            for x in range(0, len(at), max(1, (PAIRS * 4) // width)):
                p = at[x : x + max(1, (PAIRS * 4) // width)]
                own = lambda ids, w: _folded(ids, w, width, sketch)
                d = np.bitwise_count(own(i[p], k) ^ own(j[p], m)).sum(1, dtype=np.int64)
                out[p] = np.where(d * (den + num) <= (a[p] + b[p]) * (den - num), d, -1)
    return out


def _folded(ids: np.ndarray, words: int, width: int, sketch: list[bytes]) -> np.ndarray:
    unique, at = np.unique(ids, return_inverse=True)
    x = np.frombuffer(b"".join(sketch[k] for k in unique.tolist()), np.uint64).reshape(len(unique), words // width, width)
    return np.bitwise_xor.reduce(x, axis=1)[at]


def with_parities(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n (size of its set), node (64-bit hash of the set, null if empty), sketch (parities)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bands = Bands(num, den)
        for b in trimmed(batches):
            texts = _texts(b.column(1))
            for i, j in runs(texts):
                h, n = shingle_sets(texts[i:j], k)
                cols = [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(nodes(h, n), pa.int64(), mask=n == 0), pa.array(parities(h, n, bands), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "node", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, node long, sketch binary")


def _shared(docs: DataFrame, k: int, num: int, den: int, shards: int) -> DataFrame:
    """(sig, node) of every set and each of its signatures that some other set has as well; rows may repeat."""

    def sent(batches):
        bands = Bands(num, den)

        def piece(held):
            sig, node = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
            sig, node = sig[new], node[new]
            head = np.concatenate([[True], sig[1:] != sig[:-1]])
            size = np.diff(np.append(np.flatnonzero(head), len(sig)))
            many = np.repeat(size > 1, size)
            out = []
            # What these rows share by themselves is known already and only passes through, by whatever shard.
            for kind, keep in ((0, head), (1, many)):
                s, d = sig[keep], node[keep]
                shard = ((s >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                if kind and len(s):
                    shard = np.full(len(s), int(d[0]) % shards)
                cut = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                for a, b in zip(cut, [*cut[1:], len(s)]):
                    ids, local = np.unique(d[a:b], return_inverse=True)
                    local = local.astype(np.uint16 if len(ids) <= 65536 else np.uint32)
                    out.append((int(shard[a]), packed(np.array([kind], np.uint8), deltas(s[a:b]), local, ids.view(np.uint64))))
            cols = [pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "payload"])

        held, size = [], 0
        for b in trimmed(batches):
            texts = _texts(b.column(0))
            for i, j in runs(texts):
                h, n = shingle_sets(texts[i:j], k)
                if not len(h):
                    continue
                s, owner = signatures(h, n, bands)
                held.append((s, nodes(h, n)[owner]))
                size += len(s)
                if size >= PIECE:
                    yield piece(held)
                    held, size = [], 0
        if held:
            yield piece(held)

    def met(t: pa.Table) -> pa.Table:
        sig, node, known = [], [], []
        for p in t["payload"]:
            kind, delta, local, ids = unpacked(p.as_buffer().to_pybytes())
            (known if kind[0] else sig).append(np.cumsum(delta, dtype=np.uint64) if not kind[0] else (np.cumsum(delta, dtype=np.uint64), ids[local]))
            if not kind[0]:
                node.append(ids[local])
        cat = lambda x: np.concatenate([np.zeros(0, np.uint64), *x])
        sig, node = cat(sig), cat(node)
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        same = s[1:] == s[:-1]
        keep = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(s) else order
        sig, node = np.concatenate([sig[keep], cat([x for x, _ in known])]), np.concatenate([node[keep], cat([x for _, x in known])])
        return pa.table({"sig": sig.view(np.int64), "node": node.view(np.int64)})

    return docs.select("text").mapInArrow(sent, "shard int, payload binary").groupBy("shard").applyInArrow(met, "sig long, node long")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets reach the threshold. Sets travel once for each task that needs them."""
    few = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("tasks"))
    dealt = pairs.join(few, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("tasks")).cast("int").alias("block"))
    rows = dealt.select("u", "block", F.col("v").alias("node")).union(dealt.select("u", "block", F.col("u").alias("node")).distinct())
    rows = written(rows.join(reps, "node"), "tasks")
    # Tasks are filled up with the sets of several u.
    rows = rows.withColumn("task", F.pmod(F.xxhash64("u", "block"), F.lit(1 + rows.count() // BLOCK)))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = rows.select(bit.alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("m"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.collect():  # at most FILTER_BITS / 32 rows
        bits[r.w] = r.m
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in trimmed(batches):
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1, pa.bool_()) if len(at) else pa.array([], pa.bool_()))
            texts = _texts(b.column(1))
            for i, j in runs(texts):
                h, n = shingle_sets(texts[i:j], k)
                end = np.cumsum(n)
                cols = [b.column(0).slice(i, j - i), pa.array(nodes(h, n)), pa.array([h[e - c : e].tobytes() for c, e in zip(n, end)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "h"])

    # An id may stand for several texts, hence the node as well; equal rows give equal sets.
    sets = docs.select("doc_id", "text", bit.cast("int").alias("b")).mapInArrow(run, f"doc_id {kind}, node long, h binary")

    def compared(t: pa.Table) -> pa.Table:
        u, node = t["u"].to_numpy(), t["node"].to_numpy()
        h = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["h"].combine_chunks()]
        own = {x: k for k, (x, y) in enumerate(zip(u.tolist(), node.tolist())) if x == y}
        out = set()
        for x, y, b in zip(u.tolist(), node.tolist(), h):
            if x != y and (x, y) not in out:
                a = h[own[x]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both * den >= (len(a) + len(b) - both) * num:
                    out.add((x, y))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    # Merged at every size, so that what is shuffled grows with the input and not in a jump.
    met = rows.hint("merge").join(sets, ["doc_id", "node"]).select("task", "u", "node", "h")
    return written(met.groupBy("task").applyInArrow(compared, "u long, v long"), "links")


def _across(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) of sets that share a signature, are in different parts and near by their parities.

    rows: sig, node, part, n, sketch, and tasks, the number of blocks of the signature's rows: each two blocks meet.
    """
    block = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("tasks")).cast("int")
    x = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    x = x.select(F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "node", "part", "n", "sketch")

    def run(batches):
        """Rows come in order of their group; a group may stretch over batches."""
        rest = None
        for b in batches:
            t = b.to_pandas()
            t = t if rest is None else pd.concat([rest, t], ignore_index=True)
            last = t["group"].to_numpy() == t["group"].iloc[-1] if len(t) else np.zeros(0, bool)
            rest, t = t[last], t[~last]
            if len(t):
                yield from told(t)
        if rest is not None and len(rest):
            yield from told(rest)

    def told(t):
        group, node, part = t["group"].to_numpy(), t["node"].to_numpy(), t["part"].to_numpy()
        n, sketch = t["n"].to_numpy(), t["sketch"].tolist()
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        # Row r meets the rows after it in its group.
        ends = np.repeat(first + size, size)
        at = 0
        while at < len(group):
            todo = np.cumsum(ends[at:] - np.arange(at, len(group)) - 1)
            stop = at + max(1, int(np.searchsorted(todo, PAIRS, "right")))
            r = np.arange(at, stop)
            many = ends[at:stop] - r - 1
            i = np.repeat(r, many)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            keep = (part[i] != part[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
            i, j = i[keep], j[keep]
            keep = near(i, j, n, sketch, num, den) >= 0
            a, b = node[i[keep]], node[j[keep]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["u", "v"])
            at = stop

    sorted_ = x.repartition("group").sortWithinPartitions("group")
    return sorted_.mapInArrow(run, "u long, v long").distinct()


def _links(docs: DataFrame, sets: DataFrame, shards: int, k: int, num: int, den: int) -> DataFrame:
    """Links (u, v) of nodes that connect the same nodes as all pairs at the threshold do."""
    shared = written(_shared(docs, k, num, den, shards), "shared")
    # One document stands for a node.
    reps = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    used = shared.select("node").distinct()
    reps = written(reps.join(used, "node", "left_semi"), "nodes")
    ids, sketches = reps.select("node", "doc_id"), reps.select("node", "n", "sketch")
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def told(batches):
        for b in batches:
            m = b.num_rows
            n = np.concatenate([b.column("n_u").to_numpy(), b.column("n_v").to_numpy()])
            d = near(np.arange(m), np.arange(m, 2 * m), n, _texts(b.column("s_u")) + _texts(b.column("s_v")), num, den) if m else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(d, pa.int64())], ["u", "v", "d"]).filter(pa.array(d >= 0))

    # In turns: each set meets the nearest of those that stand for its signatures and are in another part than its own.
    parts = found = tested = None
    total = 0
    while True:
        # At first each set is a part of its own.
        rows = shared.withColumn("part", F.col("node")) if parts is None else shared.join(parts.select("node", "part"), "node")
        ends = rows.groupBy("sig").agg(F.min(F.struct("part", "node")).alias("a"), F.max(F.struct("part", "node")).alias("b")).where("a.part < b.part")
        ends = ends.select("sig", F.explode(F.array("a", "b")).alias("x")).select("sig", F.col("x.node").alias("u"), F.col("x.part").alias("own"))
        edges = rows.join(ends, "sig").where("part <> own").select("u", F.col("node").alias("v")).distinct()
        if tested is not None:
            edges = edges.join(tested, ["u", "v"], "left_anti")
        close = edges.join(side("v"), "v").join(side("u"), "u").mapInArrow(told, "u long, v long, d long")
        pairs = written(close.groupBy("v").agg(F.min(F.struct("d", "u")).alias("x")).select("x.u", "v"), "nearest")
        links = _verified(docs, ids, pairs, k, num, den)
        more = links.count()
        found, tested = (links, pairs) if found is None else (found.union(links), tested.union(pairs))
        total += more
        joined = components(found).withColumnRenamed("component", "part")
        parts = written(sketches.join(joined, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
        # The turns only spare comparisons: what they leave is compared below, all of it.
        if more * TURN <= total:
            break
    # Then whatever still shares a signature across the parts.
    rows = shared.join(parts.select("node", "part"), "node")
    open_ = rows.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count("*") / GROUP).cast("int").alias("tasks")).where("lo < hi")
    rows = shared.join(open_.select("sig", "tasks"), "sig").join(parts, "node")
    return found.union(_verified(docs, ids, written(_across(rows, num, den), "across"), k, num, den))


def linked(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    Texts link when den * intersection >= num * union of their sets of k-word shingles. component_id is the smallest
    doc_id that links reach, class_id that of the texts with an equal set. Texts without words or null have no
    shingles and link with nothing. Rows with null id are kept, with the component of their set if another row has it.
    Rows that share an id are texts of their own: each has its own set and component, and links of one say nothing of
    the other.
    """
    short_batches(docs.sparkSession)
    d = pruned(docs, id_col, text_col).toDF("doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = written(with_parities(d, k, num, den), "sets")
    links = _links(d.where("doc_id is not null"), sets.where("doc_id is not null"), max(8, -(-size // SHARD_BYTES)), k, num, den)
    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    comp = components(links).join(classes, "node")
    least = comp.groupBy("component").agg(F.min("class_id").alias("component_id"))
    best = comp.join(least, "component").select("node", "component_id")
    nodes = classes.join(best, "node", "left").select("node", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = sets.select("doc_id", "n", "node").join(nodes, "node", "left")
    own = lambda c: F.coalesce(c, "doc_id").alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("component_id"), own("class_id"))
