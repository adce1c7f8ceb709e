"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, and which compresses a window better.

Whole sampled texts of both kinds are cut into raw dictionaries of equal size. A window of a toxic text tells of toxicity
if a dictionary of other toxic texts compresses it to fewer bytes than any dictionary of ordinary ones does, and if
several texts have it; how many is chosen by texts kept aside. What tells makes up the toxic dictionary, the windows that
most texts share at its end. A window is then compressed with ordinary text before blanks and before the toxic
dictionary: both find ordinary matches at equal distances, so that what the toxic dictionary saves is left. Windows are
words with the blanks around them, between two fixed runs of bytes: zstandard finds no match in the last bytes of its
input, and stores very short inputs as they are.

Long texts have more windows and so more savings by chance. Windows of ordinary texts kept aside tell how often each
saving occurs there; a text's statistic is the rarity of its largest, two, three and more largest savings among as many
ordinary windows, the highest of these. Labels of other rows than those sampled calibrate it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.kernel import isotonic
from meltemi.llm.shared import pruned, short_batches, written

#: Labelled rows of each kind that are sampled, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 1500, 8 << 20
#: Bytes of the toxic texts of a sample that are compared, and of each raw dictionary; parts that toxic texts are dealt into.
TOXIC_SAMPLE_BYTES, PART_BYTES, PARTS = 2 << 20, 1 << 17, 8
#: Bytes of the toxic dictionary, and in how many texts a window of it may have to be.
TOXIC_BYTES, SHARED = 1 << 15, (2, 3, 5, 8)
LEVEL = 12
#: Bytes before and behind a window, of no text.
BEFORE, BEHIND = bytes(range(128, 192)), bytes(range(240, 252))
#: Largest savings that count, the highest one told apart, and steps of the statistic for a factor of ten.
RANKS, MOST, STEPS = 12, 40, 20
TOP = 40 * STEPS
#: Windows whose saving a Python worker keeps, some tens of megabytes.
KEPT = 200_000


def normalised(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def windows(words: list[bytes]) -> list[bytes]:
    """Each word with a blank on either side."""
    return [b" " + w + b" " for w in words]


class Length:
    """Bytes of a window compressed with a raw dictionary."""

    def __init__(self, dictionary: bytes):
        d = zstandard.ZstdCompressionDict(dictionary + BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __call__(self, window: bytes) -> int:
        return len(self._compress(BEFORE + window + BEHIND))


def parts(texts: list[bytes]) -> list[bytes]:
    """The texts one after the other, cut into dictionaries of PART_BYTES."""
    flat = b"".join(texts)
    return [flat[k : k + PART_BYTES] for k in range(0, len(flat), PART_BYTES)]


def telling(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """The windows that other toxic texts compress better than any ordinary ones, and how many texts have each.

    Texts are normalised, with blanks between words and around.
    """
    dealt = [Length(d) for k in range(PARTS) for d in parts(toxic[k::PARTS])]
    plain = [Length(d) for d in parts(ordinary)]
    texts = Counter(w for t in toxic for w in set(windows(t.split())))
    out = Counter()
    for w, n in texts.items():
        # A window of several texts is one that other texts have.
        if n >= min(SHARED):
            least = min(c(w) for c in dealt)
            if all(c(w) > least for c in plain):
                out[w] = n
    return out


@dataclass
class Dictionaries:
    toxic: bytes
    ordinary: bytes
    #: For each saving the share of ordinary windows that save as much.
    chance: np.ndarray = field(default_factory=lambda: np.ones(MOST + 1))
    _pair: tuple | None = None
    _known: dict | None = None

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "chance": self.chance, "_pair": None, "_known": None}

    def saving(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves."""
        if self._pair is None or len(self._known) >= KEPT:
            self._pair = self._pair or (Length(self.ordinary + bytes(len(self.toxic))), Length(self.ordinary + self.toxic))
            self._known = {}
        out = self._known.get(window)
        if out is None:
            plain, toxic = self._pair
            out = self._known[window] = min(MOST, max(0, plain(window) - toxic(window)))
        return out

    def statistic(self, text: bytes) -> int:
        """From 0 to TOP."""
        if not self.toxic:
            return 0
        saved = np.bincount([self.saving(w) for w in windows(normalised(text))], minlength=1)
        n, k, best = int(saved.sum()), 0, 0.0
        for s in range(len(saved) - 1, 0, -1):
            for k in range(k + 1, min(RANKS, k + int(saved[s])) + 1):
                # k such windows among so many, by the law of rare events.
                expected = n * self.chance[s]
                if expected < k:
                    best = max(best, math.lgamma(k + 1) / math.log(10) - k * math.log10(expected))
        return min(TOP, int(STEPS * best))


def train(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
    """The dictionaries of sampled texts; every fourth text of either kind is kept aside and chooses among them."""
    flat = lambda t: b" " + b" ".join(normalised(t)) + b" "
    aside = [x for x in ordinary[::4]], [x for x in toxic[::4]]
    taught, room = [], TOXIC_SAMPLE_BYTES
    for k, x in enumerate(toxic):
        if k % 4 and len(x) <= room:
            taught.append(flat(x))
            room -= len(x)
    plain = [flat(x) for k, x in enumerate(ordinary) if k % 4]
    found = telling(taught, plain)
    base = (parts(plain) or [b""])[0]
    best = None
    for least in SHARED:
        kept = sorted(((n, w) for w, n in found.items() if n >= least))
        m = Dictionaries(b"".join(w for _, w in kept)[-TOXIC_BYTES:], base)
        if m.toxic:
            saved = [m.saving(w) for x in aside[0] for w in windows(normalised(x))]
            n = np.bincount(saved, minlength=MOST + 1)
            m.chance = (np.cumsum(n[::-1])[::-1] + 0.3) / (len(saved) + 1)
        stats = sorted([(m.statistic(x), 0) for x in aside[0]] + [(m.statistic(x), 1) for x in aside[1]], reverse=True)
        # The best balance of what is found and what is right at any threshold.
        hits = np.cumsum([y for _, y in stats]) if stats else np.zeros(1)
        last = np.array([k + 1 == len(stats) or stats[k][0] != stats[k + 1][0] for k in range(len(stats))] or [True])
        score = float((2 * hits / (np.arange(1, len(hits) + 1) + max(1, len(aside[1]))))[last].max())
        if best is None or score > best[0]:
            best = score, m
    return best[1]


def sampled(docs: DataFrame, labelled: DataFrame, sample: int) -> tuple[DataFrame, list[bytes], list[bytes]]:
    """(ids of the sample, its toxic texts, its ordinary ones) of labelled (doc_id, y, h), in order of h.

    At most `sample` rows and SAMPLE_BYTES of each label come to the driver.
    """
    ids = None
    for k in (0, 1):
        part = labelled.where((F.col("y") == k) & (F.pmod("h", F.lit(2)) == 0)).orderBy("h", "doc_id").limit(sample).select("doc_id", "y", "h")
        ids = part if ids is None else ids.union(part)
    # A few thousand rows of numbers, so broadcasting them is safe at any size of the corpus.
    ids = written(ids, "sample")
    sizes = docs.join(F.broadcast(ids), "doc_id").where("text is not null").groupBy("doc_id", "y", "h").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    room, kept = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if r.n <= room[r.y]:
            room[r.y] -= r.n
            kept.append((r.doc_id, r.y, r.h))
    kept = docs.sparkSession.createDataFrame(kept, ids.schema)
    rows = docs.join(F.broadcast(kept), "doc_id").where("text is not null").select("h", F.col("text").cast("binary").alias("text"), "y").collect()
    rows = sorted((r.h, bytes(r.text), r.y) for r in rows)
    return ids, [x for _, x, y in rows if y == 1], [x for _, x, y in rows if y == 0]


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: str = "crc32(cast(doc_id as string)) % 4 = 2", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted (score >= threshold).

    held_out is an expression over doc_id; labels of such rows are never read. Of the others, every second (by hash)
    may train the dictionaries, at most `sample` of each label; the rest calibrate, all of them. Null labels and ids
    don't train; null text counts as empty; rows of one id are scored each by its own text and calibrate by its label.
    Without toxic training rows every score is the share of toxic rows, or 0.
    """
    short_batches(docs.sparkSession)
    docs = pruned(docs, "doc_id", "text")
    y = pruned(labels, "doc_id", label_col).toDF("doc_id", "y").where(f"y in (0, 1) and not ({held_out})")
    y = y.select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    ids, toxic, ordinary = sampled(docs, y, sample)
    model = train(toxic, ordinary)

    def run(batches):
        for b in batches:
            s = [model.statistic(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.int32())], ["doc_id", "statistic"])

    stats = written(docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, statistic int"), "distances")
    other = y.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_anti").select("doc_id", "y")
    counts = sorted(map(tuple, stats.join(other, "doc_id").groupBy("statistic").agg(F.count("*"), F.avg("y")).collect()))
    if counts:
        at, n, share = map(np.array, zip(*counts))
        value = isotonic(share.astype(float), n.astype(float))
    else:
        at, value = np.array([0, TOP]), np.array([0.0, 1.0 if model.toxic else 0.0])
    table = np.clip(np.interp(np.arange(TOP + 1), at, value), 0, 1)
    score = F.get(F.array(*[F.lit(float(v)) for v in table]), F.col("statistic"))
    out = stats.select("doc_id", F.expr(f"coalesce({held_out}, false)").alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
