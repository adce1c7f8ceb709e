"""Best-fit packing of documents into sequences, planned on the histogram of their lengths.

Documents are tokenized once and only their lengths travel: the driver gets one count for each length, plans best-fit
decreasing on these counts, many equal sequences at a time, and each piece takes a planned slot by its rank among the
pieces of its length. The plan has at most 2 * size kinds of sequences, at any number of documents.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meltemi.llm.shared import pruned, short_batches, written
from meltemi.llm.shingles import runs

#: Stretches whose ids a Python worker keeps, some hundred megabytes.
KEPT = 400_000
#: White space that Python and the tokenizer may see differently; texts with it are encoded as a whole.
_DOUBTFUL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: A byte-level tokenizer splits before white space that follows other characters, before the last blank of a run that a
#: word follows, and at the end of such a run; so what lies between is encoded alike on its own.
_STRETCH = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]")


#: Characters of which both tokenizers know alike whether they are letters or numbers.
_PLAIN = re.compile("[\\0-\\u024f]*")
# Fixed value: how a byte-level tokenizer splits a text before it merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _merges(path: str):
    """The merges of a byte-level BPE file as a tiktoken encoding, three times as fast for a word; None if they aren't ordered by id."""
    import tiktoken

    with open(path) as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec["normalizer"] or any(before.get(k) != v for k, v in plain.items()):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    # Of byte-level tokens each character stands for one byte: printable ones for themselves, the rest from U+0100 on.
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(i): i for i in same} | {chr(256 + k): i for k, i in enumerate(sorted(set(range(256)) - set(same)))}
    if any(a >= b for a, b in zip(merged, merged[1:])) or not all(set(x) <= byte.keys() for x in vocab):
        return None
    return tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks={bytes(byte[c] for c in x): i for x, i in vocab.items()}, special_tokens={})


class Stretches:
    """Token ids of texts as the tokenizers library gives them; each distinct stretch between sure splits is encoded once.

    Stretches of Latin characters go through the same merges in tiktoken, all others through the library.
    """

    _loaded: dict = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = _merges(path)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Stretches:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        # In the order of the machine, which is little-endian.
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, stretches: list[str]) -> None:
        quick = [s for s in stretches if self.merges and _PLAIN.fullmatch(s)]
        self.known.update((s, array("I", self.merges.encode_ordinary(s)).tobytes()) for s in quick)
        rest = [s for s in stretches if s not in self.known]
        self.known.update(zip(rest, self._encoded(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [None if _DOUBTFUL.search(t) or any(a in t for a in self.added) else _STRETCH.findall(t) for t in texts]
        new = list({s for p in parts if p is not None for s in p if s not in self.known})
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list({s for p in parts if p is not None for s in p})
        self._learn(new)
        whole = iter(self._encoded([t for t, p in zip(texts, parts) if p is None]))
        return [next(whole) if p is None else b"".join(map(self.known.__getitem__, p)) for p in parts]


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and task and nth: its place among those of its length in a task.

    A document's ids and then `end` are cut into pieces of `size`, the first of which is what is left over, if anything.
    """
    short_batches(docs.sparkSession)
    d = pruned(docs, id_col, text_col).toDF("doc_id", "text")
    mark = np.array([end], "<u4").tobytes()

    def run(batches):
        coder, seen, task = Stretches.of(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
            for i, j in runs(texts):
                who, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(coder.encode([t.decode("utf-8", "replace") for t in texts[i:j]]), i):
                    ids += mark
                    n = len(ids) // 4
                    lo, hi, k = 0, (n - 1) % size + 1, 0
                    while lo < n:
                        who.append(row)
                        piece.append(k)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                        lo, hi, k = hi, hi + size, k + 1
                at = np.array(length, np.int64)
                order = np.argsort(at, kind="stable")
                first = np.searchsorted(at[order], np.arange(size + 1))
                nth = np.empty(len(at), np.int64)
                nth[order] = np.arange(len(at)) - first[at[order]] + seen[at[order]]
                seen += np.bincount(at, minlength=size + 1)
                cols = [b.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(at), pa.array(crc, pa.int64()), pa.array([task] * len(at), pa.int32()), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def planned(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, how many of it)]) by best fit decreasing, equal sequences together.

    Each piece, longest first, goes where the least room that suffices is. A sequence chosen for one length goes on
    being the best for it until no more fits, so whole groups of equal sequences are filled at once. A length splits at
    most one group in three or opens two, hence at most 2 * size groups.
    """
    room: list[list] = [[] for _ in range(size + 1)]

    def put(n, left, kind):
        if n:
            room[left].append((n, kind))

    for length in sorted(counts, reverse=True):
        c = counts[length]
        for r in range(length, size):
            while c and room[r]:
                n, kind = room[r].pop()
                fit = r // length
                filled = min(n, c // fit)
                put(filled, r - fit * length, [*kind, (length, fit)])
                n, c = n - filled, c - filled * fit
                if n and c:  # fewer than fit are left
                    put(1, r - c * length, [*kind, (length, c)])
                    n, c = n - 1, 0
                put(n, r, kind)
            if not c:
                break
        fit = size // length
        put(c // fit, size - fit * length, [(length, fit)])
        put(int(c % fit > 0), size - c % fit * length, [(length, c % fit)])
    return [x for group in room for x in group]


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length and kind of sequence, by length and first: the rank of its first slot, slots a sequence, the first sequence, and the place there."""
    rows, taken, sequence = [], {}, 0
    for n, kind in plan:
        at = 0
        for length, m in kind:
            rows.append((length, taken.get(length, 0), m, sequence, at))
            taken[length] = taken.get(length, 0) + n * m
            at += length * m
        sequence += n
    rows.sort()
    return dict(zip(("length", "first", "each", "sequence", "at"), np.array(rows, np.int64).reshape(-1, 5).T))


def packed(docs: DataFrame, path: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: one piece with `end` alone. Rows of null, repeated or equal ids are documents each for
    itself. Only documents longer than `size` are cut. No documents: no rows.
    """
    rows = written(pieces(docs, path, size, end, id_col, text_col), "pieces")
    counts = written(rows.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    # At most `size` rows.
    table = slots(planned({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As many rows as tasks have lengths, which grows with the data: not broadcast.
    ranked = rows.join(counts.select("length", "task", before.alias("before")).hint("shuffle_hash"), ["length", "task"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("before") + F.col("nth")).alias("rank"))

    def placed(batches):
        # Ranks fit 48 bits: 281 trillion pieces of one length.
        where = table["length"] << 48 | table["first"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(where, length << 48 | rank, "right") - 1
            nth, slot = np.divmod(rank - table["first"][k], table["each"][k])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(table["sequence"][k] + nth), pa.array(table["at"][k] + slot * length)], [*names, "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
