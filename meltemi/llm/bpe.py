"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash of the last bytes cuts each text where its content says so, which gives passages that documents share
the same chunks wherever they stand. Chunks found twice or more (of very many, the most frequent) are encoded once, each by one task, and sent to the
documents that hold them; all other text is encoded in place. A worker encodes a stretch between sure splits once. At each join of separately encoded stretches the span
between the nearest places where the tokenizer always splits is encoded anew; the pieces must then agree byte by byte
with the text, else the whole text is encoded again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meltemi.llm.sequences import Stretches
from meltemi.llm.shared import pruned, short_batches, written
from meltemi.llm.shingles import _BYTES, _power, mixed, runs

#: Bytes that the rolling hash sees, and the mean number of bytes between cuts.
WINDOW, MEAN = 48, 1024
#: Bits of the filter of repeated chunks (512 KB) and of each chunk in it; others are encoded in place.
FILTER_BITS, BITS_EACH = 1 << 22, 8
STEP_SCHEMA = "uid long, doc_id {id}, n_tokens long, ids_sha256 string, decoded_sha256 string, h long, seq int, lo long, hi long, piece binary, chunk binary"


class Codec:
    """The tokenizer of a file, its tokens' bytes and their lengths; loaded once in each Python worker."""

    _loaded: dict = {}

    def __init__(self, path: str):
        self.coder = Stretches.of(path)
        self.tokenizer = t = self.coder.tokenizer
        n = t.get_vocab_size(with_added_tokens=True)
        # Of byte-level tokens each character stands for one byte: printable ones for themselves, the rest from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(sorted(set(range(256)) - set(plain)))}
        names = [t.id_to_token(i) or "" for i in range(n)]
        self.bytes = [bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode() for x in names]
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.kind = "<u2" if n <= 65536 else "<u4"

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        strings = [t.decode() for t in texts]
        # Stretches are sure only of a tokenizer that splits as its merges tell.
        if self.coder.merges:
            return [np.frombuffer(ids, "<u4") for ids in self.coder.encode(strings)]
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """As the tokenizer's decode(ids, skip_special_tokens=False), in UTF-8."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()

    def packed(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.kind).tobytes()

    def unpacked(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind)


def cuts(texts: list[bytes], window: int = WINDOW, mean: int = MEAN) -> list[np.ndarray]:
    """For each text the ends of its chunks, the last one its length; no cut is within a character or `window` of the start."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _power("up", n + 1)[:n], dtype=np.uint64)])
    roll = np.zeros(n + 1, np.uint64)
    if n >= window:
        roll[window:] = mixed((total[window:] - total[:-window]) * _power("down", n + 1)[: n + 1 - window])
    hit = (roll % np.uint64(mean)) == 1
    hit[:-1] &= (data & 0xC0) != 0x80
    at = np.flatnonzero(hit)
    out, start = [], 0
    for t in texts:
        mine = at[np.searchsorted(at, start + window) : np.searchsorted(at, start + len(t))] - start
        out.append(np.append(mine, len(t)) if len(t) else np.zeros(0, np.int64))
        start += len(t)
    return out


def hashes(text: bytes, ends: np.ndarray) -> list[int]:
    """64 bits of each chunk's digest, signed."""
    return [int.from_bytes(hashlib.blake2b(text[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def places(text: bytes) -> np.ndarray:
    """Where a byte-level tokenizer always splits: before a blank or line feed that follows a visible ASCII character."""
    d = np.frombuffer(text, np.uint8)
    return np.flatnonzero(((d[1:] == 32) | (d[1:] == 10)) & (d[:-1] > 32) & (d[:-1] < 127)) + 1 if len(d) else np.zeros(0, np.int64)


def spans(joins: list[int], split: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The spans to encode anew: from the last split place up to each join to the first one from it on, merged."""
    out: list[list[int]] = []
    for p in joins:
        k = np.searchsorted(split, p)
        if k < len(split) and split[k] == p:
            continue
        lo, hi = int(split[k - 1]) if k else 0, int(split[k]) if k < len(split) else size
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def stretches(ends: list[int], shared: list[bool], again: list[tuple[int, int]]) -> list[tuple[int, int, int, int, str]]:
    """In text order: (start, end) of what is encoded, (from, to) of it that counts, and "own", "shared" or "again"."""
    parts, start = [], 0
    for e, s in zip(ends, shared):
        if parts and not s and parts[-1][2] == "own":
            parts[-1] = (parts[-1][0], e, "own")
        else:
            parts.append((start, e, "shared" if s else "own"))
        start = e
    out = [(a, b, a, b, "again") for a, b in again]
    for a, b, kind in parts:
        at = a
        for lo, hi in [*again, (b, b)]:
            if at < min(lo, b) and lo > a:
                out.append((a, b, at, min(lo, b), kind))
            at = max(at, hi)
    return sorted((x for x in out if x[2] < x[3]), key=lambda x: x[2])


def counted(codec: Codec, ids: np.ndarray, lo: int, hi: int) -> np.ndarray | None:
    """The tokens of bytes lo to hi of what ids encode; None if a token crosses either."""
    at = np.concatenate([[0], np.cumsum(codec.size[ids])])
    i, j = np.searchsorted(at, lo), np.searchsorted(at, hi)
    return ids[i:j] if at[min(i, len(at) - 1)] == lo and at[min(j, len(at) - 1)] == hi else None


def digests(codec: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _texts(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def _valid(texts: list[bytes]) -> list[bytes]:
    """Texts in UTF-8: of other bytes each stretch becomes U+FFFD."""
    out = []
    for t in texts:
        try:
            t.decode()
        except UnicodeDecodeError:
            t = t.decode("utf-8", "replace").encode()
        out.append(t)
    return out


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids array<int>.

    path names a byte-level tokenizer's file on every machine. Null text counts as empty; repeated rows stay. In a text
    that isn't UTF-8 each stretch of other bytes counts as U+FFFD, and so the decoded text has it.
    """
    short_batches(docs.sparkSession)
    d = pruned(docs, id_col, text_col).toDF("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def listed(batches):
        for b in batches:
            texts = _valid(_texts(b.column(0)))
            seen: dict[int, int] = {}
            for i, j in runs(texts):
                for t, e in zip(texts[i:j], cuts(texts[i:j])):
                    for h in hashes(t, e):
                        seen[h] = seen.get(h, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["h", "n"])

    bit = F.expr(f"pmod(h, {FILTER_BITS}L)")
    twice = d.select("text").mapInArrow(listed, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    # The most frequent chunks that the filter can tell apart, by powers of two of their number of places.
    twice = written(twice.select("h", F.floor(F.log2("n")).cast("int").alias("often")), "repeated")
    least = room = 0
    for x in twice.groupBy("often").count().orderBy(F.desc("often")).collect():  # at most 63 rows
        room += x["count"]
        if room * BITS_EACH > FILTER_BITS:
            break
        least = x.often
    twice = twice.where(F.col("often") >= (least or 63)).select(bit.alias("b"))
    words = twice.groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("m"))
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.collect():  # at most FILTER_BITS / 32 rows
        bits[r.w] = r.m

    def run(batches):
        codec = Codec.of(path)
        for b in batches:
            texts, sent = _valid(_texts(b.column(2))), set()
            for i, j in runs(texts):
                todo, plans, rows = [], [], []
                for uid, doc, t, e in zip(b.column(0)[i:j].to_pylist(), b.column(1)[i:j].to_pylist(), texts[i:j], cuts(texts[i:j])):
                    hs = hashes(t, e)
                    shared = [bool(bits[(h % FILTER_BITS) >> 5] >> np.uint32(h & 31) & 1) for h in hs]
                    if not any(shared):
                        plans.append((uid, doc, t, None, len(todo)))
                        todo.append(t)
                        continue
                    ends = e.tolist()
                    joins = [p for p, x, y in zip(ends, shared, shared[1:]) if x or y]
                    s = stretches(ends, shared, spans(joins, places(t), len(t)))
                    plans.append((uid, doc, t, (s, dict(zip([0, *ends[:-1]], hs))), len(todo)))
                    todo += [t[x[0] : x[1]] for x in s if x[4] != "shared"]
                ids = codec.encode(todo)
                for uid, doc, t, plan, k in plans:
                    if plan is None:
                        rows.append((uid, doc, *digests(codec, ids[k]), None, None, None, None, codec.packed(ids[k]) if with_ids else None, None))
                        continue
                    for seq, (a, z, lo, hi, what) in enumerate(plan[0]):
                        if what == "shared":
                            h = plan[1][a]
                            rows.append((uid, doc, None, None, None, h, seq, lo - a, hi - a, None, None if h in sent else t[a:z]))
                            sent.add(h)
                            continue
                        piece = counted(codec, ids[k], lo - a, hi - a)
                        k += 1
                        # Without agreement the piece is the bytes themselves, and the text is encoded as a whole.
                        rows.append((uid, doc, None, None, None, None, seq, lo if piece is None else None, hi, t[lo:hi] if piece is None else codec.packed(piece), None))
                types = [pa.int64(), b.column(1).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                cols = list(zip(*rows)) or [()] * len(types)
                names = ["uid", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "h", "seq", "lo", "hi", "piece", "chunk"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    steps = d.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(run, STEP_SCHEMA.format(id=kind))
    steps = written(steps, "steps")

    def once(batches):
        codec = Codec.of(path)
        for b in batches:
            texts = _texts(b.column(1))
            for i, j in runs(texts):
                ids = codec.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(list(map(codec.packed, ids)), pa.binary())], ["h", "chunk", "ids"])

    chunks = steps.where("chunk is not null").groupBy("h").agg(F.max("chunk").alias("chunk")).mapInArrow(once, "h long, chunk binary, ids binary")

    def cut(batches):
        codec = Codec.of(path)
        for b in batches:
            out, raw = [], []
            for lo, hi, c, x in zip(b.column("lo").to_pylist(), b.column("hi").to_pylist(), _texts(b.column("chunk_")), _texts(b.column("ids"))):
                piece = counted(codec, codec.unpacked(x), lo, hi)
                raw.append(piece is None)
                out.append(c[lo:hi] if piece is None else codec.packed(piece))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("seq"), pa.array(raw, pa.bool_()), pa.array(out, pa.binary())], ["uid", "doc_id", "seq", "raw", "piece"])

    used = steps.where("h is not null").select("uid", "doc_id", "h", "seq", "lo", "hi").join(chunks.select("h", F.col("chunk").alias("chunk_"), "ids"), "h")
    pieces = used.mapInArrow(cut, f"uid long, doc_id {kind}, seq int, raw boolean, piece binary")
    own = steps.where("seq is not null and h is null").select("uid", "doc_id", "seq", F.col("lo").isNotNull().alias("raw"), "piece")

    def whole(batches):
        """Texts put together from their pieces, which come one text after the other and in order."""
        codec = Codec.of(path)

        def one(doc, raw, parts):
            if any(raw):
                ids = codec.encode([b"".join(p if r else codec.decode(codec.unpacked(p)) for p, r in zip(parts, raw))])[0]
            else:
                ids = codec.unpacked(b"".join(parts))
            return (doc, *digests(codec, ids), codec.packed(ids) if with_ids else None)

        now, doc, raw, parts = None, None, [], []
        for b in batches:
            out = []
            for u, x, r, p in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("raw").to_pylist(), _texts(b.column("piece"))):
                if u != now:
                    if now is not None:
                        out.append(one(doc, raw, parts))
                    now, doc, raw, parts = u, x, [], []
                raw.append(r)
                parts.append(p)
            yield joined_rows(b.column("doc_id").type, out)
        if now is not None:
            yield joined_rows(id_type, [one(doc, raw, parts)])

    id_type = to_arrow_type(d.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def numbers(pieces: list[bytes]) -> pa.Array:
        ids = Codec.of(path).unpacked(b"".join(pieces)).astype(np.int32)
        size = np.dtype(Codec.of(path).kind).itemsize
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) // size for p in pieces)]), pa.int32()), pa.array(ids))

    def joined_rows(kind_, rows):
        cols = list(zip(*rows)) or [()] * 5
        arrays = [pa.array(c, t) for c, t in zip(cols, [kind_, pa.int64(), pa.string(), pa.string()])]
        return pa.RecordBatch.from_arrays(arrays + ([numbers(cols[4])] if with_ids else []), names)

    joined = pieces.union(own).repartition("uid").sortWithinPartitions("uid", "seq").mapInArrow(whole, schema)
    done = steps.where("n_tokens is not null")
    if not with_ids:
        return done.select(*names).union(joined)

    def listed_ids(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], numbers(_texts(b.column(4)))], names)

    return done.select(*names[:4], "piece").mapInArrow(listed_ids, schema).union(joined)
