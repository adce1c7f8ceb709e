"""WARC archives: a writer of one gzip member per record and a sequential reader.

The writer packs the members of neighbouring rows into blocks and lets Spark's text sink write each block as one file,
so archives go to any store that Spark reaches. The sink ends each file with a line separator; set to an empty gzip
member, it keeps the file a plain sequence of gzip members. The reader takes each archive as one binary row of bounded
size, inflates it in small steps, finds each payload by its content length and checks its digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.shared import pruned, scratch_path, short_batches

#: An archive is closed once it holds this much; a single larger record gets one of its own.
ARCHIVE_BYTES = 8 << 20
#: Inflated bytes per step of the reader.
STEP = 1 << 16
#: gzip of nothing (RFC 1952): ten bytes of header, an empty block, check sum and size of zero.
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "archive string, record_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, valid boolean"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member: a response, or, if it refers to another one, a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    uri = "".join(c for c in uri if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _members(data: memoryview) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its inflated pieces; the caller takes all before the next member."""
    at = 0

    def pieces() -> Iterator[bytes]:
        nonlocal at
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise ValueError("archive ends within a gzip member")
            step = data[at : at + STEP]
            at += len(step)
            out = z.decompress(step, STEP)
            while out:
                yield out
                # A full piece may leave output behind even where no input is left.
                out = b"" if z.eof else z.decompress(z.unconsumed_tail, STEP)
            at -= len(z.unused_data)

    while at < len(data):
        yield pieces()


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_archive(data: bytes) -> Iterator[tuple]:
    """record id, target, type, refers-to, payload length, payload digest, digests right; for each record in order.

    The block is never held whole: its length frames it, and both digests are computed while it is inflated. Of a
    revisit the payload length is that which its HTTP header states and the digest that of its record header.
    """
    for pieces in _members(memoryview(data)):
        buf = bytearray()
        for piece in pieces:
            buf += piece
            if (end := buf.find(b"\r\n\r\n")) >= 0:
                break
        else:
            if buf:
                raise ValueError("gzip member without a record header")
            continue
        version, h = _headers(bytes(buf[:end]))
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        length, rest = int(h["content-length"]), bytes(buf[end + 4 :])
        whole, body = hashlib.sha1(), hashlib.sha1()
        http, seen, n, inside, after = b"", 0, 0, False, b""
        while True:
            take, extra = rest[: length - seen], rest[length - seen :]
            seen += len(take)
            after += extra
            whole.update(take)
            if not inside:
                http += take
                if (e := http.find(b"\r\n\r\n")) >= 0:
                    inside, take, http = True, http[e + 4 :], http[:e]
                else:
                    take = b""
            body.update(take)
            n += len(take)
            if (rest := next(pieces, None)) is None:
                break
        if seen != length or after != b"\r\n\r\n":
            raise ValueError(f"record {h.get('warc-record-id')} is framed wrongly")
        kind, said = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
        b32 = lambda x: base64.b32encode(x.digest()).decode()
        ok = h.get("warc-block-digest", "").removeprefix("sha1:") == b32(whole)
        if kind == "revisit":
            n = int(_headers(http)[1].get("content-length", 0))
        else:
            ok = ok and said == b32(body)
        ref = h.get("warc-refers-to")
        yield h["warc-record-id"].strip("<>"), h.get("warc-target-uri"), kind, ref and ref.strip("<>"), n, said, ok


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write rows (record_id, uri, payload binary, refers_to or null) as archives of about archive_bytes under path.

    Null uri or payload counts as empty. Each record is one gzip member. Rows keep the partitions they come in.
    """

    def blocks(batches):
        members, size = [], 0
        for b in batches:
            for i, u, p, r in zip(*(b.column(k) for k in range(4))):
                m = record(i.as_py(), u.as_py() or "", p.as_py() or b"", r.as_py())
                if members and size + len(m) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])
                    members, size = [], 0
                members.append(m)
                size += len(m)
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])

    packed = records.select("record_id", "uri", "payload", "refers_to").mapInArrow(blocks, "value binary")
    # The sink writes the bytes of a string as they are; ISO-8859-1 keeps those of the separator.
    sink = packed.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    sink.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the archives under path (READ_SCHEMA). Broken framing fails the job; wrong digests show in valid."""

    def parse(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows = [(name.as_py(), *r) for r in read_archive(content.as_buffer().to_pybytes())]
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_()]
                cols = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], READ_SCHEMA.replace(",", "").split()[::2])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(parse, READ_SCHEMA)


def archived(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per page and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Among pages of equal payload of at least min_revisit_bytes, the one with the largest id holds the payload and the
    others revisit it. Null html counts as empty. Rows that share an id are pages of their own: each has a record by its
    own payload, and if the largest id of a payload stands in several rows, each of these is a response. Rows with null
    id are written as responses of their own and come back with a null id.
    The archives stay under path, by default in the shared folder.
    """
    spark = pages.sparkSession
    short_batches(spark)
    path = path or scratch_path(spark, "warc")
    p = pruned(pages, id_col, url_col, html_col).toDF("page_id", "uri", "html")
    p = p.select("page_id", "uri", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("n", F.octet_length("payload")).withColumn("sha", F.sha1("payload"))
    # Digest and length stand for the payload, so that copies meet as rows of some forty bytes. Of each task's copies
    # one partial maximum is shuffled; a page that doesn't hold the maximum revisits it.
    small = p.select("page_id", "n", "sha").where("page_id is not null").where(F.col("n") >= min_revisit_bytes)
    first = small.groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    refers = small.join(first, ["sha", "n"]).where("page_id < refers_to").select("page_id", "sha", "n", "refers_to").distinct()
    rows = p.join(refers, ["page_id", "sha", "n"], "left")
    uri = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    write_archives(rows.select(F.coalesce(uri(F.col("page_id")), F.lit("urn:page:")).alias("record_id"), "uri", "payload", uri(F.col("refers_to")).alias("refers_to")), path)
    kind = dict(p.dtypes)["page_id"]
    back = lambda c: F.expr(f"try_cast(substring({c}, 10) AS {kind})")
    return read_archives(spark, path).select(
        back("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"), "valid"
    )
