import base64
import gzip
import hashlib
import os
import random

from pyspark.sql import functions as F

from meltemi.llm import warc


def brute(rows, least=0):
    best = {}
    for i, h in rows:
        p = (h or "").encode()
        if len(p) >= least:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        to = best.get(p, i)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to == i else "revisit", None if to == i else to, True))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, "", "é\r\n\r\nx", "a" * 70_000, "\x00\n", str(rnd.random()) * rnd.randint(1, 9000)])) for i in range(300)]
    df = spark.createDataFrame([(i, f"http://x/{i}\r\ny", h, "z") for i, h in rows], "page_id long, url string, html string, refers_to string")
    path = str(tmp_path / "w")
    assert sorted(map(tuple, warc.archived(df, path).collect())) == brute(rows)
    small = sorted(map(tuple, warc.archived(df, min_revisit_bytes=4).collect()))
    assert small == brute(rows, 4)
    # The archives are plain multi-member gzip for any other reader.
    text = b"".join(gzip.decompress(open(f"{path}/{f}", "rb").read()) for f in os.listdir(path) if f.startswith("part"))
    assert text.count(b"WARC/1.1\r\n") == 300


def test_archives_are_bounded(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("record_id"), F.lit("u").alias("uri"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("payload"), F.lit(None).cast("string").alias("refers_to"))
    path = str(tmp_path / "w")
    warc.write_archives(df.coalesce(1), path, archive_bytes=4096)
    sizes = [os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part")]
    assert len(sizes) > 10 and max(sizes) < 4200
    assert warc.read_archives(spark, path).where("valid").count() == 200


def test_damage_is_seen():
    m = warc.record("a", "u", b"payload", None)
    assert [r[-1] for r in warc.read_archive(m + warc.EMPTY_MEMBER + m)] == [True, True]
    raw = gzip.decompress(m).replace(b"payload", b"Payload")
    assert [r[-1] for r in warc.read_archive(gzip.compress(raw))] == [False]
    for bad in (m[:-9], gzip.compress(gzip.decompress(m)[:-3]), gzip.compress(b"no record\r\n\r\n")):
        try:
            list(warc.read_archive(bad))
        except ValueError:
            continue
        raise AssertionError


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(5, "A" * 40), (5, "B" * 40), (9, "A" * 40), (8, "B" * 40), (7, "c"), (7, "c"), (3, "c"), (3, "c"), (2, "e" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "'u' AS url", "html").repartition(3)
    assert sorted(map(tuple, warc.archived(df).collect())) == brute(rows)
    none = spark.createDataFrame([(None, None, "c"), (None, None, "c"), (3, None, "c")], "page_id long, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(none).collect()]
    assert sorted(got, key=str) == [(3, 1, "response", None), (None, 1, "response", None), (None, 1, "response", None)]
