import datetime
import hashlib
import re

from pyspark.sql import functions as F

from meltemi.llm import pii

KEY = "k"


def shifted(text, stream, letters):
    out = ""
    for j, c in enumerate(text):
        v = int(stream[4 * j : 4 * j + 4], 16)
        if c.isdigit():
            c = chr(48 + (ord(c) - 48 + v) % 10)
        elif "a" <= c < chr(97 + letters):
            c = chr(97 + (ord(c) - 97 + v) % letters)
        elif "A" <= c <= "Z":
            c = chr(65 + (ord(c) - 65 + v) % 26)
        out += c
    return out


def feistel(s, kind, letters=26):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, pii.ROUNDS + 1):
        stream = hashlib.sha512(f"{KEY}|{kind}|{i}|{right}".encode()).hexdigest()
        left, right = right, shifted(left, stream, letters)
    return left + right


def luhn(p):
    t = 0
    for k, c in enumerate(reversed(p)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        t += d - 9 if d > 9 else d
    return str(-t % 10)


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, [tuple(x) for x in r.pii]) for r in pii.pseudonymised(df, KEY).orderBy("doc_id").collect()]


def test_each_kind_keeps_its_format(spark):
    ten = feistel("7435553824", "phone")
    card = "411111111111111"
    new = "4" + feistel(card[1:], "card")
    got = run(
        spark,
        [
            "call +1 (743) 555-3824 now or 743-555-3824.",
            f"pay {card + luhn(card)} or {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}{luhn(card)}, not {card}{(int(luhn(card)) + 1) % 10}",
            "mail Bob.42@mail5.example.com, bye",
            "from 10.200.30.4 not 300.1.1.1",
            "born 1980-02-29, 29.02.1980 and 02/29/1980; not 1981-02-29 nor 1800-01-01",
            "ssn 123-45-6789 not 000-12-3456",
            None,
            "",
            "nothing 12 here",
        ],
    )
    assert got[0][0] == f"call +1 ({ten[:3]}) {ten[3:6]}-{ten[6:]} now or {ten[:3]}-{ten[3:6]}-{ten[6:]}."
    d = new + luhn(new)
    assert got[1][0] == f"pay {d} or {d[:4]} {d[4:8]} {d[8:12]} {d[12:]}, not {card}{(int(luhn(card)) + 1) % 10}"
    assert got[2][0] == f"mail {feistel('Bob.42', 'email')}@mail5.example.com, bye"
    nib = feistel("".join(chr(97 + int(c, 16)) for c in "0ac81e04"), "ipv4", 16)
    ip = ".".join(str((ord(nib[i]) - 97) * 16 + ord(nib[i + 1]) - 97) for i in (0, 2, 4, 6))
    assert got[3][0] == f"from {ip} not 300.1.1.1"
    m = re.match(r"born (\S+), (\S+) and (\S+); not 1981-02-29 nor 1800-01-01$", got[4][0])
    y, e, u = (datetime.datetime.strptime(x, f).date() for x, f in zip(m.groups(), ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y")))
    assert y == e == u != datetime.date(1980, 2, 29)
    s = feistel("123456789", "ssn")
    assert got[5][0] == f"ssn {s[:3]}-{s[3:5]}-{s[5:]} not 000-12-3456"
    assert got[6:] == [(None, []), ("", []), ("nothing 12 here", [])]
    assert [k for _, x in got for k, _ in x] == ["phone"] * 2 + ["card"] * 2 + ["email", "ipv4"] + ["date"] * 3 + ["ssn"]


def test_permutations_are_bijective(spark):
    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert df.select(pii.feistel(F.col("v"), KEY, "t").alias("p")).distinct().count() == 10_000
    days = spark.range(pii.DAYS).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("v"))
    assert days.select(pii._date(F.col("v"), KEY).alias("p")).distinct().count() == pii.DAYS


def test_clashing_columns_repeats_long_text_and_empty_table(spark):
    long = "word " * 40_000 + "a@b.org " + "y" * 200_000 + " 10.0.0.1"
    df = spark.createDataFrame([(1, long, "x")] * 2, "_found long, text string, _gaps string")
    rows = pii.pseudonymised(df, KEY).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["_found"] == 1 and len(rows[0].pii) == 2
    assert pii.pseudonymised(df.limit(0), KEY).count() == 0
