"""Format-preserving Feistel pseudonyms for personal data, in native expressions only.

A text is cut at the matches of one pattern; every match that its kind's rule validates is replaced by a keyed
permutation within its format. The permutation is a Feistel network whose halves are strings: each round adds to one
half, character by character and modulo the size of the character's class, a keyed SHA-512 of the other half. It is a
bijection on each format, so equal values stay equal in every document and different ones stay different.

Kinds, and what stays as it is:
  email   local part permuted (letters stay letters of their case, digits digits); domain kept
  ipv4    octets of at most 255; permuted as 32 bits
  date    Y-m-d, d.m.Y or m/d/Y that exist, 1900-01-01 to 2099-08-04 (72,900 days); permuted as a day number
  phone   8 to 15 digits with country code, or ten digits as (ddd) ddd-dddd or ddd-ddd-dddd; country code kept
  ssn     ddd-dd-dddd with area not 000, 666 or 9xx, no zero group; nine digits permuted
  card    13 to 19 digits with a right Luhn digit; the first kept, the check digit computed anew
Separators are kept in place, and one value has one pseudonym however it is spaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DAYS, SIDE = 72_900, 270

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
PHONE = (
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: The look ahead lets all other places fail at their first character.
NUMBERS = f"(?=[0-9+(])(?:{'|'.join((IPV4, DATE, SSN, PHONE, CARD))})"
PATTERN = f"{EMAIL}|{NUMBERS}"
KINDS = ("email", "ipv4", "date", "phone", "ssn", "card")


def _shifted(text: Column, stream: Column, letters: int) -> Column:
    """Each character moved within its class by four hex digits of the stream."""

    def moved(j: Column) -> Column:
        c = F.ascii(F.substring(text, j, F.lit(1)))
        v = F.conv(F.substring(stream, j * 4 - 3, F.lit(4)), 16, 10).cast("int")
        to = lambda first, n: F.char(F.lit(first) + (c - first + v) % n)
        return (
            F.when(c.between(48, 57), to(48, 10))
            .when(c.between(97, 96 + letters), to(97, letters))
            .when(c.between(65, 90), to(65, 26))
            .otherwise(F.substring(text, j, F.lit(1)))
        )

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), moved), ""))


def feistel(value: Column, key: str, kind: str, letters: int = 26) -> Column:
    """A keyed permutation of the strings (up to 64 characters) that have the classes of value, place by place."""
    half = (F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))

    def turn(a: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), a["r"]), 512)
        return F.struct(a["r"].alias("l"), _shifted(a["l"], stream, letters).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda a: F.concat(a["l"], a["r"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _filled(m: Column, digits: Column) -> Column:
    """m with its digits replaced by those given, its separators kept."""

    def at(j: Column) -> Column:
        c = F.substring(m, j, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), j))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), at), "")


def _luhn(payload: Column) -> Column:
    """The check digit that follows the payload."""

    def add(total: Column, j: Column) -> Column:
        d = F.substring(payload, j, F.lit(1)).cast("int") * F.when((F.length(payload) - j) % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return ((10 - F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add) % 10) % 10).cast("string")


def _email(m: Column, key: str) -> Column:
    return F.concat(feistel(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: F.lpad(F.hex(x.cast("int")), 2, "0"))
    nibbles = F.translate(F.array_join(octets, ""), "0123456789ABCDEF", "abcdefghijklmnop")
    back = F.translate(feistel(nibbles, key, "ipv4", letters=16), "abcdefghijklmnop", "0123456789ABCDEF")
    return F.array_join(F.transform(F.array(*map(F.lit, (1, 3, 5, 7))), lambda j: F.conv(F.substring(back, j, F.lit(2)), 16, 10)), ".")


_FORMATS = (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"))


def _day(m: Column) -> Column:
    """Days since 1900-01-01, null if there is no such date or it lies outside the permuted range."""
    day = F.coalesce(*[F.when(m.contains(s), F.try_to_timestamp(m, F.lit(f)).cast("date")) for s, f in _FORMATS])
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    return F.when(n.between(0, DAYS - 1), n)


def _date(m: Column, key: str) -> Column:
    n = _day(m)
    start = F.struct((n / SIDE).cast("int").alias("l"), (n % SIDE).alias("r"))

    def turn(a: Column, i: Column) -> Column:
        v = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("date"), i.cast("string"), a["r"].cast("string")), 512), 1, 8), 16, 10).cast("long")
        return F.struct(a["r"].alias("l"), ((a["l"] + v) % SIDE).cast("int").alias("r"))

    to = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda a: a["l"] * SIDE + a["r"])
    day = F.date_add(F.lit("1900-01-01").cast("date"), to)
    return F.coalesce(*[F.when(m.contains(s), F.date_format(day, f)) for s, f in _FORMATS])


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    kept = F.when(~m.startswith("+"), 0).when(d.startswith("1") & (F.length(d) == 11), 1).otherwise(2)
    return _filled(m, F.concat(F.substring(d, F.lit(1), kept), feistel(F.substring(d, kept + 1, F.length(d)), key, "phone")))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    payload = F.concat(F.substring(d, 1, 1), feistel(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    return _filled(m, F.concat(payload, _luhn(payload)))


def _kind(m: Column) -> Column:
    """The kind of a match, null if its rule doesn't validate it."""
    d = _digits(m)
    whole = lambda p: m.rlike(f"^(?:{p})$")
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(whole(DATE), F.when(_day(m).isNotNull(), F.lit("date")))
        .when(whole(IPV4), F.when(octets, F.lit("ipv4")))
        .when(whole(SSN), F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), F.lit("ssn")))
        .when(m.startswith("+"), F.when(F.length(d).between(8, 15), F.lit("phone")))
        .when(whole(PHONE), F.lit("phone"))
        .when(_luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1), F.lit("card"))
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten and one column pii added: an array of (kind, pseudonym), in text order.

    Null texts stay null with an empty array; all other columns and all rows stay, repeated rows too. Matches that
    their rule doesn't validate stay in the text and out of the array.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    back = dict(zip(names, docs.columns))
    t = next(n for n, c in back.items() if c == text_col)
    df = docs.toDF(*names)
    # Texts without an @ are searched for numbers alone, those without a digit either not at all.
    found = F.when(F.col(t).contains("@"), F.regexp_extract_all(F.col(t), F.lit(PATTERN), 0)).when(F.col(t).rlike("[0-9]"), F.regexp_extract_all(F.col(t), F.lit(NUMBERS), 0))
    df = df.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    df = df.withColumn("_kinds", F.transform("_found", lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))))

    def replaced(x: Column) -> Column:
        m, k = x["m"], x["kind"]
        new = (
            F.when(k == "email", _email(m, key))
            .when(k == "ipv4", _ipv4(m, key))
            .when(k == "date", _date(m, key))
            .when(k == "phone", _phone(m, key))
            .when(k == "ssn", _filled(m, feistel(_digits(m), key, "ssn")))
            .when(k == "card", _card(m, key))
            .otherwise(m)
        )
        return F.struct(k.alias("kind"), new.alias("pseudonym"))

    df = df.withColumn("_new", F.transform("_kinds", replaced))
    gaps = F.when(F.col(t).contains("@"), F.split(F.col(t), PATTERN, -1)).otherwise(F.split(F.col(t), NUMBERS, -1))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, gaps))
    joined = F.concat(F.get("_gaps", F.lit(0)), F.array_join(F.transform("_new", lambda x, i: F.concat(x["pseudonym"], F.get("_gaps", i + 1))), ""))
    text = F.when(F.size("_found") > 0, joined).otherwise(F.col(t))
    pii = F.filter("_new", lambda x: x["kind"].isNotNull())
    out = df.select(*[(text if n == t else F.col(n)).alias(n) for n in names], pii.alias("_pii"))
    return out.toDF(*docs.columns, "pii")
