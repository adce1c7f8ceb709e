"""Stores of daily values by variable and year whose parts are replaced while others read.

Every write goes to a folder of its own, and one small file says which folder holds each variable's year now. It is
replaced by a rename, so a reader sees all of a write or nothing of it, and a reader who has begun keeps the files that
it began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CURRENT = "current.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each "variable/year"; empty where there is no store yet."""
    fs, p = _fs(spark, f"{path}/{_CURRENT}")
    if not fs.exists(p):
        return {}
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    jvm = spark.sparkContext._jvm
    fs, new = _fs(spark, f"{path}/.{_CURRENT}-{uuid.uuid4().hex}")
    stream = fs.create(new)
    stream.write(bytearray(json.dumps(folders).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options, "Rename").OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/{_CURRENT}"), options)


def replace(df: DataFrame, path: str, variables: list[str], first: str, last: str) -> None:
    """Put the variables' values of df (point, date, variables) in place of all that the store holds of them from first to last.

    Days outside the range, other variables and other points' folders stay. A variable that df lacks is an error, and so
    is a row outside the range; nothing has been written then. One writer at a time.
    """
    missing = [v for v in variables if v not in df.columns]
    if missing:
        raise KeyError(f"missing {', '.join(missing)}")
    inside = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    if not df.where(~F.coalesce(inside, F.lit(False))).isEmpty():
        raise ValueError(f"rows outside {first} to {last}")
    spark, folders = df.sparkSession, _folders(df.sparkSession, path)
    years = range(int(first[:4]), int(last[:4]) + 1)
    long = df.select("point", "date", F.explode(F.create_map(*[x for v in variables for x in (F.lit(v), F.col(v).cast("float"))])).alias("variable", "value"))
    old = {k: f for k, f in folders.items() if k in {f"{v}/{y}" for v in variables for y in years}}
    if old:
        kept = read(spark, path, sorted({k.split("/")[0] for k in old}))
        kept = kept.where(F.year("date").between(years[0], years[-1]) & ~inside)
        long = long.unionByName(kept)
    name = f"write-{uuid.uuid4().hex}"
    long.withColumn("year", F.year("date")).repartition("variable", "year").write.partitionBy("variable", "year").option("compression", "zstd").parquet(f"{path}/{name}")
    found = {f"{r.variable}/{r.year}" for r in spark.read.parquet(f"{path}/{name}").select("variable", "year").distinct().collect()} if not long.isEmpty() else set()
    _point(spark, path, {k: f for k, f in folders.items() if k not in old} | dict.fromkeys(found, name))


def read(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """(point, date, variable, value) of the store as it is now; a variable that it doesn't hold is an error."""
    folders = _folders(spark, path)
    held = {k.split("/")[0] for k in folders}
    missing = sorted(set(variables or []) - held)
    if missing:
        raise KeyError(f"missing {', '.join(missing)}")
    parts = None
    for name in sorted(set(folders.values())):
        mine = [k.split("/") for k, f in folders.items() if f == name and (variables is None or k.split("/")[0] in variables)]
        if mine:
            base = spark.read.option("basePath", f"{path}/{name}")
            d = base.parquet(*[f"{path}/{name}/variable={v}/year={y}" for v, y in sorted(mine)]).select("point", "date", "variable", "value")
            parts = d if parts is None else parts.unionByName(d)
    if parts is None:
        raise FileNotFoundError(f"no store at {path}")
    return parts
