"""Row ids from 0 in a stated order, beyond what one task holds."""

import pytest
from pyspark.sql import functions as F

from meltemi.sources import files


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_two_million_rows(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        # Keys scattered over partitions; their rank is known.
        df = spark.range(0, 2_000_000, 1, 16).select((F.col("id") * 1_299_709 % 2_000_003).alias("k"))
        got = files.numbered(df, "k")
        sums = got.agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("id")).first()
        assert tuple(sums) == (2_000_000, 0, 1_999_999, 2_000_000)
        # Ids rise with the key: of neighbouring ids none has the smaller key.
        a, b = got.select("id", "k"), got.select((F.col("id") - 1).alias("id"), F.col("k").alias("after"))
        assert a.join(b, "id").where("after <= k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_ties_and_nulls_get_ids_of_their_own(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (2, "c"), (1, "d"), (None, "e")], "k int, v string").repartition(3)
    got = sorted((r.id, r.k, r.v) for r in files.numbered(df, "k", "v").collect())
    assert got == [(0, None, "a"), (1, None, "e"), (2, 1, "d"), (3, 2, "b"), (4, 2, "c")]
    assert files.numbered(df.limit(0), "k").count() == 0
