"""All labelled rows outside the sample calibrate."""

from pyspark.sql import functions as F

from meltemi.llm import toxicity


def test_rows_beyond_the_sample_calibrate(spark):
    ids = spark.range(400).withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)))
    labels = ids.select(F.col("id").alias("doc_id"), F.when(F.col("half") == 0, 1).otherwise(0).alias("toxic"))
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    got = {r.score for r in toxicity.scored(docs, labels, held_out="false", sample=1).collect()}
    # No word is common enough for the list, so every score is the share of toxic rows but the sample's one.
    n = labels.where("toxic = 1").count()
    assert len(got) == 1 and abs(got.pop() - (n - 1) / 399) < 1e-9
