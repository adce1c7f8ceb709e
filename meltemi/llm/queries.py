"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltemi.llm import bpe, interaction, jaccard, kernel, lloyd, mixing, pii, rules, sequences, topk, toxicity, trie, warc


#: The secret of the pseudonyms; a deployment passes its own.
PII_KEY = "meltemi-2020"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_entropy_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.searched(_table(spark, sf_dir, "embeddings"))


def op4_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.scored(_table(spark, sf_dir, "documents"))


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and what was replaced by kind."""
    out = pii.pseudonymised(_table(spark, sf_dir, "documents"), PII_KEY)
    kinds = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", "text", F.transform("pii", lambda x: x["pseudonym"]).alias("pseudonyms"), *kinds)


def op8_dictionary_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "toxic")


def op9_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op13_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clustered(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_entropy_mixture": op1_entropy_mixture,
        "op2_warc_archives": op2_warc_archives,
        "op3_threshold_topk": op3_threshold_topk,
        "op4_partenum_join": op4_partenum_join,
        "op5_chunked_bpe": op5_chunked_bpe,
        "op6_elias_fano_lm": op6_elias_fano_lm,
        "op7_feistel_pseudonyms": op7_feistel_pseudonyms,
        "op8_dictionary_toxicity": op8_dictionary_toxicity,
        "op9_fourier_quality": op9_fourier_quality,
        "op10_quality_rules": op10_quality_rules,
        "op11_filter_interaction": op11_filter_interaction,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_weighted_lloyd": op13_weighted_lloyd,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_threshold_topk": topk.ORACLE_SQL,
        "op10_quality_rules": rules.ORACLE_SQL,
        "op11_filter_interaction": interaction.ORACLE_SQL,
        "op13_weighted_lloyd": lloyd.oracle_sql(),
    }
