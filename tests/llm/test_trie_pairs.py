"""The registered model holds every n-gram, also those that the training texts have once."""

from meltemi.llm import queries
from tests.llm.test_trie import agrees, brute, corpus


def test_pairs_seen_once_score(spark, tmp_path):
    rows = corpus(300)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_elias_fano_lm(spark, str(tmp_path)).collect()
    agrees({r.doc_id: tuple(r)[1:] for r in got}, brute(rows))
