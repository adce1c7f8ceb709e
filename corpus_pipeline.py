"""From raw documents to token ids: quality, near copies, personal data, source mixture, encoding."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltemi.llm import bpe, jaccard, kernel, mixing, pii
from meltemi.llm.queries import PII_KEY, tokenizer_path
from meltemi.scratch import release, scope, shared_dir, written

#: Near copies: texts whose sets of five-word shingles are similar by 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100


#: Scratch tables of the last stage, whose result is written before the next one starts.
_LAST: list[str] = []


def _staged(f):
    """A stage that drops the scratch tables of the stage before it, and no others."""

    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LAST)
        with scope() as paths:
            out = f(spark, docs, sf_dir)
        _LAST.extend(paths)
        return out

    return stage


@_staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, doesn't reject.

    Every row is judged by its text alone, whatever its id: rows of null or repeated id, and equal rows, stay or go each
    for itself. Null text is judged as an empty one. Columns pass as they are.
    """
    return kernel.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a key of each row's own that orders as doc_id does, null last.

    Ids may be null or repeated, so a stage that joins does so on _row. A row of a Parquet table is known by its file
    and place there; any other DataFrame is written first, so that all its readers see the same.
    """
    table = docs.inputFiles() and docs._jdf.queryExecution().analyzed().children().isEmpty()
    docs = docs if table else written(docs, "numbered")
    n = F.struct(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("place"))
    return docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), n.alias("n")))


@_staged
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one of the smallest id (null last, any of equal ids); all rows without words.

    Rows are linked each for itself: of equal rows one stays, rows of one id and texts of their own stay all.
    """
    rows = numbered(docs)
    groups = jaccard.linked(rows, WORDS, NUM, DEN, id_col="_row")
    stay = groups.where("n_shingles = 0 or component_id = doc_id").select(F.col("doc_id").alias("_row"))
    return rows.join(stay, "_row", "left_semi").select(*docs.columns)


@_staged
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data under pseudonyms; n_chars is counted anew where there is a text.

    No row is joined, so null and repeated ids and equal rows stay as they are; null text stays null.
    """
    # By place, as docs may have a column pii of its own.
    names = [f"_{i}" for i in range(len(docs.columns))]
    out = pii.pseudonymised(docs, PII_KEY).toDF(*names, "_pii").select(*names).toDF(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


@_staged
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row, also of null or repeated id, as often as the mix takes it: not at all, once or twice.

    Copies are equal rows. Null sources form one of their own; rows without words are taken once.
    """
    rows = numbered(docs)
    copies = mixing.mixed(rows, id_col="_row", hash_col="doc_id").select(F.col("doc_id").alias("_row"), F.col("copies").alias("_copies")).where("_copies > 0")
    out = rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*docs.columns)


@_staged
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids; one row for each row, null text as an empty one."""
    return bpe.encoded(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: The stages fit models and permute by SHA-512, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
            if k:
                release(spark, [f"{base}/{STAGES[k - 1][0]}"])
    return docs
