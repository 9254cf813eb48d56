"""From raw documents to token ids: quality, near-dedup, decontamination, personal data, encoding and decoding.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents, with n_chars kept true to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.llm import bpe, decontam, neardup, pii, quality
from matrixloom.llm.shared import materialize

#: The rating of a labelled document: 0 junk, 1 good but toxic, 2 good.
GRADE = "quality * (2 - coalesce(toxic, 0))"


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, counted anew."""
    if "n_chars" not in like.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


def reject_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier finds likelier good than junk."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), grade=F.expr(GRADE))
    return quality.select(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; documents that are mostly such passages go."""
    return _measured(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span of personal data in its place."""
    return _measured(pii.redact(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit integers) of every document, and the digests of these and of their decoding."""
    keep = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    done = bpe.encode(docs, keep=keep, decoded=True)
    return done.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}).drop("decoded")


STAGES = [
    ("quality", reject_junk),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: No SQL expresses a trained classifier, so the tests compare run() with the stages applied one by one and with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
