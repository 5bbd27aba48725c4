"""The corpus pipeline: documents -> packed training sequences, in five stages.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next one's documents. All but
the last return the columns of ``documents``, and any others that there are, whatever they
are called. A stage of an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, packing, quality, secrets, simhash
from tidewater.llm.queries import word_tokenizer
from tidewater.llm.shared import forget, new_table, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go. Null texts count as empty and are scored like any other; equal texts are kept or go together; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, null ids last, then the smallest hash. Rows repeated in full are one; null and empty texts are one group."""
    return simhash.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, repeated ones together; null and empty texts stay, and so does all if there are no items."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and ``n_chars`` follows the text. No row goes; null texts stay null with the ``n_chars`` they had."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens; a null or empty text is its end token, and repeated rows are packed each."""
    return packing.pack_documents(docs, word_tokenizer(), at_once=500_000, cache=200_000)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Learnt rules, fingerprints, alignment and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables of a stage, and the one it read, are removed once it is written."""
    docs = table(spark, sf_dir, "documents")
    result = new_table(spark, "pipeline")
    mark = written()
    for n, (_, stage) in enumerate(STAGES, 1):
        frame = stage(spark, docs, sf_dir)
        path = result if n == len(STAGES) else new_table(spark, "stage")
        frame.write.parquet(path)
        docs = spark.read.parquet(path)
        forget(spark, mark, but=path)
    return docs
