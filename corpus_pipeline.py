"""The corpus pipeline: stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attnmaps.llm import decontam, langid, linededup, nearcopies, packing
from attnmaps.llm.common import new_folder

TOKENIZER = "byte_bpe_50k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows travel to Python workers and back in batches of so many bytes (or one larger row), and not by 10,000 texts.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless it has a bound of its own.

    A batch exists several times at once, in the executor's memory outside its heap and in the worker.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or with too narrow a margin go."""
    bound_batches(spark)
    dictionaries = langid.train(docs.where(~langid.held_out()))
    return langid.keep_identified(docs.select(COLUMNS), dictionaries)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier near copy go from the texts; every document stays."""
    rows = linededup.dedup_lines(docs.select(COLUMNS))
    n_chars = F.when(F.col("_n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return rows.withColumn("n_chars", n_chars).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    bound_batches(spark)
    return nearcopies.keep_first(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a test item go."""
    bound_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.keep_clean(docs.select(COLUMNS), benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Compression, fingerprints and tokenizing have no SQL form; a test holds the
#: whole pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
