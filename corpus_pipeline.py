"""A training corpus from raw documents, stage by stage.

Each stage reads what its predecessor wrote, works on all of it and hands on the columns
of documents; the last one packs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdelta.llm import packing, pii, quality_rules, simhash, substrings
from revdelta.llm.common import scratch, shared_folder
from revdelta.sources.scratch import remove

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that Python workers get at once. Texts are long: Spark's 10,000 rows of them take tens
#: of megabytes in the executor and again in each of its workers.
BATCH_ROWS = 1000


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns that stages work on; sets the session's batch size for Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts have no words and go; rows that repeat an id are judged each for
    itself; columns beyond COLUMNS are dropped; an empty table stays empty.
    """
    kept = quality_rules.ledger(_documents(spark, docs)).where(quality_rules.passes(quality_rules.POLICY))
    return kept.select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id.

    Five-word shingles; fingerprints at most three bits apart are copies. Null texts count
    as empty, which are copies of each other. Rows that repeat id and text are one; rows
    that repeat an id with other text are documents of their own; a null id stays.
    """
    return simhash.representatives(_documents(spark, docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that repeat across documents stay in one of them.

    A document of which nothing stays goes. Null and short texts, and rows with a null id,
    pass unchanged; rows that repeat an id with other text are documents of their own.
    """
    return substrings.dedup(_documents(spark, docs)).withColumn("n_chars", F.length("text").cast("long"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are masked by their kind; null texts stay null.

    Every row stays, repeated ones too; columns beyond COLUMNS are dropped; an empty table
    stays empty.
    """
    return pii.mask(_documents(spark, docs)).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes training sequences; an empty or null text is its end id alone.

    Rows that repeat an id are packed each for itself, as are rows with a null id; an empty
    table gives no pieces.
    """
    return packing.pack(_documents(spark, docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: SQL expresses neither the fingerprints nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    A stage's table goes once the next one's is written, so two are kept at most; the last
    one's stays, as the result is read from it.
    """
    at, last = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage stores on its way goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if last is not None:
            remove(spark, f"{at}/{last}")
        last = name
    return docs
