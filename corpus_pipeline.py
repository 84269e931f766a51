"""Cleaning a corpus of documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents; all but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.llm import decontaminate, language_id, secret_scan, sentencepiece_scan, simhash
from softgrove.llm.common import held_out, read_table
from softgrove.session import ensure_checkpoint_dir, shared_dir, ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: no letter at all, or
    no language's dictionary is ahead by a fiftieth of the bytes. The dictionaries are learned
    from the labelled rows among ``docs``."""
    content = language_id.learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return language_id.keep_identified(docs, content)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the
    smallest id."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind in brackets; all documents stay."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    coded = sentencepiece_scan.encode(docs, keep=["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


def _ready(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [
    ("language_id", _ready(identify_language)),
    ("simhash_dedup", _ready(drop_near_duplicates)),
    ("decontaminate", _ready(drop_contaminated)),
    ("secret_scan", _ready(redact_secrets)),
    ("sentencepiece", _ready(encode)),
]

#: Compression, fingerprints and tokenization have no SQL form; the pipeline
#: is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between stages the rows
    are written below the session's checkpoint folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
