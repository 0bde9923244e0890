"""From raw documents to packed tokens: quality, lines, near-duplicates, mixture, encoding.

Each stage reads what its predecessor wrote; ``run`` keeps those tables in the folder
that the cluster shares.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, linededup, mixing, quality, shingles
from millrace.llm.queries import table, vocabulary
from millrace.session import remove, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among its input."""
    return quality.reject(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the last of them alone; n_chars follows the text."""
    done = linededup.dedup_lines(docs.select(*COLUMNS))
    return done.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays, that of the smallest doc_id."""
    return shingles.keep_one(docs.select(*COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, so repeated rows are epochs."""
    return mixing.repeat(docs.select(*COLUMNS))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row, with its source."""
    return bpe.token_digests(docs.select("doc_id", "source", "text"), *vocabulary()).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("simhash", simhash_stage), ("mix", mix_stage), ("encode", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    A stage's table is removed once its successor is written; the last one is the caller's to remove.
    """
    docs, where = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        out = f"{where}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs


#: Compressed sizes, fingerprints and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
