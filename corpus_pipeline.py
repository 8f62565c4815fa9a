"""A training-corpus pipeline: five stages over the documents table, each one of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from prefixloom.llm.common import drop_dir, shared_dir, table
from prefixloom.llm.decontamination import without_contaminated
from prefixloom.llm.secrets import without_secrets
from prefixloom.llm.sentencepiece_codec import encode
from prefixloom.llm.simhash import first_of_group
from prefixloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return first_of_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a test item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays."""
    return without_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: The classifier and the codec are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returns is written to the shared folder and read again, and deleted once the next has been written.

    The folder of the last but one stage stays, as the result is read from it;
    after a failure none does.
    """
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                path = f"{where}/{k}-{name}"
                docs.write.parquet(path)
                docs = spark.read.parquet(path)
                if before:
                    drop_dir(spark, before)
                before = path
    except BaseException:
        drop_dir(spark, where)
        raise
    return docs
