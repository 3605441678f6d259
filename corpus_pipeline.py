"""Documents to packed training batches; each stage is one operator of marlstone.llm.

All stages but the last return the columns of documents, whatever these are; a null text stays null, repeated rows and
rows without an id are kept apart as each stage says, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import lines, packing, repeats, simhash, toxicity
from marlstone.llm._common import dropped, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all others stay as they are, blank and null texts too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.rejected(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of like lines stays, the one of the least id; every document stays, if need be with an empty text."""
    return lines.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id; texts without words are one group, rows without an id stay."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 200 bytes that occurs twice is cut out; every document stays, and null texts stay null."""
    return repeats.without_repeats(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the token-budget batches of its length bucket; blank and null texts have no token and a place, too."""
    return packing.packed(docs)


STAGES = [
    ("toxic_documents", toxic_documents),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("batches", batches),
]

#: SQL can't express learned scores, fingerprint covers or suffix arrays; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written as Parquet and read again by the next, which has them deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
