"""The corpus pipeline: stages, each written as Parquet and read again by the next.

All stages but the last return the columns they were given, extra ones too,
whatever their names.  An empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.llm.decontamination import drop_contaminated
from quoteloom.llm.exact_dedup import drop_copies
from quoteloom.llm.language_id import keep_known, remainder, sample
from quoteloom.llm.near_dedup import drop_near_copies
from quoteloom.llm.packing import pack_documents
from quoteloom.llm.store import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is found; learns from the labels of the training fold.

    Null, empty and letterless texts have none and go; where nothing is
    labelled, all others stay.
    """
    labelled = docs.select("text", "lang").where(remainder(F.col("doc_id"), 5) != 0)
    return keep_known(docs, sample(labelled))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents that are equal but for blanks: the longest, then that of the smallest id.

    Null text counts as empty, a null id as the largest; of rows repeated with
    id and text, one stays.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of texts that share four fifths of their five-word shingles.

    Wordless texts are alike and link like any other; rows without id stay, and
    so do rows that share the id that stays.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no window of the benchmark; null and wordless texts hold none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens; null text is its end id alone."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language ID, fingerprints and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
