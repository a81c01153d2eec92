"""BM25 ranking of passages for batches of questions, and the gate before any model is asked."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import COVERAGE_FLOOR, TOP_K
from ..functions.text import fold, terms_of, tokens
from ..sources.tables import arrow_batches, saved
from .scoring import asked_blocks, best_passages, held_terms, ranks, term_files


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.ln(1 + (n - df + 0.5) / (df + 0.5)))


_COUNTED = T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("length", T.IntegerType())])


def indexed(chunks: DataFrame, id_col: str = "chunk_id", order_cols: tuple[str, ...] = ("doc_order", "index"), asked: list[str] | None = None) -> DataFrame:
    """(chunk_id, place, terms, length) of each passage; ``place`` orders passages as documents do.

    With ``asked``, files of :func:`asked_files`, ``terms`` are those that questions
    ask for alone, which are few beside all; ``length`` counts all.  Passages that
    were cut with them (``chunk_documents``) have both already.
    """
    arrow_batches(chunks.sparkSession)
    named = [F.col(id_col).alias("chunk_id"), F.struct(*order_cols).alias("place")]
    if {"terms", "length"} <= set(chunks.columns):
        return chunks.select(*named, "terms", "length")
    if asked is None:
        return chunks.select(*named, terms_of(F.col("text")).alias("terms")).withColumn("length", F.size("terms"))
    paths = tuple(asked)

    @F.arrow_udf(_COUNTED)
    def counted(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(held_terms(paths).counted(texts.to_pylist()), ["terms", "length"])

    return chunks.select(*named, counted(F.make_valid_utf8("text")).alias("c")).select("chunk_id", "place", "c.terms", "c.length")


def asked_files(questions: DataFrame) -> list[str] | None:
    """Files of the terms of questions, for :func:`indexed`; None, which is for all terms, where they are very many."""
    return term_files(asked_terms(questions))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: passages n and their average length."""
    return index.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df, tf, idf) of every term: passages that hold it, and how often it occurs."""
    per_chunk = index.select("chunk_id", F.explode_outer("terms").alias("term")).where("term is not null").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    df = per_chunk.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    stats = index.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", "tf", idf(F.col("n"), F.col("df")).alias("idf"))


def asked_terms(questions: DataFrame) -> DataFrame:
    """(question_id, n_terms, pos, term) of questions: their different terms, in order."""
    terms = F.array_distinct(tokens(fold(F.col("question"))))
    return questions.select("question_id", terms.alias("terms")).select("question_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("pos", "term"))


def weighted(asked: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """Terms asked for with their weight (idf) and the passages' average length, from the passages of each term (term, df) and the one row of :func:`corpus_stats`."""
    average = F.when(F.col("avg_length") == 0, 1.0).otherwise(F.col("avg_length"))
    rows = asked.join(df, "term").crossJoin(F.broadcast(stats))
    return rows.select("question_id", "n_terms", "pos", "term", idf(F.col("n"), F.col("df")).alias("idf"), average.alias("average"))


def search(index: DataFrame, questions: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(question_id, rank, chunk_id, score, coverage): the best passages of each question; passages are scored where they lie.

    Ties, equal to nine places, keep document order; a score is summed in the
    order of the question's terms, so it is the same on every run.
    For batch after batch, :mod:`quoteloom.operators.stored_index` keeps postings.
    """
    asked = saved(asked_terms(questions), "asked")
    held = index.select(F.explode_outer(F.array_distinct("terms")).alias("term"))  # outer, as a plain explode makes Spark compute the terms twice, to filter out empty ones first
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    paths = asked_blocks(weighted(asked, df, corpus_stats(index)))
    found = best_passages(index, paths, asked.schema["question_id"].dataType.simpleString(), top_k)
    return ranks(found, top_k).select("question_id", "rank", "chunk_id", "score", "coverage")


def gate(questions: DataFrame, retrieved: DataFrame, floor: float = COVERAGE_FLOOR) -> DataFrame:
    """Questions with relevant and best_coverage: whether their best-scored passage covers enough of their terms."""
    first = retrieved.where("rank = 1").select("question_id", F.col("coverage").alias("best_coverage"))
    joined = questions.join(first, "question_id", "left")
    return joined.withColumn("relevant", F.coalesce(F.col("best_coverage") >= floor, F.lit(False)))
