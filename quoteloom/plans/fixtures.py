"""Inputs of registered queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *order: str) -> DataFrame:
    """``df`` over all cores where its files make fewer splits, by ranges of an order if any: texts take far longer to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartitionByRange(cores, *order) if order else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_order, title, text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.col("doc_id").alias("doc_order"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id and question: the first twelve folded words of each benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    words = F.slice(F.split(fold(F.col("text")), " "), 1, 12)
    return items.select(F.col("item_id").alias("question_id"), F.array_join(words, " ").alias("question"))


#: Kinds of claim made of each item, in the order of their ids.
KINDS = ("verbatim", "upper", "folded", "tampered", "short", "no_quote", "unknown_passage", "blank")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, question_id, kind, text, chunk_id, quote: eight claims of each item, most citing a wrong passage."""
    items = table(spark, sf_dir, "benchmark").withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    quote = (
        F.when(F.col("kind").isin("verbatim", "unknown_passage"), F.col("text"))
        .when(F.col("kind") == "upper", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(F.col("kind") == "folded", fold(F.col("text")))
        .when(F.col("kind") == "tampered", F.concat(F.col("text"), F.lit(" zzz")))
        .when(F.col("kind") == "short", F.array_join(F.slice(F.split(fold(F.col("text")), " "), 1, 3), " "))
        .when(F.col("kind") == "blank", F.lit(" \n"))
    )
    cited = F.when(F.col("kind") == "unknown_passage", "none").otherwise(F.concat(F.lit("c"), (F.col("item_id") * 13).cast("string")))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    return items.select((F.col("item_id") * 8 + place).alias("claim_id"), F.col("item_id").alias("question_id"), "kind", F.lit("claimed").alias("text"), cited.alias("chunk_id"), quote.alias("quote"))


#: States that event types stand for.
EVENT_STATES = "queued running retrying waiting-budget done failed cancelled"


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, task_id, label, state, attempts: events as changes of their user's task."""
    events = table(spark, sf_dir, "events")
    states = F.array(*map(F.lit, EVENT_STATES.split()))
    state = F.element_at(states, (F.pmod(F.col("event_id") + F.length("event_type"), F.lit(7)) + 1).cast("int"))
    label = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return events.select(F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id"), label.alias("label"), state.alias("state"), (F.col("event_id") % 4 + 1).cast("int").alias("attempts"))


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, at_ms, tokens: events as reservations of their value."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.ceil("value").cast("long").alias("tokens"))


#: Literal hosts in many notations, and what becomes of each.
LITERALS = {
    "[::1]": "blocked_address", "[::]": "blocked_address", "[::ffff:10.0.0.1]": "blocked_address", "[::ffff:a00:1]": "blocked_address",
    "[::ffff:8.8.8.8]": "", "[fe80::1]": "blocked_address", "[FD00:0:0::1]": "blocked_address", "[ff02::1]": "blocked_address",
    "[2001:4860:4860:0:0:0:0:8888]": "", "[::1": "invalid", "0x7f.1": "blocked_address", "0177.0.0.1": "blocked_address",
    "3232235777": "blocked_address", "134744072": "", "08.8.8.8": "invalid", "256.1.1.1": "invalid", "10.0.0.1.": "blocked_address",
    "169.254.169.254": "blocked_address", "100.64.0.1": "blocked_address", "100.128.0.1": "",
}
