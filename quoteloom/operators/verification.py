"""Finding every claimed quote in the sources, or saying why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_QUOTE_CHARS, MIN_QUOTE_WORDS
from ..functions.text import fold, folded_words, js_trim, project_span
from ..sources.tables import saved
from .relocation import relocate


def early_reason(quote: Column, chunk_id: Column, known: Column, folded: Column, min_words: int, min_chars: int) -> Column:
    """Why a claim needs no search, in order; null where it does."""
    uncited = quote.isNull() | (js_trim(quote) == "") | chunk_id.isNull()
    short = (F.length(folded) < min_chars) | (folded_words(folded) < min_words)
    return F.when(uncited, "no_citation").when(~known, "missing_source").when(short, "quote_too_short")


def detail(reason: Column, chunk_id: Column, words: Column, min_words: int) -> Column:
    """A sentence for a reason."""
    return (
        F.when(reason == "no_citation", "No supporting quote was given for this sentence.")
        .when(reason == "missing_source", F.concat(F.lit('Passage "'), chunk_id, F.lit('" is not among those provided.')))
        .when(reason == "quote_too_short", F.concat(F.lit("The quote has "), words.cast("string"), F.lit(f" word(s); fewer than {min_words}, or too few characters, prove nothing.")))
        .when(reason == "quote_not_found", "The quote occurs in none of the sources.")
    )


def verify(
    docs: DataFrame,
    chunks: DataFrame,
    claims: DataFrame,
    min_quote_words: int = MIN_QUOTE_WORDS,
    min_quote_chars: int = MIN_QUOTE_CHARS,
    allow_relocation: bool = True,
) -> DataFrame:
    """Claims (claim_id unique, text, chunk_id, quote) with what was found.

    Adds status, reason, detail, verified_chunk_id, relocated, span_doc_id,
    span_start, span_end and source_text.  The cited passage is searched first;
    what isn't there is looked for in the cited document and then in all others
    (:func:`quoteloom.operators.relocation.relocate`).
    ``docs`` has doc_id, doc_order and text; ``chunks`` has chunk_id, doc_id,
    index, start, end and text.
    """
    if allow_relocation and min_quote_words < 3:
        raise ValueError("relocation needs quotes of three words or more, as it finds them by their inner words")
    cited = chunks.select("chunk_id", F.col("doc_id").alias("cited_doc"), F.col("start").alias("cited_start"), F.col("text").alias("passage"))
    # cited passages only: claims are few beside passages, whose texts then stay where they are
    cited = cited.join(claims.select("chunk_id").distinct(), "chunk_id", "left_semi")
    joined = claims.join(cited, "chunk_id", "left").withColumn("folded", fold(F.coalesce("quote", F.lit(""))))
    joined = joined.withColumn("early", early_reason(F.col("quote"), F.col("chunk_id"), F.col("cited_start").isNotNull(), F.col("folded"), min_quote_words, min_quote_chars))
    joined = saved(joined, "cited-claims")
    sought = joined.where("early is null").withColumn("hit", F.instr(fold(F.col("passage")), F.col("folded")))

    def span(found: DataFrame, text: str) -> DataFrame:
        return found.withColumn("s", project_span(F.col(text), F.col("hit") - 1, F.length("folded"))).select(
            "claim_id",
            F.col("doc_id").alias("span_doc_id"),
            (F.col("base") + F.col("s.start")).alias("span_start"),
            (F.col("base") + F.col("s.end")).alias("span_end"),
            F.col(text).substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("source_text"),
            "relocated",
        )

    near = sought.where("hit > 0").select("claim_id", "folded", "hit", "passage", F.col("cited_doc").alias("doc_id"), F.col("cited_start").alias("base"), F.lit(False).alias("relocated"))
    spans = span(near, "passage")
    if allow_relocation:
        lost = saved(sought.where("hit = 0").select("claim_id", "folded", "cited_doc"), "lost-claims")
        far = saved(relocate(lost, docs), "relocated")
        spans = spans.unionByName(far.select("claim_id", F.col("doc_id").alias("span_doc_id"), "span_start", "span_end", "source_text", F.lit(True).alias("relocated")))
    owned = own(spans, chunks)
    result = joined.join(owned, "claim_id", "left")  # a row for each claim
    reason = F.coalesce("early", F.when(F.col("verified_chunk_id").isNull(), "quote_not_found"))
    keep = ["span_doc_id", "span_start", "span_end", "source_text"]
    return result.select(
        *claims.columns,
        F.when(reason.isNull(), "verified").otherwise("unverified").alias("status"),
        reason.alias("reason"),
        detail(reason, F.col("chunk_id"), folded_words(F.col("folded")), min_quote_words).alias("detail"),
        "verified_chunk_id",
        F.coalesce(F.when(reason.isNull(), F.col("relocated")), F.lit(False)).alias("relocated"),
        *[F.when(reason.isNull(), F.col(c)).alias(c) for c in keep],
    )


def own(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans with the passage that they belong to: the first that holds all of one, else the first that holds its start.

    Equal documents first, then the range: a document has few passages.
    """
    parts = chunks.select(F.col("doc_id").alias("_doc"), F.col("chunk_id").alias("_owner"), F.col("index").alias("_index"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    over = spans.join(parts, (F.col("span_doc_id") == F.col("_doc")) & (F.col("_start") <= F.col("span_start")) & (F.col("_end") > F.col("span_start")))
    order = F.struct((F.col("_end") < F.col("span_end")).alias("part"), "_index")
    kept = [F.first(c).alias(c) for c in spans.columns if c != "claim_id"]
    return over.groupBy("claim_id").agg(*kept, F.min_by("_owner", order).alias("verified_chunk_id"))
