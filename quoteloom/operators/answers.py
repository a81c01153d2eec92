"""Prompts, draft and verdict outcomes, coverage and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DRAFT_OUTPUT, HIGHLIGHT_CHARS, MAX_CLAIMS, MESSAGE_OVERHEAD, OUTPUT_ESCALATION, REASONS, REQUEST_OVERHEAD
from ..functions.model_json import draft, json_object, verdict
from ..functions.text import estimate_tokens

# The shapes of replies that the parsers read, and the frames around passages and statements.
DRAFT_SHAPE = '{"sufficient": true, "sentences": [{"text": "...", "passage": "c0", "quote": "..."}]}'
DECLINED_SHAPE = '{"sufficient": false, "sentences": []}'
PASSAGES_FRAME, QUESTION_FRAME = "PASSAGES:\n\n", "\n\nQUESTION: "
PASSAGE_FRAME, STATEMENT_FRAME, FRAME_END = 'PASSAGE:\n"""', '"""\n\nSTATEMENT:\n"""', '"""'

DRAFT_RULES = f"""A program reads this reply, so it has to be one JSON object:
{DRAFT_SHAPE}
An entry is one sentence (five entries are plenty), the id of the passage it rests on, and evidence: a stretch of that
passage, half a dozen words or longer, typed over letter for letter. The program searches the passage for the evidence
and throws away every entry whose evidence it can't find.
Where the passages leave the question open, this object is the right reply:
{DECLINED_SHAPE}"""

VERDICT_RULES = """Suppose a reader has the passage and no other knowledge. Must that reader accept the whole statement?
Reply with one JSON object: "supported" is true or false, "reason" says why in a few words."""

REASON_LABELS = {
    "no_citation": "uncited",
    "missing_source": "unknown passage",
    "quote_too_short": "too few words quoted",
    "quote_not_found": "words found nowhere",
    "not_entailed": "judged unsupported",
    "check_failed": "never judged",
}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def draft_messages(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, messages): what is asked about each question, over its passages in rank order."""
    passages = retrieved.join(chunks.select("chunk_id", "doc_title", "text"), "chunk_id")
    shown = F.concat(F.lit("["), F.col("chunk_id"), F.lit('] (from "'), F.col("doc_title"), F.lit('")\n'), F.col("text"))
    joined = passages.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown")))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["shown"]), "\n\n")
    asked = F.concat(F.lit(PASSAGES_FRAME), text, F.lit(QUESTION_FRAME), F.col("question"))
    return questions.join(joined, "question_id").select("question_id", F.array(message("system", F.lit(DRAFT_RULES)), message("user", asked)).alias("messages"))


def verdict_messages(sentence: Column, source: Column) -> Column:
    """What is asked about one sentence: only its passage and itself."""
    asked = F.concat(F.lit(PASSAGE_FRAME), source, F.lit(STATEMENT_FRAME), sentence, F.lit(FRAME_END))
    return F.array(message("system", F.lit(VERDICT_RULES)), message("user", asked))


def request_tokens(messages: Column, output: Column | int) -> Column:
    """Tokens to reserve for a request: its messages, and its output allowance."""
    output = output if isinstance(output, Column) else F.lit(output)
    size = F.aggregate(messages, F.lit(0).cast("long"), lambda a, m: a + estimate_tokens(m["content"]) + MESSAGE_OVERHEAD)
    return F.lit(REQUEST_OVERHEAD) + size + F.greatest(F.lit(0), output)


def output_budget(base: int, attempt: Column) -> Column:
    """Output allowance: raised once, from the second attempt on."""
    return F.when(attempt <= 1, base).otherwise(base * OUTPUT_ESCALATION)


def draft_tokens(messages: Column, attempt: Column) -> Column:
    return request_tokens(messages, output_budget(DRAFT_OUTPUT, attempt))


def read_drafts(gated: DataFrame, drafts: DataFrame) -> DataFrame:
    """Gated questions with outcome, notice and claims.

    ``drafts`` has question_id, state (done, failed, cancelled), raw and error;
    a relevant question without a row counts as cancelled.
    """
    parsed = drafts.select("question_id", F.col("state").alias("draft_state"), "error", draft(json_object("raw")).alias("d"))
    joined = gated.join(parsed, "question_id", "left")
    declined = ~F.col("d.sufficient") | (F.size("d.claims") == 0)
    done = F.coalesce(F.col("draft_state") == "done", F.lit(False))
    outcome = F.when(~F.col("relevant"), "no_relevant_source").when(~done, "draft_failed").when(declined, "model_declined").otherwise("answered")
    notice = (
        F.when(outcome == "no_relevant_source", "No source comes close enough to this question to answer from.")
        .when((outcome == "draft_failed") & (F.col("draft_state") == "failed"), F.concat(F.lit("The draft did not complete: "), F.coalesce("error", F.lit(""))))
        .when(outcome == "draft_failed", "The draft was cancelled.")
        .when(outcome == "model_declined", "The closest passages were read and do not answer this question.")
    )
    return joined.select(*gated.columns, outcome.alias("outcome"), notice.alias("notice"), F.when(outcome == "answered", F.col("d.claims")).alias("claims"))


def claims_of(answered: DataFrame, most: int = MAX_CLAIMS) -> DataFrame:
    """(claim_id, question_id, claim_idx, text, chunk_id, quote): the first claims of each answer."""
    rows = answered.select("question_id", F.posexplode(F.slice("claims", 1, most)).alias("claim_idx", "c"))
    return rows.select(
        F.concat_ws(":", F.col("question_id").cast("string"), F.col("claim_idx").cast("string")).alias("claim_id"),
        "question_id",
        "claim_idx",
        "c.text",
        "c.chunk_id",
        "c.quote",
    )


def merge_verdicts(checked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Checked claims after the second check, which fails closed.

    ``verdicts`` has claim_id, state, raw, error, model, attempts and
    tokens_used.  A verified claim stays so only with a finished verdict that
    supports it; a missing verdict withholds it.  Spans and source texts stay.
    """
    read = verdicts.select("claim_id", F.col("state").alias("v_state"), F.col("error").alias("v_error"), "model", "attempts", "tokens_used", verdict(json_object("raw")).alias("v"))
    joined = checked.join(read, "claim_id", "left")
    was = F.col("status") == "verified"
    done = F.coalesce(F.col("v_state") == "done", F.lit(False))
    supported = done & F.coalesce(F.col("v.supported"), F.lit(False))
    reason = F.when(~was, F.col("reason")).when(supported, None).when(done, "not_entailed").otherwise("check_failed")
    why = F.when(F.col("v_state") == "failed", F.coalesce("v_error", F.lit(""))).otherwise("it was cancelled")
    told = (
        F.when(~was, F.col("detail"))
        .when(supported, None)
        .when(done, F.concat(F.lit("The quote is in the source but does not support this sentence ("), F.col("v.reason"), F.lit(").")))
        .otherwise(F.concat(F.lit("The quote is in the source, but the second check did not finish ("), why, F.lit("); the sentence is withheld.")))
    )
    entailment = F.when(was & supported, F.struct(F.lit(True).alias("supported"), F.col("v.reason").alias("reason"), "model", "attempts", "tokens_used"))
    changed = {"status": F.when(was & supported, "verified").otherwise("unverified"), "reason": reason, "detail": told}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in checked.columns], entailment.alias("entailment"))


def coverage(answered: DataFrame, sentences: DataFrame) -> DataFrame:
    """Questions with verified, total and ratio (0 without sentences), and the notice where none was verified."""
    counts = sentences.groupBy("question_id").agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count("*").alias("total"))
    joined = answered.join(counts, "question_id", "left").fillna(0, ["verified", "total"])
    ratio = F.when(F.col("total") > 0, F.col("verified") / F.col("total")).otherwise(0.0)
    notice = F.when((F.col("total") > 0) & (F.col("verified") == 0), "No sentence of this answer could be traced to the sources, so none is shown.").otherwise(F.col("notice"))
    return joined.withColumn("ratio", ratio).withColumn("notice", notice)


def mechanical_tally(checked: DataFrame) -> DataFrame:
    """One row: claims checked, passed and rejected by search alone."""
    passed = F.count_if(F.col("status") == "verified")
    return checked.agg(F.count("*").alias("checked"), passed.alias("passed"), (F.count("*") - passed).alias("rejected"))


def reason_report(sentences: DataFrame) -> DataFrame:
    """(position, reason, label, n): reasons that occur, in their fixed order."""
    counts = sentences.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    known = [(i, r, REASON_LABELS[r]) for i, r in enumerate(REASONS)]
    labels = sentences.sparkSession.createDataFrame(known, "position int, reason string, label string")
    return counts.join(F.broadcast(labels), "reason").select("position", "reason", "label", "n")


def run_ledger(questions: DataFrame, checked: DataFrame, final: DataFrame, phases: DataFrame) -> DataFrame:
    """One row for a run: its counters over both phases, and the tally of the first check.

    ``phases`` has a row for each scheduled phase (draft, verify) with the
    counters of :func:`quoteloom.operators.scheduling.schedule`; peaks are the
    greatest of the phases', other counters are summed.  :func:`quoteloom.plans.ask.scheduled`
    makes them of the run's own requests.
    """
    sums = ["failed", "retries", "rate_limit_hits", "budget_waits", "tokens_estimated", "tokens_actual", "dispatched"]
    names = {"retries": "retries_absorbed", "dispatched": "model_calls"}
    run = phases.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(names.get(c, c)) for c in sums],
        F.coalesce(F.max("peak_concurrency"), F.lit(0)).alias("peak_concurrency"),
        F.coalesce(F.sum("wall_clock_ms"), F.lit(0)).alias("wall_clock_ms"),
        F.coalesce(F.sum(F.when(F.col("phase") == "verify", F.col("tasks"))), F.lit(0)).alias("claims_dispatched"),
    )
    shown = final.agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "unverified").alias("unverified"))
    reasons = reason_report(final).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("position", "reason", "n"))), lambda r: F.struct(r["reason"], r["n"]))).alias("by_reason"))
    return questions.agg(F.count("*").alias("questions")).crossJoin(shown).crossJoin(mechanical_tally(checked)).crossJoin(reasons).crossJoin(run)  # one row each


def pending(checked: DataFrame) -> DataFrame:
    """Verified claims, with the messages and tokens of their second check."""
    asked = verdict_messages(F.col("text"), F.col("source_text"))
    return checked.where("status = 'verified'").withColumn("messages", asked)


def highlight(spans: DataFrame, docs: DataFrame, chars: int = HIGHLIGHT_CHARS) -> DataFrame:
    """Spans (span_doc_id, span_start, span_end) with the marked text and what stands around it."""
    joined = spans.join(docs.select(F.col("doc_id").alias("span_doc_id"), F.col("text").alias("_whole")), "span_doc_id")
    first = F.greatest(F.lit(0), F.col("span_start") - chars)
    last = F.least(F.length("_whole"), F.col("span_end") + chars)
    return joined.select(
        *spans.columns,
        F.col("_whole").substr(first + 1, F.col("span_start") - first).alias("before"),
        F.col("_whole").substr(F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("marked"),
        F.col("_whole").substr(F.col("span_end") + 1, last - F.col("span_end")).alias("after"),
    )


def answer_rows(sentences: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Sentences as they are shown, with how many passages their question had and the best coverage in per cent."""
    found = retrieved.groupBy("question_id").agg(F.count("*").alias("n_retrieved"), F.round(100 * F.max("coverage")).cast("int").alias("best_coverage_pct"))
    mark = F.when(F.col("relocated"), F.concat(F.col("verified_chunk_id"), F.lit("*"))).otherwise(F.col("verified_chunk_id"))
    return sentences.join(found, "question_id", "left").withColumn("shown_passage", mark)


def parse_questions(lists: DataFrame, least: int, most: int) -> DataFrame:
    """(list_id, position, question) of texts with a question a line: trimmed, long enough, and the first so many."""
    from ..functions.text import js_trim

    lines = lists.select("list_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("question", js_trim(F.col("raw")))
    kept = lines.where(F.length("question") >= least)
    position = F.row_number().over(Window.partitionBy("list_id").orderBy("line"))
    return kept.withColumn("position", position).where(F.col("position") <= most).select("list_id", "position", "question")
