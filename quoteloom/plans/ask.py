"""The whole run: questions over documents, to answers whose every sentence is traced or withheld."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DRAFT_OUTPUT, TOP_K, VERDICT_OUTPUT
from ..operators import answers, scheduling
from ..operators.calls import Limits, ask_models
from ..operators.chunks import chunk_documents, number_chunks
from ..operators.retrieval import asked_files, gate, indexed, search
from ..operators.verification import verify
from ..sources.tables import saved
from .progress import Progress, Quiet, observed


@dataclass
class Prepared:
    """What is known before any model is asked."""

    chunks: DataFrame
    retrieved: DataFrame
    gated: DataFrame
    prompts: DataFrame


def prepare(docs: DataFrame, questions: DataFrame, top_k: int = TOP_K, progress: Progress = Quiet()) -> Prepared:
    """Passages, ranking, gate, and prompts of questions (question_id, question) that pass it; refused ones cost nothing."""
    progress.tell("retrieving", "Passages are made and ranked.")
    chunks = number_chunks(chunk_documents(docs, asked=asked_files(questions)))
    index, seen = observed(indexed(chunks), "index", passages=F.count("*"), words=F.sum("length"))
    retrieved = saved(search(index, questions, top_k), "retrieved")
    gated, told = observed(gate(questions, retrieved), "gated", questions=F.count("*"), relevant=F.count_if("relevant"))
    chunks = chunks.drop("terms", "length")
    prompts = answers.draft_messages(gated.where("relevant"), retrieved, chunks)
    progress.tell("drafting", "Questions that sources come close to are drafted.", **seen, **told)
    return Prepared(chunks, retrieved, gated, prompts)


@dataclass
class Result:
    questions: DataFrame
    checked: DataFrame
    sentences: DataFrame
    pending: DataFrame
    reasons: DataFrame


def finish(docs: DataFrame, prepared: Prepared, drafts: DataFrame, verdicts: DataFrame | None, progress: Progress = Quiet()) -> Result:
    """Answers from drafts (question_id, state, raw, error) and, unless the second check is off, verdicts by claim_id."""
    answered = answers.read_drafts(prepared.gated, drafts)
    progress.tell("checking", "Quotes are looked for in the sources.")
    checked, seen = observed(verify(docs, prepared.chunks, answers.claims_of(answered)), "checked", claims=F.count("*"), traced=F.count_if(F.col("reason").isNull()))
    progress.tell("entailing" if verdicts is not None else "done", "Traced sentences are judged." if verdicts is not None else "The second check is off.", **seen)
    return _merged(prepared, answered, checked, verdicts, progress)


def _merged(prepared: Prepared, answered: DataFrame, checked: DataFrame, verdicts: DataFrame | None, progress: Progress) -> Result:
    sentences = answers.merge_verdicts(checked, verdicts) if verdicts is not None else checked.withColumn("entailment", F.lit(None).cast("string"))
    if verdicts is not None:
        sentences, seen = observed(sentences, "sentences", verified=F.count_if(F.col("reason").isNull()), withheld=F.count_if(F.col("reason").isNotNull()))
        progress.tell("done", "The run has ended.", **seen)
    return Result(answers.coverage(answered, sentences), checked, sentences, answers.pending(checked), answers.reason_report(sentences))


#: Phases of a run, in order.
PHASES = ("draft", "verify")


def scheduled(prepared: Prepared, checked: DataFrame, draft_outcomes: DataFrame, verdict_outcomes: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(tasks, phases) of both passes, drafts and then verdicts, under one budget: every task as it ended, and each phase's counters.

    Outcomes are (question_id or claim_id, outcomes), what each attempt comes to,
    as :func:`quoteloom.operators.scheduling.schedule` takes them.
    """

    def tasks(requests: DataFrame, phase: str, key: str, output) -> DataFrame:
        tokens = [output(F.lit(attempt)).cast("long").alias(name) for attempt, name in ((1, "estimate"), (2, "estimate_again"))]
        named = F.concat_ws(":", F.lit(phase), F.col(key).cast("string")).alias("task_id")
        number = F.lit(PHASES.index(phase))
        return requests.select(F.lit("run").alias("budget_key"), number.alias("phase"), F.lit(0).cast("long").alias("position"), named, *tokens, "outcomes")

    drafts = prepared.prompts.join(draft_outcomes, "question_id")
    drafts = tasks(drafts, "draft", "question_id", lambda a: answers.draft_tokens(F.col("messages"), a))
    verdicts = answers.pending(checked).join(verdict_outcomes, "claim_id")
    verdicts = tasks(verdicts, "verify", "claim_id", lambda a: answers.request_tokens(F.col("messages"), answers.output_budget(VERDICT_OUTPUT, a)))
    every = saved(drafts.unionByName(verdicts), "tasks")
    name = F.element_at(F.array(*map(F.lit, PHASES)), (F.col("phase") + 1).cast("int"))
    ended, phases = (scheduling.schedule(every, counters=c, **limits).withColumn("phase", name) for c in (False, True))
    return ended, phases


#: For models that set no limit of their own.
UNBOUND = Limits(window_tokens=1 << 60, backoff_base_ms=10)


def call_model(requests: DataFrame, model: Callable[[list[dict[str, str]], int], tuple[str, str, int]], limits: Limits = UNBOUND, output: int = DRAFT_OUTPUT) -> DataFrame:
    """Replies to requests (key, messages), asked in the tasks: state done or failed, by key.

    ``model`` takes messages and the number of the attempt, and returns the text
    written, the model's name and the tokens used; what it raises fails the
    attempt.  Replies are written once, as calls cost money.
    """

    def call(body: dict, attempt: int) -> tuple[int, dict, dict]:
        text, name, tokens = model(body["messages"], attempt)
        return 200, {"model": name, "choices": [{"message": {"content": text}}], "usage": {"total_tokens": tokens}}, {}

    def allowance(attempt):
        return answers.output_budget(output, attempt)

    called = ask_models(requests, call, lambda attempt: answers.request_tokens(F.col("messages"), allowance(attempt)), allowance, limits, json_mode=False)
    return called.replies.select("key", "state", "raw", "error", "model", "attempts", "tokens_used")


def run(
    docs: DataFrame, questions: DataFrame, draft_model, judge_model=None, top_k: int = TOP_K, limits: Limits = UNBOUND, progress: Progress = Quiet()
) -> Result:
    """Both passes with models of the caller's own; without a judge the second check is off.

    Only questions that pass the gate are drafted, and only claims whose quote
    was found are judged.  ``limits`` are the provider's, for each of the two passes.
    A pass whose jobs are cancelled (``sparkContext.addJobTag`` before the run,
    ``cancelJobsWithTag`` from any other thread) keeps the replies of the rounds that
    had ended; what is still open is cancelled, and its sentences are withheld.
    """
    prepared = prepare(docs, questions, top_k, progress)
    key = F.col("question_id").cast("string").alias("key")
    replies = call_model(prepared.prompts.select(key, "messages"), draft_model, limits)
    kind = questions.schema["question_id"].dataType
    drafts = saved(replies.select(F.col("key").cast(kind).alias("question_id"), "state", "raw", "error"), "drafts")
    answered = answers.read_drafts(prepared.gated, drafts)
    progress.tell("checking", "Quotes are looked for in the sources.")
    checked, seen = observed(verify(docs, prepared.chunks, answers.claims_of(answered)), "checked", claims=F.count("*"), traced=F.count_if(F.col("reason").isNull()))
    if judge_model is None:
        progress.tell("done", "The second check is off.", **seen)
        return _merged(prepared, answered, checked, None, progress)
    progress.tell("entailing", "Traced sentences are judged.", **seen)
    asked = answers.pending(checked).select(F.col("claim_id").alias("key"), "messages")
    verdicts = saved(call_model(asked, judge_model, limits, VERDICT_OUTPUT).withColumnRenamed("key", "claim_id"), "verdicts")
    return _merged(prepared, answered, checked, verdicts, progress)
