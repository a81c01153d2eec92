import json
import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from quoteloom.functions.model_json import draft, first_object, json_object, verdict
from quoteloom.operators import answers
from quoteloom.plans import ask
from quoteloom.plans.progress import Progress
from quoteloom.streaming.events import read_events


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": {"b": "}"}} ok', '{"a": {"b": "}"}}'), ('{"a": "\\"}"} tail', '{"a": "\\"}"}'),
        ("none", None), ('{"a": 1', None), ("{a: 1}", None), ("", None), (None, None), ('\\{"a": 2}', '{"a": 2}'), ('{"a": NaN}', None),
    ],
)
def test_first_object(raw, want):
    assert first_object(raw) == want


def parse(spark, raw, f):
    return spark.createDataFrame([(raw,)], "raw string").select(f(json_object("raw")).alias("x")).first().x


def test_drafts(spark):
    raw = {"sentences": [{"text": " A fact. ", "passage": "c1", "quote": "q"}, {"sentence": "One. Two.", "chunk_id": "c2", "evidence": "e"}, {"claim": "C", "id": "c3", "support": " "}, {"text": 5}, "row", {"quote": "q"}]}
    found = parse(spark, json.dumps(raw), draft)
    assert found.sufficient
    assert [(c.text, c.chunk_id, c.quote) for c in found.claims] == [("A fact.", "c1", "q"), ("One.", "c2", "e"), ("Two.", "c2", "e"), ("C", "c3", None)]
    assert not parse(spark, '{"sufficient": false, "sentences": []}', draft).sufficient
    assert parse(spark, '{"sufficient": "no"}', draft).sufficient
    broken = parse(spark, "what?", draft)
    assert not broken.sufficient and broken.claims == []


def test_verdicts(spark):
    assert tuple(parse(spark, '{"supported": true, "reason": "ok"}', verdict)) == (True, "ok")
    assert tuple(parse(spark, '{"supported": false}', verdict)) == (False, "not stated in passage")
    assert tuple(parse(spark, '{"supported": "true"}', verdict)) == (False, "not stated in passage")
    assert tuple(parse(spark, "", verdict)) == (False, "unreadable verdict")
    assert len(parse(spark, json.dumps({"supported": True, "reason": "x" * 500}), verdict).reason) == 120


def test_request_tokens(spark):
    df = spark.createDataFrame([([("user", "a" * 36), ("user", "")],)], "m array<struct<role:string,content:string>>")
    row = df.select(answers.request_tokens(F.col("m"), 900).alias("a"), answers.draft_tokens(F.col("m"), F.lit(2)).alias("b")).first()
    assert (row.a, row.b) == (3 + 14 + 4 + 900, 3 + 14 + 4 + 1800)


DOC = "The harbour opened in 1890 after long delays. It holds sixty boats in winter. Its crane lifts twenty tonnes at most."


@pytest.fixture(scope="module")
def prepared(spark):
    docs = spark.createDataFrame([("d", 0, "Harbour", DOC)], "doc_id string, doc_order long, title string, text string")
    texts = ["When was the harbour opened?", "How many boats does the harbour hold?", "What does the crane lift?", "harbour crane", "Who won the cup in Lisbon?"]
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")
    return docs, ask.prepare(docs, questions)


def claim(text, quote, passage="c0"):
    return {"text": text, "passage": passage, "quote": quote}


def run(spark, prepared, verdict_rows):
    docs, ready = prepared
    good, bad = claim("It opened in 1890.", "harbour opened in 1890 after long delays"), claim("It holds ninety.", "It holds ninety boats in winter")
    drafts = [
        (0, "done", json.dumps({"sentences": [good, bad]}), None),
        (1, "done", json.dumps({"sentences": [bad]}), None),
        (2, "failed", None, "timeout"),
        (3, "done", '{"sufficient": false, "sentences": []}', None),
    ]
    drafts = spark.createDataFrame(drafts, "question_id long, state string, raw string, error string")
    verdicts = None if verdict_rows is None else spark.createDataFrame(verdict_rows, "claim_id string, state string, raw string, error string, model string, attempts int, tokens_used int")
    return ask.finish(docs, ready, drafts, verdicts)


def outcome(result):
    return {r.question_id: (r.outcome, r.verified, r.total, r.ratio) for r in result.questions.collect()}


def test_only_relevant_questions_are_asked(prepared):
    _, ready = prepared
    rows = {r.question_id: r for r in ready.prompts.collect()}
    assert set(rows) == {0, 1, 2, 3}
    assert '[c0] (from "Harbour")\n' + DOC in rows[0].messages[1].content and "QUESTION: When was the harbour opened?" in rows[0].messages[1].content


def test_supported_claims(spark, prepared):
    result = run(spark, prepared, [("0:0", "done", '{"supported": true, "reason": "r"}', None, "m", 1, 100)])
    assert outcome(result) == {0: ("answered", 1, 2, 0.5), 1: ("answered", 0, 1, 0.0), 2: ("draft_failed", 0, 0, 0.0), 3: ("model_declined", 0, 0, 0.0), 4: ("no_relevant_source", 0, 0, 0.0)}
    notices = {r.question_id: r.notice for r in result.questions.collect()}
    assert notices[0] is None and "No sentence" in notices[1] and "timeout" in notices[2]
    shown = {r.claim_id: r for r in result.sentences.collect()}
    assert shown["0:0"].entailment.reason == "r" and shown["0:1"].reason == "quote_not_found"
    assert [r.claim_id for r in result.pending.collect()] == ["0:0"]
    assert {r.reason: r.n for r in result.reasons.collect()} == {"quote_not_found": 2}


@pytest.mark.parametrize(
    ("rows", "reason"),
    [
        ([], "check_failed"),
        ([("0:0", "failed", None, "timeout", None, 5, 0)], "check_failed"),
        ([("0:0", "done", '{"supported": "yes"}', None, "m", 1, 9)], "not_entailed"),
        ([("0:0", "done", None, None, "m", 1, 9)], "not_entailed"),
        ([("0:0", None, '{"supported": true}', None, "m", 1, 9)], "check_failed"),
    ],
)
def test_second_check_fails_closed(spark, prepared, rows, reason):
    result = run(spark, prepared, rows)
    row = {r.claim_id: r for r in result.sentences.collect()}["0:0"]
    assert (row.status, row.reason) == ("unverified", reason) and row.span_start is not None and row.source_text
    assert outcome(result)[0] == ("answered", 0, 2, 0.0)


def test_second_check_off(spark, prepared):
    assert outcome(run(spark, prepared, None))[0] == ("answered", 1, 2, 0.5)


def test_ledger_and_rows(spark, prepared):
    result = run(spark, prepared, [])
    phases = spark.createDataFrame(
        [("draft", 4, 1, 0, 0, 0, 900, 800, 5, 3, 10), ("verify", 1, 0, 2, 1, 1, 90, 80, 3, 7, 20)],
        "phase string, tasks long, failed long, retries long, rate_limit_hits long, budget_waits long, tokens_estimated long, tokens_actual long, dispatched long, peak_concurrency long, wall_clock_ms long",
    )
    row = answers.run_ledger(result.questions, result.checked, result.sentences, phases).first()
    assert (row.questions, row.checked, row.passed, row.rejected, row.verified, row.unverified) == (5, 3, 1, 2, 0, 3)
    assert (row.model_calls, row.peak_concurrency, row.claims_dispatched, row.retries_absorbed) == (8, 7, 1, 2)
    assert row.by_reason == {"quote_not_found": 2, "check_failed": 1}
    shown = answers.answer_rows(result.sentences, prepared[1].retrieved).collect()
    assert {r.n_retrieved for r in shown} == {1}


def test_claims_are_capped_and_questions_parsed(spark):
    df = spark.createDataFrame([(1, [("t", "c", "q")] * 300)], "question_id long, claims array<struct<text:string,chunk_id:string,quote:string>>")
    assert answers.claims_of(df).count() == 250
    lists = spark.createDataFrame([(1, " first \nx\n\nsecond?\n" + "third\n" * 40)], "list_id long, text string")
    rows = answers.parse_questions(lists, 3, 25).orderBy("position").collect()
    assert len(rows) == 25 and [r.question for r in rows[:2]] == ["first", "second?"]


def test_highlight(spark):
    docs = spark.createDataFrame([("d", DOC)], "doc_id string, text string")
    spans = spark.createDataFrame([("d", 4, 11)], "span_doc_id string, span_start int, span_end int")
    row = answers.highlight(spans, docs, 10).first()
    assert (row.before, row.marked, row.after) == ("The ", "harbour", " opened in")


def test_run_with_models(spark, prepared):
    docs, _ = prepared
    texts = ["When was the harbour opened?", "How many boats does the harbour hold?", "Who won the cup in Lisbon?"]
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")

    def drafter(messages, attempt):
        if "boats" in messages[1]["content"].split("QUESTION:")[1]:
            raise TimeoutError("busy")
        if attempt < 2:
            raise TimeoutError("once")
        quote = "harbour opened in 1890 after long delays"
        return '{"sentences": [{"text": "In 1890.", "passage": "c0", "quote": "%s"}, {"text": "Late.", "passage": "c0", "quote": "%s"}]}' % (quote, quote), "drafter", 50

    def judge(messages, attempt):
        assert "PASSAGE" in messages[1]["content"] and "QUESTION" not in messages[1]["content"]
        return '{"supported": %s}' % ("true" if "1890." in messages[1]["content"].split("STATEMENT")[1] else "false"), "judge", 9

    result = ask.run(docs, questions, drafter, judge)
    assert outcome(result) == {0: ("answered", 1, 2, 0.5), 1: ("draft_failed", 0, 0, 0.0), 2: ("no_relevant_source", 0, 0, 0.0)}
    shown = {r.text: r for r in result.sentences.collect()}
    assert shown["In 1890."].entailment.model == "judge" and shown["Late."].reason == "not_entailed"
    assert "busy (after 5 attempt(s))" in {r.question_id: r.notice for r in result.questions.collect()}[1]
    assert outcome(ask.run(docs, questions, drafter))[0] == ("answered", 2, 2, 1.0)


def test_a_run_tells_and_can_be_stopped(spark, prepared, tmp_path):
    """The judge's job is cancelled: phases were told as they ended, drafts stay, and unjudged sentences are withheld."""
    docs, _ = prepared
    questions = spark.createDataFrame([(0, "When was the harbour opened?")], "question_id long, question string")
    mark, found = tmp_path / "asked", []

    def drafter(messages, attempt):
        return '{"sentences": [{"text": "In 1890.", "passage": "c0", "quote": "harbour opened in 1890 after long delays"}]}', "drafter", 50

    def judge(messages, attempt):
        mark.write_text("x")
        time.sleep(60)

    def whole():
        spark.sparkContext.addJobTag("run-1")
        found.append(ask.run(docs, questions, drafter, judge, progress=Progress(spark, str(tmp_path / "events"))))

    thread = InheritableThread(target=whole)
    thread.start()
    while not mark.exists():
        assert thread.is_alive()
        time.sleep(0.1)
    assert [r.phase for r in read_events(spark, str(tmp_path / "events")).where("type = 'phase'").orderBy("seq").collect()] == ["retrieving", "drafting", "checking", "entailing"]
    spark.sparkContext.cancelJobsWithTag("run-1")
    thread.join(60)
    assert outcome(found[0]) == {0: ("answered", 0, 1, 0.0)}
    row = found[0].sentences.first()
    assert row.reason == "check_failed" and "cancelled" in row.detail and row.source_text
    told = read_events(spark, str(tmp_path / "events")).where("type = 'counters'").orderBy("seq").collect()
    assert [json.loads(r.payload) for r in told][1:] == [{"phase": "entailing", "claims": 1, "traced": 1}, {"phase": "done", "verified": 0, "withheld": 1}]
