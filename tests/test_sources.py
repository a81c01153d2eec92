import pytest
from pyspark.sql import functions as F

from quoteloom.sources import documents as sources
from quoteloom.streaming import events as streaming

from .conftest import exchanged


def test_pasted_and_files(spark, tmp_path):
    texts = spark.createDataFrame([(0, " hi \n"), (1, " \n"), (2, "x" * 400_001)], "position long, text string")
    assert [(r.title, r.fault) for r in sources.pasted(texts).orderBy("position").collect()] == [("Pasted text 1", None), ("Pasted text 2", "blank"), ("Pasted text 3", "doc_too_large")]
    for name, text in {"a.txt": "text", "b.md": "y" * 400_100, "c.markdown": "  ", "d.html": "<p>", "e.txt": "z" * 2_000_001}.items():
        (tmp_path / name).write_text(text)
    found = {r.title: (r.text and len(r.text), r.fault) for r in sources.files(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": (4, None), "b.md": (400_000, None), "c.markdown": (2, "blank"), "e.txt": (None, "too_large")}


def test_fetched(spark):
    rows = [
        ("http://x.org/a?q=1", 200, "text/html", "<title>T</title><p>Some text.</p>"), ("http://x.org/b", 200, "text/plain", "plain"), ("http://x.org/c", 500, "text/html", "x"),
        ("http://x.org/d", 200, "image/png", "x"), ("http://x.org/e", 200, None, " "), ("http://x.org/f", 200, "text/plain", "y" * 2_000_001),
    ]
    found = {r.url[-1]: (r.title, r.fault, r.truncated) for r in sources.fetched(spark.createDataFrame(rows, "url string, status int, content_type string, body string")).collect()}
    assert found["1"] == ("T", None, False) and found["b"] == ("x.org/b", None, False)
    assert [found[k][1] for k in "cdef"] == ["http_status", "content_type", "no_text", "too_large"] and found["f"][2]


def test_documents_of_urls(spark):
    urls = spark.createDataFrame([("http://a.org/1",), ("http://b.org/",), ("http://a.org/2",), ("http://gone.org/",), ("http://10.0.0.1/",), ("http://a.org/big",), ("http://a.org/1",)], "url string")
    rows = [
        ("http://a.org/1", 301, "/2", None, None, None), ("http://b.org/", 302, "http://a.org/2", None, None, None), ("http://a.org/2", 200, None, "text/plain", 4, "text"),
        ("http://a.org/big", 200, None, "text/plain", 2_000_001, "small"), ("http://a.org/unasked", 200, None, "text/plain", 1, "x"),
    ]
    replies = spark.createDataFrame(rows, "url string, status int, location string, content_type string, declared long, body string")
    dns = spark.createDataFrame([("a.org", "8.8.8.8"), ("b.org", "8.8.8.8"), ("gone.org", "8.8.8.8")], "host string, address string")
    found = {r.url: (r.target, r.hop, r.title, r.text, r.fault) for r in sources.from_urls(urls, replies, dns).collect()}
    assert found == {
        "http://a.org/1": ("http://a.org/2", 1, "a.org/2", "text", None), "http://b.org/": ("http://a.org/2", 1, "a.org/2", "text", None), "http://a.org/2": ("http://a.org/2", 0, "a.org/2", "text", None),
        "http://gone.org/": ("http://gone.org/", 0, None, None, "unreachable"), "http://10.0.0.1/": ("http://10.0.0.1/", 0, None, None, "blocked_address"), "http://a.org/big": ("http://a.org/big", 0, None, None, "too_large"),
    }
    assert sources.from_urls(urls.limit(0), replies, dns).collect() == []


def test_admission(spark):
    docs = spark.createDataFrame([(i, i * 40_000, "x" * n) for i, n in enumerate([300_000, 400_001, 300_000, 300_000, 1])], "doc_id long, doc_order long, text string")
    rows = sources.admitted(docs).orderBy("doc_order").collect()
    assert [r.fault for r in rows] == [None, "doc_too_large", None, "corpus_too_large", "corpus_too_large"]
    assert [r.chars_before for r in rows][:3] == [0, 300_000, 700_001]
    assert sorted((r.doc_id, len(r.text)) for r in sources.let_in(docs).collect()) == [(0, 300_000), (2, 300_000)]
    assert "text" not in exchanged(sources.admitted(docs))
    assert [r.doc_id for r in sources.first_docs(docs, held=18).collect()] == [0, 1]


def test_request_faults(spark):
    schema = "request_id long, docs array<struct<id:string,title:string,origin:string,text:string,url:string>>, questions array<string>, concurrency int, tokens_per_window int, top_k int"
    doc = ("d", "T", "paste", "text", None)
    rows = [
        (0, [doc], ["why?"], 10, 8000, 6), (1, [], ["why?"], None, None, None), (2, [doc], [" a "], None, None, None), (3, [("", "T", "mail", "x", None)], ["why?"], None, None, None),
        (4, [doc], ["why?"], 201, 499, 21), (5, [("d", "T", "paste", " ", None)], ["why?"], None, None, None), (6, [("d", "T", "url", "x" * 400_000, "u" * 2049)] * 4, ["why?"], None, None, None),
        (7, [("d", "T", "paste", "x" * 400_000, None)] * 4, ["why?"], None, None, None), (8, None, None, None, None, None),
    ]
    found = {r.request_id: r.violations for r in sources.request_faults(spark.createDataFrame(rows, schema)).collect()}
    assert found == {
        0: [], 1: ["docs"], 2: ["questions.0"], 3: ["docs.0.id", "docs.0.origin"], 4: ["concurrency", "tokens_per_window", "top_k"], 5: ["all_blank"],
        6: [f"docs.{i}.url" for i in range(4)], 7: ["corpus_too_large"], 8: ["docs", "questions"],
    }
    sizes = spark.createDataFrame([("x",), ("é" * 1_000_000,), ("é" * 1_000_000 + "x",), (None,)], "body string")
    assert [r.f for r in sizes.select(sources.body_fault(F.col("body")).alias("f")).collect()] == [None, None, "body_too_large", None]


def test_events_round_trip_and_broken_lines(spark, tmp_path):
    path = str(tmp_path / "events")
    phases = spark.createDataFrame([(0, "retrieving", "Indexing")], "seq long, phase string, detail string")
    tasks = spark.createDataFrame([(1, "draft", "a", "A", "queued", 0), (2, "draft", "a", None, "done", 1)], "seq long, phase string, task_id string, label string, state string, attempts int")
    streaming.write_events(streaming.run_events(phases, tasks), path)
    (tmp_path / "events" / "cut.json").write_text('\n{"seq": 9, "type": "sched\n')
    assert [r.type for r in streaming.read_events(spark, path).orderBy("seq").collect()] == ["phase", "scheduler", "scheduler"]
    to = str(tmp_path / "board")
    streaming.live_board(streaming.stream_events(spark, path), to).awaitTermination()
    assert [(r.task_id, r.label, r.state) for r in streaming.board_now(spark, to).collect()] == [("a", "A", "done")]
    more = spark.createDataFrame([(3, "draft", "b", None, "running", 1), (4, "draft", "a", None, "failed", 2)], tasks.schema)
    streaming.write_events(streaming.run_events(phases.limit(0), more), path)
    streaming.live_board(streaming.stream_events(spark, path), to).awaitTermination()  # resumes where it stopped
    assert sorted((r.task_id, r.label, r.state, r.attempts) for r in streaming.board_now(spark, to).collect()) == [("a", "A", "failed", 2), ("b", "b", "running", 1)]


def test_other_events_carry_a_payload(spark):
    phases = spark.createDataFrame([(0, "done", "Complete")], "seq long, phase string, detail string")
    tasks = spark.createDataFrame([], "seq long, phase string, task_id string, label string, state string, attempts int")
    models = spark.createDataFrame([(1, "a", "b")], "seq long, draft string, verify string")
    error = spark.createDataFrame([(2, "it broke")], "seq long, message string")
    found = {r.type: r.payload for r in streaming.run_events(phases, tasks, models=models, error=error).collect()}
    assert found == {"phase": None, "models": '{"draft":"a","verify":"b"}', "error": '{"message":"it broke"}'}


def test_oversized_files_are_not_read(spark, tmp_path):
    big = tmp_path / "big.md"
    big.write_text("x" * 2_000_001)
    (tmp_path / "a.txt").write_bytes(b"ab\xffc")
    (tmp_path / "b.markdown").write_text(" \n")
    (tmp_path / "c.csv").write_text("no")
    rows = sources.files(spark, str(tmp_path))
    big.chmod(0)
    assert {r.title: (r.text, r.fault) for r in rows.collect()} == {"a.txt": ("ab\ufffdc", None), "b.markdown": (" \n", "blank"), "big.md": (None, "too_large")}


def test_streamed_budget(spark, tmp_path):
    rows = [("k", "reserve", "a", 0, 600), ("k", "reserve", "b", 1, 600), ("k", "reconcile", "a", 2, 900), ("k", "reserve", "c", 3, 200), ("k", "release", "a", 4, 0), ("k", "reserve", "d", 5, 1000), ("k", "reserve", "e", 60_006, 1001), ("k", "reserve", "f", 60_007, 1000)]
    schema = "budget_key string, op string, id string, at_ms long, tokens long"
    path = str(tmp_path / "asked")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    out = streaming.stream_reservations(spark.readStream.schema(schema).parquet(path), 1000, 60_000)
    to = str(tmp_path / "budget")
    streaming.answered_to(out, to).awaitTermination()
    found = {r.id: (r.verdict, r.retry_at_ms) for r in spark.read.parquet(f"{to}/answers").collect()}
    assert found == {"a": ("ok", None), "b": ("window_full", 60_000), "c": ("window_full", 60_000), "d": ("ok", None), "e": ("exceeds_ceiling", None), "f": ("ok", None)}


def test_a_batch_is_published_once(spark, tmp_path):
    path = str(tmp_path / "events")
    phases = spark.createDataFrame([(0, "retrieving", "a"), (1, "done", "b")], "seq long, phase string, detail string")
    none = spark.createDataFrame([], "seq long, phase string, task_id string, label string, state string, attempts int")
    events = streaming.run_events(phases, none)
    assert streaming.publish_batch(events, path, 0) and not streaming.publish_batch(events, path, 0)
    assert streaming.publish_batch(events.where("seq = 1"), path, 1)
    broken = events.withColumn("phase", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        streaming.publish_batch(broken, path, 2)
    assert sorted(r.seq for r in streaming.read_events(spark, path).collect()) == [0, 1, 1]
    assert streaming.publish_batch(events, path, 2) and streaming.read_events(spark, path).count() == 5
