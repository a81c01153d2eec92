import gzip
import hashlib

from quoteloom.llm import warc
from quoteloom.llm.store import fresh, open_input
from quoteloom.llm.warc import Index, archive_round_trip, build_index, parse, surt, write_archives

LONG = "<p>" + "ä" * 900

PAGES = [
    (1, "http://www.Example.com:80/a?b=1#frag", LONG),
    (2, "https://example.com/", LONG),
    (5, None, LONG),
    (5, "http://example.com/x", LONG),
    (3, "not a url", "short"),
    (4, "http://example.com/a b\r\nc", "short"),
    (6, "http://example.com/", None),
    (None, "http://example.com:8080/é", "x" * 1000),
    (-7, "http://[::1]/", "y" * 1000),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS key", "3 AS path")


def brute(rows):
    best = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page_id is not None:
            best[raw] = max(best.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        first = best.get(raw, page_id)
        revisit = first != page_id and sum((r[2] or "").encode() == raw for r in rows) > 1
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_keys():
    assert surt("http://www.Example.com:80/a?b=1#frag") == "com,example,www)/a?b=1"
    assert surt("https://example.com:8443") == "com,example:8443)/"
    assert surt(None) == "" and " " not in surt("a b\tc") and "\n" not in surt("http://x.org/a\nb")


def test_round_trip(spark):
    for block_lines in (1, 3000):
        found = archive_round_trip(pages(spark, PAGES), block_lines=block_lines).collect()
        got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str)
        assert got == brute(PAGES)


def test_files_rotate_and_records_stand_alone(spark):
    folder = fresh(spark, "test-warc")
    captures = write_archives(pages(spark, PAGES).coalesce(1), folder, "page_id", "url", "html", file_bytes=300).collect()
    assert len({c.path for c in captures}) > 1
    for c in captures:
        with open_input(c.path) as source:
            got = parse(gzip.decompress(source.read_at(c["size"], c["at"])))
        assert got["record_type"] == "revisit" or got["payload"] is not None


def test_captures_of_a_url_and_scans(spark):
    folder = fresh(spark, "test-index")
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 5}", "z") for i in range(300)]
    captures = write_archives(pages(spark, rows), folder, "page_id", "url", "html")
    index = Index(build_index(captures, folder + "/index", block_lines=4))
    assert len(index.captures("http://h3.example.org/p1")) == sum(i % 7 == 3 and i % 5 == 1 for i in range(300))
    assert index.captures("http://nowhere.org/") == []
    assert len(list(index.scan("org,example,h2)", "org,example,h2*"))) == sum(i % 7 == 2 for i in range(300))
    assert len(list(index.scan("", "\x7f"))) == 300


def test_empty_table(spark):
    assert archive_round_trip(pages(spark, [])).count() == 0
    assert warc.Index([]).captures("http://a.org/") == []
