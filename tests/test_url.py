import pytest
from pyspark.sql import functions as F

from quoteloom.functions.url import assess, blocked_address, is_blocked_ipv4, parse_ipv4, resolve
from quoteloom.sources.documents import followed, guarded


@pytest.mark.parametrize(
    ("url", "fault"),
    [
        ("https://example.com/a", ""), (" http://example.com:80 ", ""), ("https://example.com:443/", ""), ("http://8.8.8.8/", ""),
        ("ftp://example.com", "scheme"), ("file:///etc/passwd", "scheme"), ("javascript:alert(1)", "scheme"), ("http://example.com:22", "port"),
        ("http://localhost", "blocked_host"), ("http://LOCALHOST./", "blocked_host"), ("http://a.localhost", "blocked_host"), ("http://metadata.google.internal/x", "blocked_host"),
        ("http://127.0.0.1", "blocked_address"), ("http://2130706433", "blocked_address"), ("http://0x7f.1", "blocked_address"), ("http://0177.0.0.1", "blocked_address"),
        ("http://[::1]/", "blocked_address"), ("http://[::ffff:127.0.0.1]/", "blocked_address"), ("http://[fd00::1]", "blocked_address"), ("http://169.254.169.254/", "blocked_address"),
        ("not a url", "invalid"), ("", "invalid"), ("http://", "invalid"), ("http://1.2.3.4.5", "invalid"), ("http://300.1.1.1", "invalid"), ("http://user:p@example.com", ""), (None, "invalid"),
    ],
)
def test_urls(url, fault):
    assert assess(url) == fault


@pytest.mark.parametrize(
    ("address", "blocked"),
    [
        ("10.0.0.1", True), ("11.0.0.1", False), ("172.15.0.1", False), ("172.16.0.1", True), ("172.31.9.9", True), ("172.32.0.1", False), ("100.63.0.1", False), ("100.64.0.1", True),
        ("192.0.0.1", True), ("192.0.1.1", False), ("192.0.2.1", True), ("198.18.0.1", True), ("198.20.0.1", False), ("198.51.100.7", True), ("203.0.113.7", True), ("223.1.1.1", False), ("224.0.0.1", True), ("255.255.255.255", True), ("0.1.2.3", True),
        ("::1", True), ("::", True), ("fe80::1%eth0", True), ("fd12::1", True), ("ff02::1", True), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("2001:4860:4860::8888", False), ("example.com", False),
    ],
)
def test_addresses(spark, address, blocked):
    assert blocked_address(address) == blocked
    row = spark.createDataFrame([(address,)], "a string").select(parse_ipv4(F.col("a")).alias("o")).select("o", is_blocked_ipv4(F.col("o")).alias("b")).first()
    if ":" not in address and address != "example.com":
        assert row.b == blocked
    else:
        assert row.o is None


@pytest.mark.parametrize(
    ("location", "target", "fault"),
    [
        (r"\\10.0.0.1/y", "https://10.0.0.1/y", "blocked_address"), (r"/\10.0.0.1/y", "https://10.0.0.1/y", "blocked_address"),
        ("/\t/10.0.0.1/y", "https://10.0.0.1/y", "blocked_address"), ("ht\ntp://127.0.0.1", "http://127.0.0.1", "blocked_address"),
        (r"https:\\10.0.0.1", "https://10.0.0.1", "blocked_address"), (r"http:\10.0.0.1", "http://10.0.0.1", "blocked_address"),
        ("http:10.0.0.1", "http://10.0.0.1", "blocked_address"), ("https:c", "https://a.com/p/c", ""), ("////8.8.8.8/x", "https://8.8.8.8/x", ""),
        (r"b\..\c?d=\e", r"https://a.com/p/c?d=\e", ""), ("  /q#f ", "https://a.com/q#f", ""), ("?z", "https://a.com/p/x?z", ""),
        ("x:y", "x:y", "scheme"), ("./x:y", "https://a.com/p/x:y", ""), ("javascript:alert(1)", "javascript:alert(1)", "scheme"),
    ],
)
def test_redirects_as_browsers_resolve_them(location, target, fault):
    assert resolve(location, "https://a.com/p/x") == target and assess(target) == fault


def test_names_and_redirects(spark):
    urls = spark.createDataFrame([(f"http://{h}/",) for h in ("pub.org", "mixed.org", "none.org", "8.8.8.8")], "url string")
    dns = spark.createDataFrame([("pub.org", "8.8.8.8"), ("mixed.org", "8.8.8.8"), ("mixed.org", "10.0.0.1")], "host string, address string")
    assert {r.url: r.fault for r in guarded(urls, dns).collect()} == {"http://pub.org/": None, "http://mixed.org/": "private_address", "http://none.org/": "unresolved", "http://8.8.8.8/": None}
    hops = [("http://pub.org/", "/b"), ("http://pub.org/b", "http://127.0.0.1/"), ("http://8.8.8.8/", None), ("http://pub.org/loop", "/loop")]
    redirects = spark.createDataFrame(hops, "url string, location string")
    starts = spark.createDataFrame([("http://pub.org/",), ("http://8.8.8.8/",), ("http://pub.org/end",), ("http://pub.org/loop",)], "url string")
    found = {r.start: (r.url, r.hop, r.fault) for r in followed(starts, redirects, dns).collect()}
    assert found == {
        "http://pub.org/": ("http://127.0.0.1/", 2, "blocked_address"),
        "http://8.8.8.8/": ("http://8.8.8.8/", 0, "no_destination"),
        "http://pub.org/end": ("http://pub.org/end", 0, None),
        "http://pub.org/loop": ("http://pub.org/loop", 4, "too_many_redirects"),
    }
