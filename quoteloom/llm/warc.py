"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each a gzip member of its own, in files
of bounded size; a payload seen elsewhere is a revisit.  The index holds a line
for each capture under its reversed-host URL key, sorted and range-partitioned
into shard files.  A shard is gzip blocks of some thousand lines and, at its
end, a sparse directory: the first key of each block and where it lies.  A
look-up finds the shard by its first key (one row for each shard), searches its
directory by bisection, reads that block alone, and gives file, offset and
length, with which one record is read from the archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, fresh, join_one, open_input, open_output, partitions, pick, small_batches, written

LEAST_SHARED = 1000
BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
_DEFAULT_PORT = {"http": 80, "https": 443}


def surt(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; scheme, default port and fragment are left out.

    What isn't a URL with a host is its own key; null is the empty key.
    """
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return quote(url, safe="/:?&=%#@!$'()*+,;~")
    key = ",".join(reversed(host.split(".")))
    if port and port != _DEFAULT_PORT.get(parts.scheme):
        key += f":{port}"
    return quote(f"{key}){parts.path or '/'}{'?' + parts.query if parts.query else ''}", safe="/:?&=%@!$'()*+,;~")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Key of one capture: the URL's key and, where other indexes have a time, the page's id in sortable digits."""
    return f"{surt(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def _urn(page_id: int | None) -> str:
    return f"<{_URN}{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit of ``refers_to`` without."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="/:?&=%#@!$'()*+,;~[]")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _id_of(urn: str) -> int | None:
    value = urn.strip("<>").removeprefix(_URN)
    return None if value == "null" else int(value)


def parse(raw: bytes) -> dict:
    """A record's page_id, url, payload (None for a revisit), size and digest of its full payload, type, refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    return {
        "page_id": _id_of(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _id_of(fields["warc-refers-to"]) if revisit else None,
    }


def write_archives(pages: DataFrame, folder: str, id_col: str, url_col: str, html_col: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages; a table (key, path, at, size) of their captures.

    Of payloads that are equal and of at least LEAST_SHARED bytes, those of the
    largest page id are responses and the others revisit it.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    plain = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    plain = plain.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long_enough = F.octet_length("html") >= LEAST_SHARED
    narrow = written(plain.where(long_enough).select("page_id", "digest"), "digests")
    shared = narrow.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1"), "shared-payloads")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # only ids and digests meet the shared payloads, however common one is; pages then meet marks of their own
    marks = join_one(narrow, shared, "digest", "n", total).where(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct()
    marks = written(marks.select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("first_id").alias("refers_to")), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    rows = plain.join(marks, same, "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, out, at, serial = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", None, 0, 0
        for batch in batches:
            found = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    path = f"{stem}-{serial:04d}.warc.gz"
                    out, at, serial = open_output(path), 0, serial + 1
                member = gzip.compress(record(page_id, url, payload, digest, refers_to), 4, mtime=0)
                out.write(member)
                found.append((capture_key(url, page_id), path, at, len(member)))
                at += len(member)
            key, paths, ats, sizes = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(paths, pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], ["key", "path", "at", "size"])
        if out:
            out.close()

    captures = written(rows.mapInArrow(run, "key string, path string, at long, size long"), "captures")
    for table in (narrow, shared, marks):
        drop(table, spark)
    return captures


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, int, int]]:
    """Write the index's shards; (first key, path, where the directory lies, its size) of each, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path, out, at, directory, lines = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.idx", None, 0, [], []

        def flush() -> None:
            nonlocal out, at
            out = out or open_output(path)
            block = zlib.compress("\n".join(lines).encode())
            out.write(block)
            directory.append((lines[0].split("\t", 1)[0], at, len(block)))
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append("\t".join(map(str, row)))
                if len(lines) >= block_lines:
                    flush()
        if lines:
            flush()
        if out:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail)
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "path": [path], "at": [at], "size": [len(tail)]})

    n = partitions(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "key", "path", "at").sortWithinPartitions("key", "path", "at")
    shards = written(ordered.mapInArrow(run, "first string, path string, at long, size long"), "index-shards")
    return sorted((r["first"], r.path, r["at"], r["size"]) for r in shards.collect())  # a row for each shard


class Index:
    """Look-ups by key; holds the directory and the block used last."""

    def __init__(self, shards: list[tuple[str, str, int, int]]):
        self.shards, self.first = shards, [s[0] for s in shards]
        self._directory: tuple[int, list[tuple[str, int, int]], list[str]] | None = None
        self._block: tuple[tuple[int, int], list[str]] | None = None

    def directory(self, shard: int) -> tuple[list[tuple[str, int, int]], list[str]]:
        if not self._directory or self._directory[0] != shard:
            _, path, at, size = self.shards[shard]
            with open_input(path) as source:
                rows = json.loads(zlib.decompress(source.read_at(size, at)))
            self._directory = shard, rows, [r[0] for r in rows]
        return self._directory[1:]

    def block(self, shard: int, which: int) -> list[str]:
        if not self._block or self._block[0] != (shard, which):
            _, at, size = self.directory(shard)[0][which]
            with open_input(self.shards[shard][1]) as source:
                lines = zlib.decompress(source.read_at(size, at)).decode().split("\n")
            self._block = (shard, which), lines
        return self._block[1]

    def scan(self, start: str, stop: str) -> Iterator[tuple[str, str, int, int]]:
        """Captures with start <= key < stop, in order: key, path, offset, size."""
        shard = max(0, bisect_left(self.first, start) - 1)
        while shard < len(self.shards) and self.first[shard] < stop:
            blocks, firsts = self.directory(shard)
            which = max(0, bisect_left(firsts, start) - 1)
            while which < len(blocks) and firsts[which] < stop:
                lines = self.block(shard, which)
                for line in lines[bisect_left(lines, start) : bisect_left(lines, stop)]:
                    key, path, at, size = line.split("\t")
                    yield key, path, int(at), int(size)
                which += 1
            shard += 1

    def captures(self, url: str | None) -> list[tuple[str, str, int, int]]:
        """All captures of a URL."""
        key = surt(url)
        return list(self.scan(f"{key} ", f"{key}!"))


def look_up(wanted: DataFrame, shards: list[tuple[str, str, int, int]]) -> DataFrame:
    """(path, at, size) of the captures of each distinct ``key`` wanted; keys are searched in order, a range of them a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shards)
        for batch in batches:
            found = [c for key in batch.column(0).to_pylist() for c in index.scan(key, key + "\n")]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in found], pa.string() if i == 1 else pa.int64()) for i in (1, 2, 3)], ["path", "at", "size"])

    n = partitions(wanted.sparkSession)
    ordered = wanted.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    return written(ordered.mapInArrow(run, "path string, at long, size long"), "places")  # read twice by the next range partitioning


def read_records(places: DataFrame, payloads: bool = False) -> DataFrame:
    """Records at (path, at, size), read by ranges in the order they lie in."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    kinds |= {"payload": pa.binary()} if payloads else {}
    schema = ", ".join(f"{k} {'long' if v == pa.int64() else 'binary' if v == pa.binary() else 'string'}" for k, v in kinds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            found = []
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if path != opened:
                    source, opened = open_input(path), path
                found.append(parse(gzip.decompress(source.read_at(size, at))))
            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in found], t) for k, t in kinds.items()})

    n = partitions(places.sparkSession)
    ordered = places.select("path", "at", "size").repartitionByRange(n, "path", "at").sortWithinPartitions("path", "at")
    return ordered.mapInArrow(run, schema)


def archive_round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Write all pages, index their captures, look every page up by key and read its record.

    A row for each page: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to.  Null html is the empty payload; a null url has the
    empty key.  Rows repeated with their id are a capture each; where such rows
    share the largest id of a payload, all of them are responses.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or fresh(spark, "warc")
    captures = write_archives(pages, folder, id_col, url_col, html_col)
    shards = build_index(captures, f"{folder}/index", block_lines)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [capture_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["key"])

    plain = pick(pages, id_col, url_col).toDF("page_id", "url")
    wanted = plain.withColumn("page_id", plain.page_id.cast("long")).mapInArrow(keys, "key string")
    return read_records(look_up(wanted, shards))
