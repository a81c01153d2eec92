"""Where documents come from, and what is let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import (
    CONCURRENCY_MOST, MAX_BODY_BYTES, MAX_CORPUS_CHARS, MAX_DOC_CHARS, MAX_DOCS, MAX_QUESTION, MAX_QUESTIONS, MAX_REDIRECTS, MAX_TITLE_CHARS,
    MAX_TOP_K, MAX_URL_CHARS, MAX_WINDOW_TOKENS, MIN_QUESTION, WINDOW_TOKENS_LEAST,
)
from ..functions.html import body_to_text, content_type_allowed, title
from ..functions.text import js_trim
from ..functions.url import is_blocked_address, resolve_url, url_fault, url_place
from ..operators.chunks import running_sum
from .tables import saved


def pasted(texts: DataFrame) -> DataFrame:
    """Documents of pasted texts (position, text): trimmed; blank and oversized ones are refused with a fault."""
    bare = js_trim(F.col("text"))
    fault = F.when(bare == "", "blank").when(F.length(bare) > MAX_DOC_CHARS, "doc_too_large")
    titled = F.concat(F.lit("Pasted text "), (F.col("position") + 1).cast("string"))
    return texts.select("position", titled.alias("title"), F.lit("paste").alias("origin"), bare.alias("text"), fault.alias("fault"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of text and markdown files in a folder: one a file, cut to the limit, oversized and blank ones with a fault.

    Sizes come from the listing: of an oversized file nothing is read.  Bytes
    that are no UTF-8 become replacement characters.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,markdown}").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= MAX_BODY_BYTES  # a filter of the listing
    text = F.make_valid_utf8(F.col("content").cast("string"))
    read = listed.where(fits).select("path", text.alias("text"), F.when(js_trim(text) == "", "blank").alias("fault"))
    skipped = listed.where(~fits).select("path", F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("fault"))
    return read.unionByName(skipped).select(
        F.col("path").alias("doc_id"),
        F.element_at(F.split("path", "/"), -1).alias("title"),
        F.lit("file").alias("origin"),
        F.substring("text", 1, MAX_DOC_CHARS).alias("text"),
        "fault",
    )


def fetched(replies: DataFrame) -> DataFrame:
    """Documents of fetched pages (url, status, content_type, body): text, title and fault.

    Faults in order: http_status, content_type, too_large, no_text.  ``truncated``
    says that the body was longer than a document may be.
    """
    text = F.substring(body_to_text(F.col("body"), F.col("content_type")), 1, MAX_DOC_CHARS)
    read = replies.withColumn("text", text).withColumn("place", url_place("url"))
    fault = (
        F.when(~F.col("status").between(200, 299), "http_status")
        .when(~content_type_allowed(F.col("content_type")), "content_type")
        .when(F.length("body") > MAX_BODY_BYTES, "too_large")
        .when(js_trim(F.col("text")) == "", "no_text")
    )
    named = F.coalesce(title(F.col("body")), F.concat("place.host", "place.path"))
    return read.select("url", named.alias("title"), F.lit("url").alias("origin"), "text", (F.length("body") > MAX_DOC_CHARS).alias("truncated"), fault.alias("fault"))


def guarded(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """URLs with a fault: as written, or because of what their host resolves to.

    ``dns`` has (host, address); a host with no address is unresolved, and one
    blocked address among several is enough.
    """
    judged = urls.withColumn("_fault", url_fault("url")).withColumn("_host", url_place("url")["host"])
    answers = dns.select("host", is_blocked_address("address").alias("blocked")).groupBy("host").agg(F.bool_or("blocked").alias("blocked"))
    joined = judged.join(answers, F.col("_host") == answers["host"], "left")
    literal = F.col("_host").rlike(r"^(\d+\.){3}\d+$|^\[")
    resolved = F.when(literal, None).when(F.col("blocked").isNull(), "unresolved").when(F.col("blocked"), "private_address")
    return joined.select(*urls.columns, F.coalesce(F.nullif("_fault", F.lit("")), resolved).alias("fault"))


def followed(starts: DataFrame, redirects: DataFrame, dns: DataFrame, hops: int = MAX_REDIRECTS) -> DataFrame:
    """(start, url, hop, fault): where each start (column url) ends after its redirects (url, location), every hop guarded.

    A null location is a redirect without destination.  A hop is written before
    the next one, so that each is worked out once, and reads only those still on
    their way; it ends when none is.
    """
    now = starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("hop"))
    table = redirects.select(F.col("url").alias("_from"), "location")
    ended = []
    for hop in range(hops + 1):
        moved = saved(guarded(now, dns).join(table, F.col("url") == F.col("_from"), "left"), "hop")
        goes_on = F.col("fault").isNull() & F.col("location").isNotNull()
        lost = F.when(F.col("_from").isNotNull(), F.when(F.col("location").isNull(), "no_destination").when(F.lit(hop == hops), "too_many_redirects"))
        stays = moved.where(F.lit(hop == hops) | ~goes_on)
        ended.append(stays.select("start", "url", "hop", F.coalesce("fault", lost).alias("fault")))
        now = moved.where(goes_on).select("start", resolve_url("location", "url").alias("url"), F.lit(hop + 1).alias("hop"))
        if hop == hops or now.isEmpty():
            break
    found = ended[0]
    for part in ended[1:]:
        found = found.unionByName(part)
    return found


def from_urls(urls: DataFrame, replies: DataFrame, dns: DataFrame, hops: int = MAX_REDIRECTS) -> DataFrame:
    """Documents of URLs (column url), from recorded replies (url, status, location, content_type, declared, body): guard, redirects, checks and text.

    A row for each URL: url, target, hop, title, origin, text, truncated, fault.
    Redirects are the replies of status 3xx, every hop of which is guarded; what
    no reply is recorded of is ``unreachable``.  ``declared`` is the size that a
    reply announces, or null.  A page that several URLs lead to is read once.
    """
    is_redirect = F.col("status").between(300, 399)
    ends = saved(followed(urls.distinct(), replies.where(is_redirect).select("url", "location"), dns, hops), "ends")
    wanted = ends.where("fault is null").select("url").distinct()
    pages = replies.where(~is_redirect).join(wanted, "url", "left_semi")
    large = pages.where(F.col("declared") > MAX_BODY_BYTES).select("url")
    read = fetched(pages).withColumnsRenamed({"url": "_page", "fault": "_fault"})
    read = read.join(large.select(F.col("url").alias("_large")).distinct(), F.col("_page") == F.col("_large"), "left")
    # what is declared is known before the body is read, but after status and type
    early = F.col("_fault").isin("http_status", "content_type")
    read = read.withColumn("_fault", F.when(early | F.col("_large").isNull(), F.col("_fault")).otherwise("too_large"))
    joined = ends.join(read, F.col("fault").isNull() & (F.col("url") == F.col("_page")), "left")
    fault = F.coalesce("fault", F.when(F.col("_page").isNull(), "unreachable"), "_fault")
    kept = fault.isNull()
    return joined.select(
        F.col("start").alias("url"),
        F.col("url").alias("target"),
        "hop",
        *[F.when(kept, F.col(c)).alias(c) for c in ("title", "origin", "text", "truncated")],
        fault.alias("fault"),
    )


def admitted(docs: DataFrame, order: str = "doc_order", most_doc: int = MAX_DOC_CHARS, most_corpus: int = MAX_CORPUS_CHARS) -> DataFrame:
    """Of each document all but its text, with chars_before and a fault: too long alone, or too long with all before it.

    Lengths are taken where documents lie; what is summed and joined has no text.
    """
    sizes = docs.withColumn("_chars", F.length("text").cast("long")).drop("text")
    sized = running_sum(sizes, order, "_chars", "chars_before")
    fault = F.when(F.col("_chars") > most_doc, "doc_too_large").when(F.col("_chars") + F.col("chars_before") > most_corpus, "corpus_too_large")
    return sized.withColumn("fault", fault).drop("_chars")


#: Documents let in whose order is broadcast; blank ones count towards no limit, so there may be more.
MOST_SENT = 1_000_000


def let_in(docs: DataFrame, order: str = "doc_order", most_doc: int = MAX_DOC_CHARS, most_corpus: int = MAX_CORPUS_CHARS) -> DataFrame:
    """The documents without fault, whole: what they have in all fits the corpus, so their order is sent to where documents lie."""
    fit = saved(admitted(docs, order, most_doc, most_corpus).where("fault is null").select(order), "let-in")
    return docs.join(F.broadcast(fit) if fit.count() <= MOST_SENT else fit, order, "left_semi")


def body_fault(body: Column) -> Column:
    """Why a raw body is refused, or null."""
    return F.when(F.octet_length(body) > MAX_BODY_BYTES, "body_too_large")


def request_faults(requests: DataFrame) -> DataFrame:
    """Requests with violations (array, in order) and fault, the first of them.

    Columns: request_id, docs array<struct<id,title,origin,text,url>>, questions
    array<string>, concurrency, tokens_per_window, top_k; null limits are unset.
    """

    def doc(d: Column, i: Column) -> Column:
        def fault(name: str, bad: Column) -> Column:
            return F.when(bad, F.concat(F.lit("docs."), i.cast("string"), F.lit(f".{name}")))

        def unsized(c: Column, least: int, most: int) -> Column:
            return c.isNull() | ~F.length(c).between(least, most)

        return F.array(
            fault("id", unsized(d["id"], 1, 64)),
            fault("title", unsized(d["title"], 1, MAX_TITLE_CHARS)),
            fault("origin", d["origin"].isNull() | ~d["origin"].isin("paste", "file", "url")),
            fault("text", unsized(d["text"], 0, MAX_DOC_CHARS)),
            fault("url", F.coalesce(F.length(d["url"]) > MAX_URL_CHARS, F.lit(False))),
        )

    def question(q: Column, i: Column) -> Column:
        return F.when(q.isNull() | ~F.length(js_trim(q)).between(MIN_QUESTION, MAX_QUESTION), F.concat(F.lit("questions."), i.cast("string")))

    def limit(name: str, least: int, most: int) -> Column:
        return F.when(F.coalesce(~F.col(name).between(least, most), F.lit(False)), name)

    def count(name: str, most: int) -> Column:
        return F.when(F.col(name).isNull() | ~F.size(name).between(1, most), name)

    shape = F.concat(
        F.array(count("docs", MAX_DOCS)),
        F.flatten(F.transform("docs", doc)),
        F.array(count("questions", MAX_QUESTIONS)),
        F.transform("questions", question),
        F.array(limit("concurrency", 1, CONCURRENCY_MOST), limit("tokens_per_window", WINDOW_TOKENS_LEAST, MAX_WINDOW_TOKENS), limit("top_k", 1, MAX_TOP_K)),
    )
    shape = F.array_compact(F.coalesce(shape, F.array(count("docs", MAX_DOCS), count("questions", MAX_QUESTIONS))))
    total = F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + F.length(d["text"]))
    whole = F.array_compact(F.array(F.when(total > MAX_CORPUS_CHARS, "corpus_too_large"), F.when(F.forall("docs", lambda d: js_trim(d["text"]) == ""), "all_blank")))
    found = requests.withColumn("violations", F.when(F.size(shape) > 0, shape).otherwise(whole))
    return found.withColumn("fault", F.try_element_at("violations", F.lit(1)))


def first_docs(docs: DataFrame, held: int = 0, most: int = MAX_DOCS) -> DataFrame:
    """The first documents that still fit a collection which holds some: a capacity of the feature, by doc_order."""
    place = F.row_number().over(Window.orderBy("doc_order"))
    return docs.orderBy("doc_order").limit(max(0, most - held)).withColumn("position", place)
