import random
import re

from pyspark.sql import functions as F

from quoteloom.constants import ABBREVIATIONS
from quoteloom.functions import html, text


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_fold_examples_and_map(spark):
    cases = {
        "Hello,  World!": "hello world",
        "Ünïcode ﬁx ½ é": "unicode fix 1 2 e",
        "it’s it's\n\tIT'S": "it s it s it s",
        "...!": "",
        "": "",
        "😀a𝐀b": "a b",
        "ß İ K": "i k",
        "３．１": "3 1",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for r in df.withColumn("f", text.fold(F.col("t"))).withColumn("m", text.fold_with_map("t")).collect():
        assert r.f == r.want == r.m.text == text.fold_map(r.t)[0]
        assert len(r.m.map) == len(r.m.text)


def test_native_fold_equals_the_scan(spark):
    rng = random.Random(0)
    alphabet = "aB1 .,'é́ßﬁ½Å№㎏中あ😀\n-_"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))),) for _ in range(400)]
    for r in spark.createDataFrame(rows, "t string").withColumn("f", text.fold(F.col("t"))).collect():
        assert r.f == text.fold_map(r.t)[0], r.t


def test_projection_round_trip():
    raw = "The  «Éclair» cost\n3.50, no more."
    folded, places = text.fold_map(raw)
    needle = "eclair cost 3 50"
    at = folded.index(needle)
    start, end = text.project(places, at, at + len(needle))
    assert raw[start:end] == "Éclair» cost\n3.50"
    assert text.project(places, 3, 3) is None and text.project(places, -1, 2) is None and text.project(places, 0, 999) is None


def scan(raw):
    """Sentences by scanning for ends from left to right."""
    closing = "\"'’”)]"
    out, cursor, i = [], 0, 0
    blank = "\t\n\x0b\f\r \xa0"

    def push(a, z):
        piece = raw[a:z]
        bare = piece.strip(blank)
        if bare:
            s = a + len(piece) - len(piece.lstrip(blank))
            out.append((bare, s, s + len(bare)))

    while i < len(raw):
        if re.match(r"\n[ \t]*\r?\n", raw[i:]):
            push(cursor, i)
            cursor = i + 1
        elif raw[i] in ".!?":
            word = re.search(r"[A-Za-z]*$", raw[:i])[0]
            false = raw[i] == "." and (len(word) == 1 or word.lower() in ABBREVIATIONS)
            end = i + 1
            while end < len(raw) and raw[end] in ".!?" + closing:
                end += 1
            if not false and (end == len(raw) or raw[end] in blank):
                push(cursor, end)
                cursor, i = end, end - 1
        i += 1
    push(cursor, len(raw))
    return out


def test_sentences_equal_the_scan(spark):
    rng = random.Random(1)
    parts = ["Dr.", "A.", "no.", "Yes!", "Why?", '."', "!)", " ", " ", "\n", "\n \n", "3.5", "éa.", "word", ".", "..", "’", "etc.", "x"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))),) for _ in range(600)]
    for r in spark.createDataFrame(rows, "t string").withColumn("s", text.sentences(F.col("t"))).collect():
        assert [(s.text, s.start, s.end) for s in r.s] == scan(r.t), repr(r.t)


def test_sentences_of_tables_equal_those_of_a_column(spark):
    """sentences were put one by one behind a copy of all before, in the square of a text's sentences."""
    rng = random.Random(2)
    parts = ["Dr.", "A.", "approx.", "xapprox.", "ſ.", "Yes!", '."', ")", " ", "\n", "\r\n", "\n \n", "3.5", "éa.", "😀", "..", "　", "x"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))),) for _ in range(600)] + [("a\1b.\1c",), ("." * 200_000 + "x",), ("One. " * 100_000,), (None,)]
    df = spark.createDataFrame(rows, "t string")
    short = df.where("t is null or length(t) < 1000").select(text.sentences_of(F.col("t")).alias("a"), text.sentences(F.col("t")).alias("b"))
    assert short.where("a <=> b").count() == short.count() == 602
    assert sorted(r.n or -1 for r in df.where("t is null or length(t) > 1000").select(F.size(text.sentences_of(F.col("t"))).alias("n")).collect()) == [-1, 1, 100_000]


def test_sentence_examples(spark):
    cases = {
        "One. Two! Three?": ["One.", "Two!", "Three?"],
        "It was 3.5 km. Then more.": ["It was 3.5 km.", "Then more."],
        "Dr. J. Smith spoke. He left.": ["Dr. J. Smith spoke.", "He left."],
        'He said "Go." She went.': ['He said "Go."', "She went."],
        "Heading\n\nBody text": ["Heading", "Body text"],
        "   ": [],
        "No end": ["No end"],
    }
    for raw, want in cases.items():
        assert [s.text for s in one(spark, raw, text.sentences(F.col("t")).alias("s")).s] == want


def test_tokens_and_estimates(spark):
    assert one(spark, "The cat is not at all on a cat", text.tokens(text.fold(F.col("t"))).alias("x")).x == ["cat", "not", "all", "cat"]
    assert [one(spark, "a" * n, text.estimate_tokens(F.col("t")).alias("x")).x for n in (0, 1, 36, 37)] == [0, 1, 10, 11]


def test_entities(spark):
    raw = "&amp;lt; &#38;lt; &#x41;&#X42; &#67; &copy; &HELLIP; &#1114112; &#xD800; &#0065; &#x; &nbsp;|&#;"
    assert one(spark, raw, html.decode_entities(F.col("t")).alias("x")).x == "&lt; < AB C &copy; …   A &#x;  |&#;"


def test_html(spark):
    prose = "<p>First &amp; second.</p><p>Third<br>line &mdash; end.</p>"
    page = f"<html><head><title> A &amp;\n B </title></head><body><nav><a>x</a></nav><script>var a='<p>';</script>{prose}<!-- no --><footer>f</footer></body></html>"
    row = one(spark, page, html.html_to_text(F.col("t")).alias("x"), html.title(F.col("t")).alias("title"))
    assert row.x == "First & second.\n\nThird\nline — end." and row.title == "A & B"
    long = "<main>" + "word " * 200 + "</main>"
    assert "menu" not in one(spark, "<body>menu" + long + "</body>", html.html_to_text(F.col("t")).alias("x")).x
    assert "menu" in one(spark, "<body>menu<main>short</main></body>", html.html_to_text(F.col("t")).alias("x")).x
    assert one(spark, "<p>none</p>", html.title(F.col("t")).alias("x")).x is None
    assert one(spark, "# raw <b>\r\n ", html.body_to_text(F.col("t"), F.lit("text/markdown")).alias("x")).x == "# raw <b>"


def test_link_runs(spark):
    run = "Home\n\nAbout us\n\nNews\n\nContact\n\nLogin\n\n"
    assert one(spark, run + "A real sentence stands here.", html.drop_link_runs(F.col("t")).alias("x")).x == "A real sentence stands here."
    assert one(spark, "Home\n\nNews\n\nText follows here, see.", html.drop_link_runs(F.col("t")).alias("x")).x == "Home\n\nNews\n\nText follows here, see."
    assert one(spark, "", html.drop_link_runs(F.col("t")).alias("x")).x == ""


def test_pieces_are_trimmed_and_texts_tested_once(spark):
    """a sentence took six passes of regular expressions, and folding tested every character against thirty ranges."""
    df = spark.createDataFrame([("　A b.  \n\n Ć ﬁ! ",)], "text string").select(text.sentences(F.col("text")).alias("s"), text.fold(F.col("text")).alias("f"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3 and plan.lower().count("rlike") == 1
    row = df.first()
    assert [(s.text, s.start, s.end) for s in row.s] == [("A b.", 1, 5), ("Ć ﬁ!", 10, 15)] and row.f == "a b c fi"


def test_entities_are_decoded_in_one_pass(spark):
    """each of fifteen names was a pass over the text, and each numeric reference was matched three times."""
    decoded = html.decode_entities(F.col("t"))
    df = spark.createDataFrame([("&amp;lt; &LT;&#X41;&#x110000;&#0065;&#000;&bogus; &#x; &amp;amp;#65;",)], "t string").select(decoded.alias("d"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" not in plan and "regexp_extract(" not in plan
    assert df.first().d == "&lt; <AA\0&bogus; &#x; &amp;#65;"


def test_blocks_are_looked_at_once(spark):
    """what was kept was copied for each block, and a block matched four times."""
    dropped = html.drop_link_runs(F.col("t"))
    df = spark.createDataFrame([("Home\n\nAbout\n\nShop\n\nHelp\n\nA text.\n\nOne\n\nTwo\n\nThree\n\nEnd.",)], "t string").select(dropped.alias("d"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.lower().count("rlike") == 1
    assert df.first().d == "A text.\n\nOne\n\nTwo\n\nThree\n\nEnd."


def test_words_within_tasks_equal_the_column(spark):
    """folding and tokens by column expressions were the main cost of an index and of looking for quotes."""
    every = "".join(chr(c) + ("ab" if c % 3 else " ") for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF)
    rows = [(every[i : i + 70],) for i in range(0, len(every), 70)] + [("The cat 😀 is\0not ﬁne, É x",), ("",), (None,)]
    x = F.col("t")
    words = F.udf(lambda t: None if t is None else b" ".join(text.fold_words(t)).decode(), "string")
    df = spark.createDataFrame(rows, "t string").repartition(4)
    told = df.select(text.fold(x).alias("a"), words(x).alias("b"), text.tokens(text.fold(x)).alias("c"), text.terms_of(x).alias("d"))
    assert told.where("a <=> b and c <=> d").count() == len(rows)
    assert text.fold_words("The cat ﬁne, É½x") == [b"the", b"cat", b"fine", b"e1", b"2x"]
