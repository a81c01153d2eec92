"""Awkward tables that every operator must take, and plain rewrites of contracts."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Extra columns whose names clash with ones used inside operators.
CLASHES = ["digest", "fp", "slice", "block", "u", "v", "key", "path", "gone_id", "gone_text", "bare_text", "score", "kept", "ids"]


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang), with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


LONG = "alpha beta gamma delta epsilon zeta eta theta. " * 4000

AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, LONG),
    (6, LONG),
    (7, "Ünïcödé — ünd «quotes» 中文  nbsp 😀 end."),
    (8, "one two three four five six seven eight nine ten eleven twelve"),
    (8, "one two three four five six seven eight nine ten eleven twelve"),
    (9, "ONE  two three four five six seven eight nine ten eleven twelve"),
    (10, "1234 5678 !!"),
    (11, "o n e"),
    (None, "one"),
]
