"""Every registered query against its SQL, at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 5) if isinstance(value, int | float) and not isinstance(value, bool) else value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    found = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert found.count() > 0
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_words_of_texts_that_fold_to_nothing_are_counted_as_in_sql(spark, tmp_path, ansi):
    texts = ["ß.", "ß ß", "", " \n", "--- !!!", "日本 😀", None, "Éaux.", "one  two"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    given = [(i, t, "de", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        found = sorted(tuple(r) for r in entry.queries()["fold_documents"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == sorted(db.execute(entry.oracle_sql()["fold_documents"]).fetchall())
    assert [r[2] for r in found] == [1, 1, 1, 1, 1, 1, None, 1, 2]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
