import duckdb
import pytest

from ..conftest import SF


@pytest.fixture(scope="session")
def duck():
    """The tables of the smallest size, for registered SQL."""
    db = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "pages", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db
