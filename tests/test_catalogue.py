"""Every query against its SQL at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare  # noqa: E402
from seriesloom.catalogue import QUERIES  # noqa: E402

SLOW = ("boosted_forecast", "split_predictions", "forecast_scores")


@pytest.fixture(scope="session")
def connection(small):
    db = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, connection, small, name):
    verdict, _, rows = compare(spark, connection, small, name)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
