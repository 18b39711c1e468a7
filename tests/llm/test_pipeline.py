import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from frames import messy_rows

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline  # noqa: E402
from compare import compare  # noqa: E402
from seriesloom.llm.catalogue import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def connection(small):
    db = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_query(spark, connection, small, name):
    verdict, _, rows = compare(spark, connection, small, name)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


def test_stages_on_messy_rows(spark, messy, nothing, small):
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert stage(spark, nothing, small).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, small).count() >= docs.count()
    assert last(spark, nothing, small).count() == 0


def test_decisions_of_stages(spark, messy, small):
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact dedup"](spark, messy, small).collect()
    texts = Counter(" ".join((r["text"] or "").split()) for r in exact)
    assert len(exact) < len(messy_rows()) and texts["short"] == 1
    near = {r["doc_id"] for r in stages["n-gram Jaccard join"](spark, spark.createDataFrame(exact, messy.schema), small).collect()}
    assert 1 in near and 3 in {r[0] for r in messy_rows()} and {r["doc_id"] for r in exact} >= near
