import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from quaybook.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["ingest_summary", "order_remaining", "book_peaks", "final_snapshot", "analytics_rows", "prediction_summary", "future_move_labels"])
@pytest.mark.skipif(not Path(SF).exists(), reason="tables are not here")
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(oracle.oracle_sql()[name])
    got, expected = rows_of(df.columns, map(tuple, df.collect())), rows_of(want.columns, want.fetchall())
    assert sorted(df.columns) == sorted(want.columns)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.skipif(not Path(SF).exists(), reason="tables are not here")
def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 7500


def test_library_stands_without_the_text_operators():
    root = Path(contract.__file__).parent / "quaybook"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"quaybook\.llm", p.read_text()), p
