"""The driver contract on the smallest tables."""

import pathlib

import pytest

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")


def test_entry(spark):
    assert E.entry(spark).count() == 3


def test_every_statement_belongs_to_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 130


@pytest.mark.parametrize("name", ["mobility_summary", "contract_report", "clean_quarantine", "zone_join_lowest", "daily_facts", "linear_trend", "analogue_summary",
                                  "scenario_quantiles", "forecast_metrics", "published_facts", "replay_twice"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES, rows_of
    duck = duckdb.connect()
    for t in TABLES.split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = E.queries()[name](spark, FOLDER)
    rel = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())
