"""Driver contract: entry runs, every registered query has a name-matched oracle
where one is given, and a sample of queries equals DuckDB at sf0.001."""

import duckdb

import __spark_entry__ as E
from tests.conftest import SF
from tests.compare import compare, duck


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"project_id", "rank", "name", "score"}
    assert df.count() >= 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_sample_against_duckdb(spark):
    con = duck(SF)
    qs, osql = E.queries(), E.oracle_sql()
    for n in ["cobol_metrics", "cobol_top10", "ddl_columns", "pg_type_usage", "java_queries", "orm_queries",
              "pg_scores", "v_diff", "v_checksum", "v_load_order", "admission_report"]:
        r = compare(spark, con, n, qs[n], osql[n], SF)
        assert r["ok"], r
