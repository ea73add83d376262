"""Registered queries against their SQL. All of them with BRISA_ALL=1, else the quick ones."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from brisa.plans.registry import COVERS
from tools.check import TABLES, key, plain

SF = "/root/testdata/sf0.001"
QUICK = ("daily_generation", "short_gaps_filled", "national_rollup_by_day", "checked_outer_join", "code_links", "rule_report",
         "kaplan_meier_curves", "spearman_correlation", "feature_table", "name_keys", "stable_unit_ids", "classes_oversampled")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries()) and set(COVERS) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("BRISA_ALL") else QUICK)
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = duck.execute(oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=key)
    assert got == want
