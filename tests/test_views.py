"""Derived tables are the same rows in Spark and in DuckDB."""

import os

import duckdb
import pytest

from fathom.sources.views import RECIPES, table, with_views

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(RECIPES))
def test_recipe(spark, name):
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    cursor = db.execute(with_views(f"SELECT * FROM {name}", name))
    columns = [c[0] for c in cursor.description]
    got = table(spark, DATA, name)
    assert got.columns == columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, cursor.fetchall()))
