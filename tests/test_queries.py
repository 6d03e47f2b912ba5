"""Every registered query against its SQL on the smallest tables, and the stream against a batch."""

import os

import duckdb
import pytest

from fathom.plans import detections, evidence, gates, issues, lists, matching, pages, records, scalars, streams, tables, verdicts, worklists  # noqa: F401  they register their queries
from fathom.plans.catalog import QUERIES, SQL
from fathom.streaming.poll import freshness, new_rows, process_available

DATA = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted((tuple(str(v) for v in r.values()) for r in frame), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    if name not in SQL:
        assert got.count() >= 0
        return
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    cursor = db.execute(SQL[name])
    want = [dict(zip([c[0] for c in cursor.description], r)) for r in cursor.fetchall()]
    pick = lambda rows: rows_of([{c: r[c] for c in sorted(got.columns)} for r in rows])
    assert pick(r.asDict() for r in got.collect()) == pick(want)


def test_stream_is_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-01-02 00:00:00")], "id long, at string").selectExpr("id", "CAST(at AS timestamp) AS at")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    known = lambda: spark.createDataFrame([(2,)], "id long")
    stream = new_rows(spark, str(tmp_path / "in"), rows.schema, "id", "at")
    process_available(stream, known, "id", lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "check"))
    assert sorted(seen) == [1, 3]


def test_freshness(spark):
    rows = spark.createDataFrame([("2024-01-10",)], "at string").selectExpr("CAST(at AS timestamp) AS at")
    assert freshness(rows, "at", "2024-01-20").first()["fresh"] is True
    assert freshness(rows, "at", "2024-03-20").first()["fresh"] is False
    assert freshness(rows.limit(0), "at", "2024-03-20").first()["fresh"] is False
