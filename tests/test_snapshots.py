"""Versions of tables: replaced whole and by part, broken writes, damage, restored ones, backups."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from fathom.sources import snapshots as S


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/table"


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id int, kind string, tags array<string>, about map<string, int>")


def ids(df):
    return sorted(r.id for r in df.collect())


A, B, C = (1, "x", ["p"], {"k": 1}), (2, "y", [], None), (3, None, None, {})


def test_versions(spark, root):
    with pytest.raises(FileNotFoundError):
        S.read(spark, root)
    assert S.publish(rows(spark, A, B), root, "first")["rows"] == 2
    S.publish(rows(spark, A, A, C), root)
    assert ids(S.read(spark, root, verify=True)) == [1, 1, 3] and ids(S.read(spark, root, 1)) == [1, 2]
    m = S.restore(spark, root, 1)
    assert (m["number"], m["note"]) == (3, "version 1 again") and ids(S.read(spark, root)) == [1, 2]
    assert [v["number"] for v in S.versions(root)] == [1, 2, 3]
    S.publish(rows(spark).limit(0), root)
    assert S.read(spark, root, verify=True).count() == 0


def test_a_broken_write_changes_nothing(spark, root):
    S.publish(rows(spark, A, B), root)
    bad = rows(spark, A, B, C).withColumn("kind", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("kind")))
    with pytest.raises(Exception, match="no"):
        S.publish(bad, root)
    assert ids(S.read(spark, root, verify=True)) == [1, 2] and len(S.versions(root)) == 1


def test_one_number_has_one_writer(spark, root):
    m = S.publish(rows(spark, A), root)
    with pytest.raises(FileExistsError):
        S._name(root, m)


def test_parts(spark, root):
    S.publish(rows(spark, A, B, C), root, parts="kind")
    S.publish(rows(spark, (9, "y", None, None), (8, None, None, None), (7, "null", None, None)), root, parts="kind")
    assert ids(S.read(spark, root, verify=True)) == [1, 7, 8, 9] and ids(S.read(spark, root, 1, verify=True)) == [1, 2, 3]
    S.publish(rows(spark, (6, "x", None, None)), root, parts="kind", emptied=("y", "x", None))
    assert ids(S.read(spark, root, verify=True)) == [6, 7]


def test_damage_is_seen(spark, root, tmp_path):
    S.publish(rows(spark, A, B), root)
    S.publish(rows(spark, C), root)
    first = S.versions(root)[0]["paths"][""].removeprefix("file://")
    other = S.versions(root)[1]["paths"][""].removeprefix("file://")
    for f in glob.glob(f"{first}/*.parquet"):
        os.remove(f)
    for f in glob.glob(f"{other}/*.parquet"):
        os.link(f, f"{first}/{os.path.basename(f)}")
    with pytest.raises(S.Broken):
        S.restore(spark, root, 1)
    assert ids(S.read(spark, root, verify=True)) == [3]


def test_backup(spark, tmp_path):
    header = S.backup(rows(spark, A, B), f"file://{tmp_path}/b", "below the bar", "2024-01-01").first()
    assert (header.taken_at, header.reason, header["count"], header.columns) == ("2024-01-01", "below the bar", 2, "id,kind,tags,about")
    assert ids(spark.read.json(f"file://{tmp_path}/b/rows")) == [1, 2]
