"""Streams against folds in plain Python, over restarts, late and repeated rows, and batches that run again."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from fathom.plans.streams import state_store
from fathom.streaming import counts, retries

DAY0 = datetime.datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, event_id long, outcome string"


def day(x):
    return DAY0 + datetime.timedelta(days=x)


def fold(rows, until=None):
    """What happens to each key, outcome by outcome."""
    told = []
    for key in {r[0] for r in rows if r[0] is not None}:
        failures, tried = 0, None

        def ring(before):
            nonlocal tried
            if tried and (before is None or tried[0] < before) and (until is None or tried[0] <= until):
                told.append((key, tried[0], tried[1], failures, "due", None))
                tried = None

        for at, event_id, outcome in sorted({r[1:] for r in rows if r[0] == key and r[3] in ("short", "good") and r[1] is not None and (until is None or r[1] <= until)}):
            ring(at)
            failures, tried = (0, None) if outcome == "good" else (failures + 1, None)
            if 0 < failures <= 5:
                tried = (at + datetime.timedelta(days=[7, 14, 30, 60, 90][failures - 1]), event_id)
            told.append((key, at, event_id, failures, "done" if outcome == "good" else "waiting" if tried else "given_up", tried and tried[0]))
        ring(None)
    return sorted(told, key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.select("key", "at", "event_id", "failures", "state", "next_at").collect()), key=repr)


def some(seed, n, keys=6, span=400):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(keys)}", day(rng.randrange(span * 4) / 4), i, rng.choices(["short", "good", None, "other"], (8, 1, 1, 1))[0]) for i in range(n)]
    return rows + [rows[0], rows[1]]


def test_history_is_the_fold(spark):
    rows = some(1, 150) + [("run", day(i), 900 + i, "short") for i in range(8)] + [("tie", day(7), 801, "short"), ("tie", day(0), 800, "short"), (None, day(0), 1, "short"), ("null", None, 2, "short")]
    got = listed(retries.history(spark.createDataFrame(rows, SCHEMA)))
    assert got == fold(rows)
    assert {r[4] for r in got if r[0] == "run"} == {"waiting", "given_up"} and ("tie", day(7), 800, 1, "due", None) not in got
    assert retries.history(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture()
def stream(spark, tmp_path):
    class Stream:
        def __init__(self):
            self.files, self.n = str(tmp_path / "in"), 0
            os.makedirs(self.files)

        def add(self, rows):
            self.n += 1
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.files}/{self.n}")

        def run(self):
            with state_store(spark):
                source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.files)
                told = retries.history_stream(source, "10 days")
                retries.run_available(told, str(tmp_path / "told"), str(tmp_path / "checkpoint"))
            return listed(retries.told(spark, str(tmp_path / "told"), told.schema))

    return Stream()


def test_stream_is_the_batch_after_restarts(stream, tmp_path):
    """Rows come in any order within the delay, over three runs of one checkpoint; a row behind the watermark is left out."""
    rows = sorted(some(2, 120), key=lambda r: r[1])
    parts = [rows[:50], rows[50:90], rows[90:]]
    seen = []
    for i, part in enumerate(parts):
        shuffled = random.Random(i).sample(part, len(part))
        stream.add(shuffled)
        if i == 2:  # far behind what two runs have passed
            stream.add([("k0", day(0), 5_000, "good"), ("k1", day(1), 5_001, "short")])
        got, seen = stream.run(), seen + part
        until = max(r[1] for r in seen if r[3] in ("short", "good")) - datetime.timedelta(days=10)
        assert got == fold(seen, until)
    # the last batch ends without its commit, so it runs again: nothing is told twice
    commits = str(tmp_path / "checkpoint" / "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    assert stream.run() == got


def test_keys_of_one_group_stay_apart(stream, monkeypatch):
    """All keys in one group, over two runs; outcomes of one event and time both count, and an event may have no number."""
    monkeypatch.setattr(retries, "GROUPS", 1)
    rows = sorted(some(7, 150, keys=40, span=60), key=lambda r: r[1]) + [("both", day(58), 900, "short"), ("both", day(58), 900, "good"), ("last", day(200), 901, "short")]
    stream.add(rows[:80])
    stream.run()
    stream.add(rows[80:])
    assert stream.run() == fold(rows, day(190))
    stream.add([("none", day(195), None, "short"), ("none", day(196), 2**60 + 1, "short"), ("later", day(300), 902, "short")])
    assert {r[1:4] for r in stream.run() if r[0] == "none"} == {(day(195), None, 1), (day(196), 2**60 + 1, 2), (day(210), 2**60 + 1, 2)}


def test_nothing_is_told_before_the_watermark(stream):
    stream.add([("a", day(0), 1, "short"), ("a", day(5), 2, "good")])
    assert stream.run() == []
    stream.add([("b", day(12), 3, "short")])
    assert [r[4] for r in stream.run()] == ["waiting"]
    stream.add([("b", day(40), 4, "good")])
    assert stream.run() == fold([("a", day(0), 1, "short"), ("a", day(5), 2, "good"), ("b", day(12), 3, "short")])


def test_windows_as_a_stream(spark, tmp_path):
    rng = random.Random(4)
    schema = "ts timestamp, kind string, value double"
    events = [(day(rng.randrange(96) / 8), rng.choice("ab"), rng.randrange(1000) / 100) for _ in range(300)]
    events.sort(key=lambda e: e[0])
    for i, part in enumerate((events[:150], events[150:] + [(day(0), "a", 1.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        rows = counts.windowed(source, "kind", "ts", "value", delay="1 day", limit=10)
        retries.run_available(rows, str(tmp_path / "told"), str(tmp_path / "checkpoint"))
    got = retries.told(spark, str(tmp_path / "told"), rows.schema).collect()
    last = max(e[0] for e in events) - datetime.timedelta(days=1)
    want = {}
    for at, kind, value in events:
        begin = DAY0 + datetime.timedelta(days=(at - DAY0).days)
        if begin + datetime.timedelta(days=1) <= last:
            n, total = want.get((begin, kind), (0, 0))
            want[begin, kind] = (n + 1, total + round(value * 100))
    assert {(r.begin, r.kind): (r.n, r.hundredths) for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n > 10) for r in got)
