"""Retries of managers whose results fell short: a state and a timer for each key, as a stream and as one batch.

An outcome that falls short starts or continues a run of failures and sets the next try, later each time; after the
last try of the schedule the key is given up.  A good outcome ends the run.  When a try's time comes before another
outcome, it is due.  The stream holds outcomes back until the watermark has passed them, so order of arrival doesn't
matter and its history is the batch's up to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Days to the next try after each failure.
SCHEDULE = (7, 14, 30, 60, 90)
SHORT, GOOD = "short", "good"
_DAY = 86_400_000_000
#: Times inside the state are microseconds.
_OUT = "at long, event_id long, failures int, state string, next_at long"


def history(outcomes: DataFrame, until: DataFrame | None = None) -> DataFrame:
    """key, at, event_id, failures, state (waiting, given_up, done, due) and next_at: what happens to each key of outcomes (key, at, event_id, outcome).

    A row for each outcome and one for each try that comes due.  Outcomes count in the order of at, then event_id, those
    at the very time of a try before it; repeated rows count once, rows without key, time or a known outcome not at all.
    until (one row: millis) ends the history: only what happens up to that millisecond is told.
    """
    rows = outcomes.select("key", F.unix_micros("at").alias("at"), "event_id", "outcome").filter(F.col("outcome").isin(SHORT, GOOD) & F.col("key").isNotNull() & F.col("at").isNotNull()).distinct()
    if until is not None:
        # one row
        rows = rows.join(F.broadcast(until), F.floor(F.col("at") / 1000) <= F.col("millis"))
    else:
        rows = rows.withColumn("millis", F.lit(None).cast("long"))
    order = Window.partitionBy("key").orderBy("at", "event_id")
    rows = rows.withColumn("run", F.sum(F.when(F.col("outcome") == GOOD, 1).otherwise(0)).over(order)).withColumn("after", F.lead("at").over(order))
    failures = F.sum(F.when(F.col("outcome") == SHORT, 1).otherwise(0)).over(Window.partitionBy("key", "run").orderBy("at", "event_id")).cast("int")
    wait = F.try_element_at(F.array(*map(F.lit, SCHEDULE)), failures)
    rows = rows.withColumn("failures", failures).withColumn("next_at", F.when(F.col("outcome") == SHORT, F.col("at") + wait * _DAY))
    state = F.when(F.col("outcome") == GOOD, "done").when(F.col("next_at").isNotNull(), "waiting").otherwise("given_up")
    due = F.col("next_at").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("next_at"))) & (F.col("millis").isNull() | (F.floor(F.col("next_at") / 1000) <= F.col("millis")))
    told = rows.select("key", "at", "event_id", "failures", state.alias("state"), "next_at")
    tried = rows.filter(due).select("key", F.col("next_at").alias("at"), "event_id", "failures", F.lit("due").alias("state"), F.lit(None).cast("long").alias("next_at"))
    return _timed(told.unionByName(tried))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) for c in ("at", "next_at")})


#: Keys are kept together in so many groups, whose number must not change while a checkpoint is in use.  What a group
#: costs to call is then shared by its keys; a group holds what is open of a GROUPS-th of the keys.
GROUPS = 4096


class Retries(StatefulProcessor):
    """The state of a group of keys: their runs of failures, the tries that are set, and outcomes that the watermark hasn't passed.

    Each list is read and written as a whole, once a batch.  A key whose run a good outcome has ended has no state.
    """

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", f"key {self.kind}, failures int, event_id long, next_at long")
        self.held = handle.getListState("held", f"key {self.kind}, at long, event_id long, outcome string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            numbers = (None if e is None else int(e) for e in frame["event_id"].tolist())
            new = list(zip(frame["key"].tolist(), frame["micros"].tolist(), numbers, frame["outcome"].tolist()))
            if new:
                self.held.appendList(new)
                first = min(at for _, at, _, _ in new) if first is None else min(first, min(at for _, at, _, _ in new))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = {tuple(row) for row in self.held.get()}
        ready = sorted((row for row in held if row[1] // 1000 <= passed), key=lambda row: (row[1], row[2] is not None, row[2] or 0, row[3]))
        runs = {one: (failures, event, next_at) for one, failures, event, next_at in self.runs.get()}
        out: list[tuple] = []

        def ring(one, before: int | None) -> None:
            failures, event, next_at = runs[one]
            if next_at is not None and next_at // 1000 <= passed and (before is None or next_at < before):
                out.append((one, next_at, event, failures, "due", None))
                runs[one] = failures, event, None

        for one, at, event_id, outcome in ready:
            if one in runs:
                ring(one, at)
            if outcome == GOOD:
                runs.pop(one, None)
                out.append((one, at, event_id, 0, "done", None))
                continue
            failures = runs[one][0] + 1 if one in runs else 1
            next_at = at + SCHEDULE[failures - 1] * _DAY if failures <= len(SCHEDULE) else None
            runs[one] = failures, event_id, next_at
            out.append((one, at, event_id, failures, "given_up" if next_at is None else "waiting", next_at))
        for one in runs:
            ring(one, None)
        later = [row for row in held if row[1] // 1000 > passed]
        for state, rows in ((self.held, later), (self.runs, [(one, *run) for one, run in runs.items()])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        times = [row[1] for row in later] + [next_at for _, _, next_at in runs.values() if next_at is not None]
        if times:
            self.handle.registerTimer(min(times) // 1000)
        columns = [c.split()[0] for c in _OUT.split(", ")]
        values = list(zip(*out)) if out else [()] * (len(columns) + 1)
        yield pd.DataFrame({"key": pd.Series(values[0], dtype="object")} | {c: pd.Series(v, dtype="object" if c == "state" else "Int64") for c, v in zip(columns, values[1:])})

    def close(self) -> None:
        pass


def history_stream(outcomes: DataFrame, delay: str = "1 day") -> DataFrame:
    """The history as a stream of outcomes, each row once the watermark, delay behind the newest outcome, has passed it.

    Outcomes older than the watermark are left out.  Needs the RocksDB state store.
    """
    kind = outcomes.schema["key"].dataType.simpleString()
    # as text, since pandas would make floating numbers of a group's event_ids if one is null
    number = F.col("event_id").cast("string").alias("event_id")
    rows = outcomes.filter(F.col("outcome").isin(SHORT, GOOD) & F.col("key").isNotNull()).select("key", "at", F.unix_micros("at").alias("micros"), number, "outcome").withWatermark("at", delay)
    told = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int")).groupBy("part").transformWithStateInPandas(Retries(kind), f"key {kind}, {_OUT}", "Append", "EventTime")
    return _timed(told)


def run_available(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Appends what a stream has to tell to Parquet below folder, and returns when all that is there has been read.

    Each batch has a folder of its own, which a batch that is run again after a failure replaces, so nothing is told twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def told(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What ``run_available`` has written."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
