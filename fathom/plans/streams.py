"""Registered queries over streams and their batch forms, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.plans.catalog import query
from fathom.sources import work
from fathom.sources.views import table
from fathom.streaming import counts, retries

#: Hours that streams wait for late events.
DELAY_HOURS = 24
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MILLIS = DELAY_HOURS * 3_600_000


@contextmanager
def state_store(spark: SparkSession, provider: str = _ROCKS) -> Iterator[None]:
    """Streams that start inside keep their state in this store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table of events as a stream of its files; a pattern, as a stream can't be of one file."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def outcomes(events: DataFrame) -> DataFrame:
    """Errors fall short, purchases are good; a key is a user and the last digit of k."""
    key = F.concat_ws("/", F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.coalesce((F.get_json_object("props", "$.k").try_cast("int") % 10).cast("string"), F.lit("")))
    outcome = F.when(F.col("event_type") == "error", retries.SHORT).when(F.col("event_type") == "purchase", retries.GOOD)
    return events.select(key.alias("key"), F.col("ts").cast("timestamp").alias("at"), "event_id", outcome.alias("outcome"))


def watermark(rows: DataFrame, time: str = "at") -> DataFrame:
    """One row: the millisecond that a stream's watermark reaches after all rows."""
    return rows.agg((F.floor(F.unix_micros(F.max(time)) / 1000) - _MILLIS).alias("millis"))


def shown(rows: DataFrame, *times: str) -> DataFrame:
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in times})


_OUTCOMES = f"""
WITH o AS (
  SELECT concat_ws('/', coalesce(user_id::VARCHAR, ''), coalesce((try_cast(props->>'$.k' AS INT) % 10)::VARCHAR, '')) AS key, ts AS t, event_id,
         CASE event_type WHEN 'error' THEN 'short' WHEN 'purchase' THEN 'good' END AS outcome
  FROM events),
w AS (SELECT epoch_ms(max(t)) - {_MILLIS} AS millis FROM o WHERE outcome IS NOT NULL)"""


def _history_sql(until: str) -> str:
    days = ", ".join(map(str, retries.SCHEDULE))
    text = lambda c: f"strftime(make_timestamp({c}), '%Y-%m-%d %H:%M:%S.%f')"
    return f"""{_OUTCOMES},
r AS (SELECT DISTINCT key, epoch_us(t) AS t, event_id, outcome, {until} AS millis FROM o, w WHERE outcome IS NOT NULL AND t IS NOT NULL AND epoch_us(t) // 1000 <= {until}),
s AS (
  SELECT *, count_if(outcome = 'good') OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run,
         lead(t) OVER (PARTITION BY key ORDER BY t, event_id) AS after
  FROM r),
f AS (SELECT *, count_if(outcome = 'short') OVER (PARTITION BY key, run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::INT AS failures FROM s),
n AS (SELECT *, CASE WHEN outcome = 'short' AND failures <= {len(retries.SCHEDULE)} THEN t + [{days}][failures]::BIGINT * 86400000000 END AS next_at FROM f),
h AS (
  SELECT key, t, event_id, failures, CASE WHEN outcome = 'good' THEN 'done' WHEN next_at IS NULL THEN 'given_up' ELSE 'waiting' END AS state, next_at FROM n
  UNION ALL
  SELECT key, next_at, event_id, failures, 'due', NULL FROM n WHERE next_at IS NOT NULL AND (after IS NULL OR after > next_at) AND next_at // 1000 <= millis)
SELECT key, {text('t')} AS "at", event_id, failures, state, {text('next_at')} AS next_at FROM h"""


@query("sm03_retry_history", _history_sql("9223372036854775"))
def sm03_history(spark, d):
    return shown(retries.history(outcomes(table(spark, d, "events"))), "at", "next_at")


@query("sm03_retry_stream", _history_sql("millis"))
def sm03_stream(spark, d):
    rows = retries.history_stream(outcomes(events_stream(spark, d)), f"{DELAY_HOURS} hours")
    place = work.folder(spark, "retries")
    with state_store(spark):
        retries.run_available(rows, f"{place}/told", f"{place}/checkpoint")
    return shown(retries.told(spark, f"{place}/told", rows.schema), "at", "next_at")


@query("sm03_retry_states", f"""SELECT key, arg_max(state, o) AS state, arg_max(failures, o) AS failures, count_if(state = 'due') AS n_due FROM (
  SELECT *, "at" || CASE WHEN state = 'due' THEN '~' ELSE '' END || lpad(event_id::VARCHAR, 20, '0') AS o FROM ({_history_sql('9223372036854775')})) GROUP BY key""")
def sm03_states(spark, d):
    """Where each key stands in the end."""
    rows = retries.history(outcomes(table(spark, d, "events")))
    order = F.struct("at", (F.col("state") == "due").alias("due"), "event_id")
    return rows.groupBy("key").agg(F.max_by("state", order).alias("state"), F.max_by("failures", order).alias("failures"), F.count_if(F.col("state") == "due").alias("n_due"))


@query("sm11_daily_stream", f"""
SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS hundredths, count(*) > 10 AS over_limit
FROM events, (SELECT epoch_ms(max(ts)) - {_MILLIS} AS millis FROM events)
WHERE epoch_ms((ts::DATE + 1)::TIMESTAMP) <= millis GROUP BY 1, 2""")
def sm11_stream(spark, d):
    """Days that are over, as a stream tells them."""
    events = events_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = counts.windowed(events, "event_type", "ts", "value", delay=f"{DELAY_HOURS} hours")
    place = work.folder(spark, "daily")
    retries.run_available(rows, f"{place}/told", f"{place}/checkpoint")
    return retries.told(spark, f"{place}/told", rows.schema).select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "event_type", "n", "hundredths", "over_limit")
