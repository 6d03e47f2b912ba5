"""New filings as a stream, and the freshness test.  The reading position is the query's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_rows(spark: SparkSession, folder: str, schema: T.StructType, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """Rows of Parquet files that arrive in folder, each key once; keys are remembered for delay."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(folder)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def process_available(rows: DataFrame, known: Callable[[], DataFrame], key: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands over what is new and not known yet, batch by batch, and returns when nothing is left."""

    def batch(df: DataFrame, number: int) -> None:
        handle(df.join(known().select(key), key, "left_anti"), number)

    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def freshness(rows: DataFrame, time: str, as_of: str, max_days: int = 14) -> DataFrame:
    """latest, age_days and fresh; fresh is false for an empty table."""
    latest = rows.agg(F.max(time).alias("latest"))
    return latest.withColumn("age_days", F.date_diff(F.lit(as_of).cast("date"), F.to_date("latest"))).withColumn("fresh", F.coalesce(F.col("age_days") <= max_days, F.lit(False)))
