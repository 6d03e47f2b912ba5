"""Counts that are kept as sketches: small, stored once a day, and added up over any days later without the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A distinct count's standard error is about 1.04 / 2 ** (PRECISION / 2); a rank is off by no more than RANK_ERROR of the rows.
PRECISION, RANK_ERROR = 14, 0.02
_K = 400


def daily(events: DataFrame, time: str, kind: str, who: str, value: str) -> DataFrame:
    """day, kind, n, and two sketches: of the different who, and of the values.  Events without a time or a value count for neither."""
    rows = events.filter(F.col(time).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(F.to_date(time).alias("day"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.hll_sketch_agg(who, PRECISION).alias("whos"), F.kll_sketch_agg_double(value, F.lit(_K)).alias("values"))


def rolled(sketches: DataFrame, *by: Column) -> DataFrame:
    """n, whos and values of the days together, by any expressions."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("whos").alias("whos"), F.kll_merge_agg_double("values", F.lit(_K)).alias("values"))


def estimated(rows: DataFrame, *shares: float) -> DataFrame:
    """rows with different (the estimated number of who) and one column q<percent> a share, instead of the sketches."""
    quantiles = {f"q{round(100 * s)}": F.kll_sketch_get_quantile_double("values", F.lit(s)) for s in shares}
    return rows.withColumns({"different": F.hll_sketch_estimate("whos"), **quantiles}).drop("whos", "values")
