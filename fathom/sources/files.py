"""Text files in and out: CSV with quotes and line breaks inside fields, JSON, Markdown tables, tables replaced part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """Quoted fields may hold quotes (doubled), commas and line breaks; broken rows have nulls."""
    return spark.read.csv(path, schema=schema, header=header, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes where a field needs them."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One array or object of rows a file."""
    return spark.read.json(path, schema=schema, multiLine=True)


def markdown_rows(rows: DataFrame) -> DataFrame:
    """value: a line of a Markdown table for each row; bars and line breaks inside cells are escaped, nulls are empty."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, rows.columns)), F.lit(" |")).alias("value"))


def replace_parts(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows so that only the parts (values of by) that they have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def aligned(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the columns of schema: unknown ones go, missing ones are null."""
    return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
