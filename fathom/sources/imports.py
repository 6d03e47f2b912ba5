"""Text files of other parties as typed records, with what can't be one told apart.

Every line of a file comes back either as a record or as a reject with a reason: ``malformed`` (more or fewer fields than
the file has, or a quote that isn't closed), ``no_name``, or ``no_form`` (a name that normal forms leave nothing of).
Lines without any field are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import formats
from fathom.functions import names as N
from fathom.functions import text as X

#: Fields of the three files by place; those of the second aren't named in it.
OPENVC = ("investor_name", "website_url", "hq_location", "countries_of_investment", "investment_stage", "investment_thesis", "investor_type", "check_size_min_usd", "check_size_max_usd")
RAMP = (
    "investor_name", "investor_type", "website_url", "investment_sectors", "investment_stage", "contact_name", "primary_contact_email", "portfolio_companies", "hq_location",
    "twitter_url", "linkedin_url", "facebook_url", "portfolio_count", "unknown_number", "description", "founded_year", "flag", "last",
)
PLATFORM_MANAGERS = ("manager_key", "display_name", "num_platforms", "platforms_used", "num_filings", "sample_entities", "ia_firm_name", "team_members")
_BROKEN = "_broken"


def fields(spark: SparkSession, path: str | list[str], columns: tuple[str, ...], header: bool = True, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Trimmed fields as text, and _broken: the line, if it isn't one of so many fields.

    Quoted fields may hold commas, doubled quotes and line breaks, which become line feeds.  Fields go by place, whatever a header says.  With
    aliases (for any columns, or none of them) they go by the header's names instead, in any order and case: unknown
    ones are left out, missing ones are null, and a header without any of the names is an error.
    """
    options = {"multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN, "header": header, "enforceSchema": True}
    by_name = header and aliases is not None
    there = [c.lstrip("\ufeff").strip() for c in spark.read.csv(path, **options).columns] if by_name else list(columns)
    raw = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(there))] + [T.StructField(_BROKEN, T.StringType())])
    rows = spark.read.csv(path, schema=raw, **options)
    low = [c.lower() for c in there]
    at = {c: next((low.index(a.lower()) for a in (c, *(aliases or {}).get(c, ())) if a.lower() in low), None) for c in columns}
    if all(i is None for i in at.values()):
        raise ValueError(f"none of {', '.join(columns)} in the header of {path}")
    found = rows.select(*((F.lit(None).cast("string") if i is None else F.trim(F.col(f"c{i}"))).alias(c) for c, i in at.items()), _BROKEN)
    return found.filter(F.col(_BROKEN).isNotNull() | (F.coalesce(*map(F.col, columns)).isNotNull() & (F.concat_ws("", *columns) != "")))


def parted(rows: DataFrame, name: str, form: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fields that make a record, and the rest as rejects (reason, line): line is the broken one, or its fields."""
    kept = [c for c in rows.columns if c != _BROKEN]
    reason = F.when(F.col(_BROKEN).isNotNull(), "malformed").when(F.coalesce(name, F.lit("")) == "", "no_name")
    if form:
        reason = reason.when(N.normal(F.col(name), form) == "", "no_form")
    judged = rows.withColumn("reason", reason)
    line = F.coalesce(_BROKEN, F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in kept)))
    return judged.filter("reason IS NULL").select(*kept), judged.filter("reason IS NOT NULL").select("reason", line.alias("line"))


def listed(text: Column) -> Column:
    """Parts between commas that aren't empty; null for none."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def _text(name: str) -> Column:
    return F.nullif(name, F.lit(""))


def _link(name: str) -> Column:
    return formats.with_scheme(F.col(name))


def openvc(rows: DataFrame) -> DataFrame:
    """Records of fields of the first list."""
    return rows.select(
        "investor_name", N.normal(F.col("investor_name"), "investor").alias("normalized_name"), _link("website_url").alias("website_url"), _text("hq_location").alias("hq_location"), listed(F.col("countries_of_investment")).alias("countries_of_investment"),
        *(_text(c).alias(c) for c in ("investment_stage", "investment_thesis", "investor_type")), *(X.dollars(F.col(c)).alias(c) for c in ("check_size_min_usd", "check_size_max_usd")), F.lit("openvc").alias("source"),
    )


def ramp(rows: DataFrame) -> DataFrame:
    """Records of fields of the second list."""
    count = F.nullif(F.regexp_extract("portfolio_count", r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    return rows.select(
        "investor_name", N.normal(F.col("investor_name"), "investor").alias("normalized_name"), _link("website_url").alias("website_url"), _text("investor_type").alias("investor_type"), listed(F.col("investment_sectors")).alias("investment_sectors"),
        _text("investment_stage").alias("investment_stage"), _text("contact_name").alias("contact_name"), F.lower(_text("primary_contact_email")).alias("primary_contact_email"), listed(F.col("portfolio_companies")).alias("portfolio_companies"), _text("hq_location").alias("hq_location"),
        _link("twitter_url").alias("twitter_url"), _link("linkedin_url").alias("linkedin_url"), count.alias("portfolio_count"), _text("description").alias("description"), X.year_in(F.col("founded_year")).alias("founded_year"), F.lit("ramp").alias("source"),
    )


def import_list(spark: SparkSession, path: str | list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of a list of investors (openvc, ramp) or of platform managers."""
    if kind == "openvc":
        good, bad = parted(fields(spark, path, OPENVC), "investor_name", "investor")
        return openvc(good), bad
    if kind == "ramp":
        good, bad = parted(fields(spark, path, RAMP, header=False), "investor_name", "investor")
        return ramp(good), bad
    return parted(fields(spark, path, PLATFORM_MANAGERS, aliases={}), "display_name")
