"""Detectors of regulatory gaps, and merges of records that people have already worked on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import formats
from fathom.functions import names as N
from fathom.functions import text as T
from fathom.operators import containment, core
from fathom.sources import work

#: Severities from the gravest; unknown ones come last.
SEVERITIES = ("critical", "high", "medium", "low")


def overdue_amendments(matches: DataFrame, filings: DataFrame, due_year: int) -> DataFrame:
    """Advisers whose latest year with values is before due_year, and how many of their filings came after it."""
    latest = matches.filter("adviser_entity_crd IS NOT NULL").groupBy(F.col("adviser_entity_crd").alias("crd")).agg(F.max("latest_adv_year").alias("latest_year")).filter(F.col("latest_year") < due_year)
    filed = matches.select(F.col("adviser_entity_crd").alias("crd"), "accessionnumber").join(filings.select("accessionnumber", F.year(T.mixed_date(F.col("filing_date"))).alias("year")), "accessionnumber")
    both = latest.join(filed, "crd", "left").groupBy("crd", "latest_year").agg(F.count_if(F.col("year") > F.col("latest_year")).alias("n_later"))
    return both.withColumn("severity", F.lit("high"))


def fund_type_mismatch(matches: DataFrame, equal_is_same: bool = True) -> DataFrame:
    """Matches whose two types have no family in common; sides without a type are skipped."""
    rows = matches.filter("fund_type <> '' AND investmentfundtype <> ''").filter(~formats.same_kind(F.col("fund_type"), F.col("investmentfundtype"), equal_is_same))
    return rows.select("fund_id", "accessionnumber", formats.standard_type(F.col("fund_type")).alias("adv_type"), formats.standard_type(F.col("investmentfundtype")).alias("filed_type"), F.lit("medium").alias("severity"))


def missing_funds(funds: DataFrame, filings: DataFrame, matches: DataFrame, before_year: int) -> DataFrame:
    """Unmatched filings of earlier years under a file number that an adviser's fund lists; the smallest crd of each."""
    numbers = funds.select(F.col("adviser_entity_crd").alias("crd"), F.explode(T.listed(F.col("form_d_file_number"))).alias("file_num")).filter("crd IS NOT NULL").distinct()
    left = filings.filter(F.year(T.mixed_date(F.col("filing_date"))) < before_year).join(matches.select("accessionnumber"), "accessionnumber", "left_anti")
    return left.join(numbers, "file_num").groupBy("accessionnumber").agg(F.min("crd").alias("crd")).withColumn("severity", F.lit("medium"))


def needs_registration(filings: DataFrame, matches: DataFrame, advisers: DataFrame, blocked: str, as_of: str, months: int = 6, grace: int = 60) -> DataFrame:
    """Managers whose unmatched filings began in the last months but before the grace days, and that match no adviser."""
    day, now = T.mixed_date(F.col("filing_date")), F.lit(as_of).cast("date")
    recent = filings.filter((day >= F.add_months(now, -months)) & (F.date_diff(now, day) > grace))
    rolled = core.new_managers(recent.join(matches.select("accessionnumber"), "accessionnumber", "left_anti"), blocked)
    known = core.blocked_match(rolled.select(F.col("series_master").alias("id"), F.col("series_master").alias("name")), advisers.select(F.col("crd").alias("key"), F.col("adviser_name").alias("name")))
    return rolled.join(known.select(F.col("id").alias("series_master")), "series_master", "left_anti").withColumn("severity", F.lit("high"))


def all_issues(**found: tuple[DataFrame, str]) -> DataFrame:
    """One table of issue_type, subject, severity and rank (0 is the gravest) from type=(rows, subject column)."""
    parts = [rows.select(F.lit(kind).alias("issue_type"), F.col(subject).cast("string").alias("subject"), "severity") for kind, (rows, subject) in found.items()]
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")) - 1, F.lit(len(SEVERITIES)))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank.cast("int"))


def is_empty(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def preserving_merge(old: DataFrame, new: DataFrame, key: str, status: str, columns: list[str]) -> DataFrame:
    """New records over old ones: verified ones stay, those found automatically get only their empty texts filled, others are replaced."""
    a, b = old.select(key, status, *columns, F.lit(True).alias("_old")).alias("a"), new.select(key, status, *columns, F.lit(True).alias("_new")).alias("b")
    stays = F.col("a._old") & (F.col("b._new").isNull() | (F.col(f"a.{status}") == "manually_verified"))
    fills = F.col("a._old") & (F.col(f"a.{status}") == "auto_enriched")
    pick = lambda c: F.when(stays, F.col(f"a.{c}")).when(fills & (~is_empty(F.col(f"a.{c}")) | is_empty(F.col(f"b.{c}"))), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(pick(c).alias(c) for c in (status, *columns)))


def prefix_lookup(left: DataFrame, known: DataFrame) -> DataFrame:
    """For each id of left (id, name) the longest prefix of two words or more, or the whole, that is a key of known (key)."""
    words = F.split(T.normalised_name(F.col("name")), " ")
    lengths = F.sequence(F.least(F.lit(2), F.size("words")), F.size("words"))
    rows = left.select("id", words.alias("words")).filter(F.length(F.array_join("words", " ")) >= 5)
    prefixes = rows.select("id", F.explode(F.transform(lengths, lambda k: F.array_join(F.slice("words", F.lit(1), k), " "))).alias("key"))
    return prefixes.join(known.select("key").distinct(), "key").groupBy("id").agg(F.max_by("key", F.length("key")).alias("key"))


def named_in_filings(advisers: DataFrame, filings: DataFrame, matches: DataFrame, before_year: int) -> DataFrame:
    """Unmatched filings of earlier years whose text holds two of an adviser's first three telling words, anywhere inside words; the smallest crd of each."""
    # advisers of equal words are one: the smallest crd counts
    kinds = advisers.select("crd", F.array_sort(F.array_distinct(N.keywords(F.col("adviser_name")))).alias("words")).filter("size(words) > 1").groupBy("words").agg(F.min("crd").alias("crd"))
    # what is met is made first: a plan that derives it wherever it is read is too large for a driver
    words = work.written(kinds.select("crd", F.explode("words").alias("keyword")), "words")
    left = filings.filter(F.year(T.mixed_date(F.col("filing_date"))) < before_year).join(matches.select("accessionnumber"), "accessionnumber", "left_anti")
    said = left.select("accessionnumber", F.upper("entityname").alias("text"))
    # texts repeat, so each is counted against the advisers once
    texts = work.written(said.select("text").distinct(), "texts")
    held = containment.held(words.select(F.col("keyword").alias("part")), texts).select(F.col("part").alias("keyword"), "text")
    hits = held.join(words, "keyword").groupBy("text", "crd").agg(F.count("*").alias("n")).filter("n >= 2").groupBy("text").agg(F.min("crd").alias("crd"))
    hits = work.written(hits, "hits")
    return said.join(hits, "text").select("accessionnumber", "crd").withColumn("severity", F.lit("medium"))


def graded_registration(filings: DataFrame, matches: DataFrame, blocked: str, as_of: str) -> DataFrame:
    """Managers with unmatched filings, graded by the days since the first: critical over 180, high over 120, else medium."""
    rolled = core.new_managers(filings.join(matches.select("accessionnumber"), "accessionnumber", "left_anti"), blocked)
    days = F.date_diff(F.lit(as_of).cast("date"), "first_filing")
    return rolled.withColumn("days", days.cast("long")).withColumn("severity", F.when(days > 180, "critical").when(days > 120, "high").otherwise("medium"))
