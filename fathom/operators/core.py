"""Relational operators of the domain: cross-reference, roll-ups, detectors, growth, matching, merging.

All take and return lazy DataFrames; keys are equi-joined, so Spark picks broadcast or sort-merge by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as T


def latest_by(rows: DataFrame, key: Column, order: str, *columns: str) -> DataFrame:
    """The row with the largest order value for each non-null key."""
    return rows.withColumn("_key", key).filter("_key IS NOT NULL").groupBy("_key").agg(F.max_by(F.struct(*columns), order).alias("_row")).select(F.col("_key").alias("key"), "_row.*")


def cross_reference(funds: DataFrame, filings: DataFrame, advisers: DataFrame, years: DataFrame, due_year: int) -> DataFrame:
    """Funds with their filing: by the first listed file number that hits, else by normalised name."""
    filings = filings.select("id", "accessionnumber", "file_num", "entityname", "investmentfundtype")
    by_number = latest_by(filings, F.col("file_num"), "id", "id", "accessionnumber", "entityname", "investmentfundtype")
    name = T.normalised_name(F.col("entityname"))
    by_name = latest_by(filings, F.when(F.length(name) >= 3, name), "id", "id", "accessionnumber", "entityname", "investmentfundtype")
    numbers = funds.select("fund_id", F.posexplode(T.listed(F.col("form_d_file_number"))).alias("place", "key"))
    first = numbers.join(by_number, "key").groupBy("fund_id").agg(F.min_by(F.struct("id", "accessionnumber", "entityname", "investmentfundtype"), "place").alias("hit"))
    found = first.select("fund_id", "hit.*", F.lit("file_number").alias("method"))
    rest = funds.join(found, "fund_id", "left_anti").select("fund_id", T.normalised_name(F.col("fund_name")).alias("key"))
    found = found.unionByName(rest.join(by_name, "key").select("fund_id", "id", "accessionnumber", "entityname", "investmentfundtype", F.lit("name").alias("method")))
    latest = years.filter("gav IS NOT NULL AND gav <> 0").groupBy("fund_id").agg(F.max("year").alias("latest_adv_year"))
    out = funds.join(found, "fund_id").join(latest, "fund_id", "left").join(advisers.select(F.col("crd").alias("adviser_entity_crd"), "adviser_name"), "adviser_entity_crd", "left")
    venture, equity = F.col("investmentfundtype").contains("Venture"), F.col("fund_type").contains("Private Equity")
    hedge = F.col("fund_type").contains("Hedge") != F.col("investmentfundtype").contains("Hedge")
    issues = F.concat_ws(" | ", F.when(venture & equity, "fund type PE vs VC"), F.when(hedge, "hedge fund mismatch"))
    return out.select("fund_id", "accessionnumber", "method", "adviser_entity_crd", "adviser_name", "fund_type", "investmentfundtype", "latest_adv_year", issues.alias("issues"), (F.col("latest_adv_year") < due_year).alias("overdue_adv_flag"))


def new_managers(filings: DataFrame, blocked: str) -> DataFrame:
    """Filings that aren't amendments rolled up to the series' manager."""
    rows = filings.filter("isamendment <> 'true'").select(T.series_master(F.col("entityname")).alias("series_master"), T.mixed_date(F.col("filing_date")).alias("day"), F.col("amount").cast("decimal(18,2)").alias("amount"))
    rows = rows.filter(F.col("series_master").isNotNull() & ~F.lower("series_master").rlike(blocked))
    return rows.groupBy("series_master").agg(F.count("*").alias("n_filings"), F.sum("amount").cast("double").alias("total_amount"), F.min("day").alias("first_filing"))


def newest_per(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def growth(values: DataFrame, key: str) -> DataFrame:
    """Growth in percent over 1, 2 and 5 years back from each key's latest year; null without exactly that year."""
    values = values.filter("value IS NOT NULL AND value <> 0")
    latest = values.groupBy(key).agg(F.max("year").alias("latest"))
    both = values.join(latest, key)
    at = lambda back: F.max(F.when(F.col("year") == F.col("latest") - back, F.col("value")))
    wide = both.groupBy(key, "latest").agg(at(0).alias("now"), *(at(b).alias(f"back{b}") for b in (1, 2, 5)))
    return wide.select(key, F.col("latest").alias("latest_year"), *(F.round((F.col("now") - F.col(f"back{b}")) / F.col(f"back{b}") * 100, 4).alias(f"growth_{b}y") for b in (1, 2, 5)))


def blocked_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each id of left (id, name) the best right (key, name): shared distinctive tokens, gate, most shared, shortest name, smallest key.

    Names that share one token only need the shortest name of each token, which is found before anything is joined.
    Names that share two meet at a token that isn't the commonest of either, so a word in every name joins nothing.
    """
    a = left.select("id", T.distinctive_tokens(F.col("name")).alias("a"))
    b = right.select("key", F.col("name").alias("found"), T.distinctive_tokens(F.col("name")).alias("b"))
    counts = b.select(F.explode("b").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def rarer(rows: DataFrame, tokens: str, *keep: str) -> DataFrame:
        """A row for each token of rows but the commonest one."""
        each = rows.filter(F.size(tokens) > 1).select(*keep, F.explode(tokens).alias("token")).join(counts, "token", "left")
        order = each.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("o"))
        return order.select(*keep, F.explode(F.slice("o", F.lit(1), F.size("o") - 1)).alias("x")).select(*keep, "x.token")

    two = rarer(a, "a", "id", "a").join(rarer(b, "b", "key", "found", "b"), "token").select("id", "a", "key", "found", "b")
    first = b.select(F.explode("b").alias("token"), "key", "found", "b").filter(F.length("token") >= 5).groupBy("token").agg(F.min_by(F.struct("key", "found", "b"), F.struct(F.length("found"), "key")).alias("x"))
    one = a.select("id", "a", F.explode("a").alias("token")).join(first, "token").select("id", "a", "x.*")
    pairs = two.union(one).filter(T.gate(F.col("a"), F.col("b"))).withColumn("shared", F.size(F.array_intersect("a", "b")))
    best = pairs.groupBy("id").agg(F.min_by(F.struct("key", "shared"), F.struct(-F.col("shared"), F.length("found"), "key")).alias("x"))
    return best.select("id", "x.key", "x.shared")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of old with new's non-null values over theirs, and new's own rows."""
    a, b = old.select(key, *columns).alias("a"), new.select(key, *columns).alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns))


def exemption_mismatch(matches: DataFrame, funds: DataFrame, filings: DataFrame) -> DataFrame:
    """Matches whose two sides differ in either exclusion; a side that names none says no to both."""
    rows = matches.select("fund_id", "accessionnumber").join(funds.select("fund_id", "exclusion_3c1", "exclusion_3c7"), "fund_id").join(filings.select("accessionnumber", "exemptions"), "accessionnumber")
    one, seven = T.is_yes(F.col("exclusion_3c1")), T.is_yes(F.col("exclusion_3c7"))
    rows = rows.select("fund_id", "accessionnumber", one.alias("adv_3c1"), seven.alias("adv_3c7"), T.claims_3c1(F.col("exemptions")).alias("filed_3c1"), T.claims_3c7(F.col("exemptions")).alias("filed_3c7"))
    return rows.filter("adv_3c1 <> filed_3c1 OR adv_3c7 <> filed_3c7").withColumn("severity", F.lit("high"))


def vc_exemption_violation(advisers: DataFrame, funds: DataFrame) -> DataFrame:
    """Advisers that claim the venture exemption and have typed funds of another kind."""
    claims = advisers.filter(T.is_yes(F.col("exemption_2b1"))).select("crd", "adviser_name")
    other = funds.filter(~F.lower("fund_type").contains("venture")).select(F.col("adviser_entity_crd").alias("crd"), "fund_type")
    kinds = other.groupBy("crd", "fund_type").agg(F.count("*").alias("n")).groupBy("crd").agg(F.sum("n").alias("n_funds"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", F.col("n").cast("string"), "fund_type"))), ", ").alias("breakdown"))
    return claims.join(kinds, "crd").withColumn("severity", F.lit("critical"))
