"""Registered queries of work lists, pages of matches and what sites add to records, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import formats
from fathom.functions import html as H
from fathom.functions import text as T
from fathom.operators import listings as L
from fathom.operators import records as W
from fathom.plans.catalog import _ALL, _XREF, SQL, matches, query
from fathom.plans.issues import _lookup
from fathom.plans.lists import _NUMBER, _ROLLED
from fathom.sources.views import table, with_views

_TRIES = "tries AS (SELECT series_master AS key, series_master AS name, NULL::VARCHAR AS related_names, NULL::VARCHAR AS related_roles FROM rolled WHERE lower(trim(series_master)) NOT IN (SELECT lower(trim(series_master_llc)) FROM records WHERE series_master_llc IS NOT NULL))"


@query("jn07_truly_unknown", f", {_ROLLED}, {_TRIES}, {_lookup('tries', True)} SELECT key AS series_master FROM tries WHERE key NOT IN (SELECT key FROM lk)", "notices", "records", "registry", "owners")
def jn07(spark, d):
    """Managers that are in no record and that the register doesn't know."""
    left = W.not_yet(L.managers_of(table(spark, d, "notices")), table(spark, d, "records")).select("series_master")
    advisers = table(spark, d, "registry")
    return W.unregistered(left, advisers, table(spark, d, "owners"))


@query("jn31_filings_of_series", f", {_ROLLED} SELECT series_master, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM rolled JOIN notices ON contains(lower(entityname), 'a series of ' || lower(series_master)) GROUP BY 1", "notices")
def jn31(spark, d):
    """Filings of each manager, also those in which more follows its name."""
    filings = table(spark, d, "notices")
    found = W.filings_of_series(L.managers_of(filings).select("series_master"), filings)
    return found.groupBy("series_master").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_MASTER = r"trim(regexp_extract(entityname, '(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$', 1))"


@query("ag03_first_filing_as_text", f"SELECT {_MASTER} AS series_master, count(*) AS fund_count, min(filing_date) AS first_filing_date FROM notices WHERE {_MASTER} <> '' AND NOT regexp_matches(lower({_MASTER}), '{'|'.join(L.UMBRELLAS)}') GROUP BY 1", "notices")
def ag03(spark, d):
    """The first date as text is: dates written day first go before all that are written year first."""
    rows = table(spark, d, "notices").select(F.trim(T.series_master(F.col("entityname"))).alias("series_master"), "filing_date")
    rows = rows.filter(F.col("series_master").isNotNull() & ~F.lower("series_master").rlike("|".join(L.UMBRELLAS)))
    return rows.groupBy("series_master").agg(F.count("*").alias("fund_count"), F.min("filing_date").alias("first_filing_date"))


@query("ag21_inconsistencies")
def ag21(spark, d):
    """How many matches there are, and how many of them say that something differs."""
    return matches(spark, d).agg(F.count("*").alias("total_matches"), F.count_if(F.trim("issues") != "").alias("inconsistency_count"), F.count_if("overdue_adv_flag").alias("overdue_count"))


SQL["ag21_inconsistencies"] = with_views("", *_ALL).rstrip() + "," + _XREF + " SELECT count(*) AS total_matches, count_if(trim(issues) <> '') AS inconsistency_count, count_if(overdue_adv_flag) AS overdue_count FROM matches"


_DOLLARS = _NUMBER.format("regexp_replace(totalofferingamount, '[$,]', '', 'g')")


@query("sf22_full_currency", f"""
SELECT id, CASE WHEN lower(totalofferingamount) = 'indefinite' THEN 'Indefinite' WHEN n IS NULL THEN 'N/A' ELSE CASE WHEN n < 0 THEN '-$' ELSE '$' END || format('{{:,}}', abs(round(n))::BIGINT) END AS shown
FROM (SELECT id, totalofferingamount, {_DOLLARS} AS n FROM notices)""", "notices")
def sf22_full(spark, d):
    return table(spark, d, "notices").select("id", formats.full_currency(F.col("totalofferingamount")).alias("shown"))


@query("dt02_loose_dates", "SELECT id, CASE WHEN id % 7 <> 5 THEN o END AS day FROM (SELECT o_orderkey AS id, o_orderdate::DATE AS o FROM orders)")
def dt02(spark, d):
    """Dates in the forms that records have them in."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("o"))
    show = lambda form: F.date_format("o", form)
    k = F.col("id") % 7
    text = F.when(k == 0, F.concat(F.lit("filed on "), F.upper(show("dd-MMM-yyyy")), F.lit(" or so"))).when(k == 1, F.concat(show("yyyy-MM-dd"), F.lit("T10:30:00Z"))).when(k == 2, show("M/d/yyyy")).when(k == 3, show("MMMM d, yyyy"))
    text = text.when(k == 4, F.concat(show("yyyy-MM-dd"), F.lit(" 10:30"))).when(k == 5, F.concat(F.lit("in "), show("yyyy-MM-dd"))).otherwise(show("d-MMM-yyyy"))
    return rows.select("id", T.loose_date(text).alias("day"))


@query("ru14_backfilled", r"""
SELECT r.id, coalesce(CASE WHEN page_id % 5 = 0 THEN 'https://linkedin.com/company/Alpine-' || page_id END, linkedin_company_url) AS linkedin_company_url,
       list_concat(coalesce(t, CAST([] AS VARCHAR[])), CASE WHEN page_id % 5 = 0 THEN ['Ann Lee', 'Ann Lee'] ELSE CAST([] AS VARCHAR[]) END) AS team, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 0 END AS n_added, coalesce(page_id % 5 = 0, false) AS changed
FROM (SELECT id, linkedin_company_url, list_transform(CAST(json_extract(CASE WHEN json_valid(team_members) THEN team_members ELSE '[]' END, '$[*]') AS JSON[]), lambda m: m->>'$.name') AS t FROM records) r
LEFT JOIN firm_pages ON page_id = r.id""", "records", "firm_pages")
def ru14(spark, d):
    """Company and persons of a site's profiles added to the record of the same number."""
    team = F.transform(F.from_json("team_members", "array<struct<name: string, linkedin: string>>"), lambda m: m)
    records = table(spark, d, "records").select("id", "linkedin_company_url", team.alias("team"))
    found = table(spark, d, "firm_pages").select(F.col("page_id").alias("id"), H.profiles(F.col("html")).alias("p")).select("id", "p.*")
    return W.backfilled(records, found).withColumn("team", F.transform("team", lambda m: m["name"]))
