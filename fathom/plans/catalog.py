"""Registered queries over the derived tables, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import core
from fathom.sources.views import table, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
BLOCKED = "green|roll up vehicles"
DUE = 2001

_NORM = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(upper({0}), '[,.''\"()/-]', ' ', 'g'), '\s+', ' ', 'g')), '( (LLC|L L C|LP|L P|INC|LTD|CO|CORP|CORPORATION|COMPANY|LIMITED))+$', ''))"
_DAY = "coalesce(try_strptime(filing_date, '%Y-%m-%d'), try_strptime(filing_date, '%d-%b-%Y'))::DATE"
_XREF = rf"""
by_number AS (SELECT file_num AS key, max_by(id, id) AS id FROM filings GROUP BY 1),
by_name AS (SELECT {_NORM.format('entityname')} AS key, max(id) AS id FROM filings GROUP BY 1 HAVING length(key) >= 3),
numbers AS (SELECT fund_id, unnest(string_split_regex(form_d_file_number, '[;,|]')) AS raw, generate_subscripts(string_split_regex(form_d_file_number, '[;,|]'), 1) AS place FROM funds),
first AS (SELECT fund_id, min_by(id, place) AS id FROM numbers JOIN by_number ON trim(raw) = key GROUP BY 1),
found AS (SELECT fund_id, id, 'file_number' AS method FROM first
  UNION ALL SELECT fund_id, id, 'name' FROM funds JOIN by_name ON {_NORM.format('fund_name')} = key WHERE fund_id NOT IN (SELECT fund_id FROM first)),
latest AS (SELECT fund_id, max(year) AS latest_adv_year FROM fund_years WHERE gav <> 0 GROUP BY 1),
matches AS (
SELECT f.fund_id, accessionnumber, method, adviser_entity_crd, adviser_name, fund_type, investmentfundtype, latest_adv_year,
  concat_ws(' | ', CASE WHEN contains(investmentfundtype, 'Venture') AND contains(fund_type, 'Private Equity') THEN 'fund type PE vs VC' END,
    CASE WHEN contains(fund_type, 'Hedge') <> contains(investmentfundtype, 'Hedge') THEN 'hedge fund mismatch' END) AS issues,
  latest_adv_year < {DUE} AS overdue_adv_flag
FROM funds f JOIN found USING (fund_id) JOIN filings USING (id) LEFT JOIN latest USING (fund_id) LEFT JOIN advisers ON crd = adviser_entity_crd)"""
_ALL = ("advisers", "funds", "fund_years", "filings")


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query, and its SQL over views."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (with_views("", *views).rstrip() + sql if sql.startswith(",") else with_views(sql, *views)) if views else sql
        return f

    return keep


def matches(spark: SparkSession, d: str) -> DataFrame:
    return core.cross_reference(*(table(spark, d, t) for t in ("funds", "filings", "advisers", "fund_years")), due_year=DUE)


@query("ag02_new_managers", rf"""SELECT regexp_extract(entityname, '(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$', 1) AS series_master, count(*) AS n_filings,
  sum(amount::DECIMAL(18,2))::DOUBLE AS total_amount, min({_DAY}) AS first_filing FROM filings
  WHERE isamendment <> 'true' AND regexp_extract(entityname, '(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$', 1) <> '' AND NOT regexp_matches(lower(regexp_extract(entityname, '(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$', 1)), '{BLOCKED}') GROUP BY 1""", "filings")
def ag02(spark, d):
    return core.new_managers(table(spark, d, "filings"), BLOCKED)


@query("de11_cross_reference")
def de11(spark, d):
    return matches(spark, d)


SQL["de11_cross_reference"] = with_views("", *_ALL).rstrip() + "," + _XREF + " SELECT * FROM matches"


@query("jn05_unmatched_filings")
def jn05(spark, d):
    return table(spark, d, "filings").join(matches(spark, d).select("accessionnumber"), "accessionnumber", "left_anti").select("accessionnumber", "cik", T.mixed_date(F.col("filing_date")).alias("filed"))


SQL["jn05_unmatched_filings"] = with_views("", *_ALL).rstrip() + "," + _XREF + f" SELECT accessionnumber, cik, {_DAY} AS filed FROM filings WHERE accessionnumber NOT IN (SELECT accessionnumber FROM matches)"


@query("de06_exemption_mismatch")
def de06(spark, d):
    return core.exemption_mismatch(matches(spark, d), table(spark, d, "funds"), table(spark, d, "filings"))


SQL["de06_exemption_mismatch"] = with_views("", *_ALL).rstrip() + "," + _XREF + """, sides AS (
SELECT m.fund_id, accessionnumber, exclusion_3c1 = 'Y' AS adv_3c1, exclusion_3c7 = 'Y' AS adv_3c7,
  coalesce(contains(lower(exemptions), '3c.1') OR (contains(lower(exemptions), '3c') AND NOT contains(lower(exemptions), '3c.7')), false) AS filed_3c1, coalesce(contains(lower(exemptions), '3c.7'), false) AS filed_3c7
FROM matches m JOIN funds USING (fund_id) JOIN filings USING (accessionnumber))
SELECT *, 'high' AS severity FROM sides WHERE adv_3c1 <> filed_3c1 OR adv_3c7 <> filed_3c7"""


@query("de03_vc_exemption_violation", """SELECT crd, adviser_name, sum(n)::BIGINT AS n_funds, string_agg(n || ' ' || fund_type, ', ' ORDER BY n || ' ' || fund_type) AS breakdown, 'critical' AS severity
  FROM advisers JOIN (SELECT adviser_entity_crd AS crd, fund_type, count(*) AS n FROM funds WHERE NOT contains(lower(fund_type), 'venture') GROUP BY ALL) USING (crd)
  WHERE lower(exemption_2b1) IN ('y', 'true') GROUP BY crd, adviser_name""", "advisers", "funds")
def de03(spark, d):
    return core.vc_exemption_violation(table(spark, d, "advisers"), table(spark, d, "funds"))


@query("ag06_issues_by_type_and_severity", None)
def ag06(spark, d):
    rows = matches(spark, d).filter("issues <> ''").select(F.explode(F.split("issues", r" \| ")).alias("issue"), F.when(F.col("overdue_adv_flag"), "high").otherwise("medium").alias("severity"))
    return rows.groupingSets([["issue"], ["severity"]], "issue", "severity").agg(F.count("*").alias("n"))


SQL["ag06_issues_by_type_and_severity"] = with_views("", *_ALL).rstrip() + "," + _XREF + """, rows AS (SELECT unnest(string_split(issues, ' | ')) AS issue, CASE WHEN overdue_adv_flag THEN 'high' ELSE 'medium' END AS severity FROM matches WHERE issues <> '')
SELECT issue, severity, count(*) AS n FROM rows GROUP BY GROUPING SETS ((issue), (severity))"""


@query("sf01_normalized_names", f"SELECT id, {_NORM.format('entityname')} AS name, trim(regexp_replace(regexp_replace(lower(entityname), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'))[1:80] AS slug FROM filings", "filings")
def sf01(spark, d):
    return table(spark, d, "filings").select("id", T.normalised_name(F.col("entityname")).alias("name"), T.slug(F.col("entityname")).alias("slug"))


@query("wn01_latest_per_cik", f"SELECT cik, accessionnumber, filed FROM (SELECT cik, accessionnumber, {_DAY} AS filed, row_number() OVER (PARTITION BY cik ORDER BY {_DAY} DESC, id DESC) AS n FROM filings) WHERE n = 1", "filings")
def wn01(spark, d):
    rows = table(spark, d, "filings").withColumn("filed", T.mixed_date(F.col("filing_date")))
    return core.newest_per(rows, F.col("cik"), F.desc_nulls_last("filed"), F.desc("id")).select("cik", "accessionnumber", "filed")


@query("ag12_values_by_adviser_year", "SELECT adviser_entity_crd AS crd, year, sum(gav::DECIMAL(18,2))::DOUBLE AS value FROM fund_years JOIN funds USING (fund_id) GROUP BY ALL", "funds", "fund_years")
def ag12(spark, d):
    rows = table(spark, d, "fund_years").join(table(spark, d, "funds").select("fund_id", F.col("adviser_entity_crd").alias("crd")), "fund_id")
    return rows.groupBy("crd", "year").agg(F.sum(F.col("gav").cast("decimal(18,2)")).cast("double").alias("value"))


@query("wn05_growth", """, latest AS (SELECT fund_id, max(year) AS y FROM fund_years WHERE gav <> 0 GROUP BY 1)
SELECT l.fund_id, l.y AS latest_year, round((n.gav - a.gav) / a.gav * 100, 4) AS growth_1y, round((n.gav - b.gav) / b.gav * 100, 4) AS growth_2y, round((n.gav - c.gav) / c.gav * 100, 4) AS growth_5y
FROM latest l JOIN fund_years n ON n.fund_id = l.fund_id AND n.year = l.y LEFT JOIN fund_years a ON a.fund_id = l.fund_id AND a.year = l.y - 1
LEFT JOIN fund_years b ON b.fund_id = l.fund_id AND b.year = l.y - 2 LEFT JOIN fund_years c ON c.fund_id = l.fund_id AND c.year = l.y - 5""", "fund_years")
def wn05(spark, d):
    return core.growth(table(spark, d, "fund_years").withColumnRenamed("gav", "value"), "fund_id")


@query("jn27_fund_counts", "SELECT crd, adviser_name, count(fund_id) AS n_funds FROM advisers LEFT JOIN funds ON crd = adviser_entity_crd GROUP BY ALL", "advisers", "funds")
def jn27(spark, d):
    counts = table(spark, d, "funds").groupBy(F.col("adviser_entity_crd").alias("crd")).agg(F.count("*").alias("n"))
    return table(spark, d, "advisers").join(counts, "crd", "left").select("crd", "adviser_name", F.coalesce("n", F.lit(0)).alias("n_funds"))


@query("fl16_boolean_search", "SELECT id, entityname FROM filings WHERE contains(lower(entityname), 'series') AND contains(lower(entityname), 'vehicle 1') AND NOT contains(lower(entityname), 'red')", "filings")
def fl16(spark, d):
    return table(spark, d, "filings").filter(T.boolean_search(F.col("entityname"), '+series "vehicle 1" -red')).select("id", "entityname")


@query("so12_page", "SELECT crd, total_aum FROM advisers ORDER BY total_aum DESC NULLS LAST, crd LIMIT 25 OFFSET 25", "advisers")
def so12(spark, d):
    return table(spark, d, "advisers").orderBy(F.desc_nulls_last("total_aum"), "crd").offset(25).limit(25).select("crd", "total_aum")


@query("wn06_percent_of_total", "SELECT fund_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM funds GROUP BY 1", "funds")
def wn06(spark, d):
    counts = table(spark, d, "funds").groupBy("fund_type").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("ag13_commonest_type", "SELECT cik, investmentfundtype FROM (SELECT cik, investmentfundtype, row_number() OVER (PARTITION BY cik ORDER BY count(*) DESC, investmentfundtype) AS k FROM filings GROUP BY cik, investmentfundtype) WHERE k = 1", "filings")
def ag13(spark, d):
    counts = table(spark, d, "filings").groupBy("cik", "investmentfundtype").agg(F.count("*").alias("n"))
    return core.newest_per(counts, F.col("cik"), F.desc("n"), F.col("investmentfundtype")).select("cik", "investmentfundtype")


@query("ur01_hosts", r"SELECT host, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages) GROUP BY 1")
def ur01(spark, d):
    return table(spark, d, "pages").select(T.hostname(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


@query("ht02_emails", r"SELECT email, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z0-9.-]*[a-z]')) AS email FROM documents) GROUP BY 1")
def ht02(spark, d):
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z0-9.-]*[a-z]"), 0))
    return table(spark, d, "documents").select(F.explode(found).alias("email")).groupBy("email").agg(F.count("*").alias("n"))


@query("sm11_daily_events", "SELECT event_type, ts::DATE AS day, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total, count(*) > 10 AS over_limit FROM events GROUP BY ALL")
def sm11(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).withColumn("over_limit", F.col("n") > 10)


@query("js01_json_path", "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def js01(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("sk04_upsert", "SELECT coalesce(a.crd, b.crd) AS crd, coalesce(b.name, a.name) AS name FROM (SELECT crd, adviser_name AS name FROM advisers WHERE crd % 3 <> 0) a FULL JOIN (SELECT crd, CASE WHEN crd % 4 <> 0 THEN upper(adviser_name) END AS name FROM advisers WHERE crd % 2 = 0) b ON a.crd = b.crd", "advisers")
def sk04(spark, d):
    rows = table(spark, d, "advisers").select("crd", F.col("adviser_name").alias("name"))
    return core.upsert(rows.filter("crd % 3 <> 0"), rows.filter("crd % 2 = 0").withColumn("name", F.expr("CASE WHEN crd % 4 <> 0 THEN upper(name) END")), "crd", ["name"])


@query("dt11_retry_dates", "SELECT o_orderkey, (o_orderdate::DATE + [7, 14, 30, 60, 90][o_orderkey % 7 + 1]::INT)::DATE AS next_retry FROM orders")
def dt11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.retry_date(F.to_date("o_orderdate"), (F.col("o_orderkey") % 7).cast("int")).alias("next_retry"))


@query("jn19_blocked_match")
def jn19(spark, d):
    masters = core.new_managers(table(spark, d, "filings"), BLOCKED).select(F.col("series_master").alias("id"), F.col("series_master").alias("name"))
    return core.blocked_match(masters, table(spark, d, "advisers").select(F.col("crd").alias("key"), F.col("adviser_name").alias("name"))).withColumnRenamed("id", "series_master")
