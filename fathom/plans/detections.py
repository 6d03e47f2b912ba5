"""Registered queries of the detectors, formats and similarities, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import formats, similar
from fathom.functions import text as T
from fathom.operators import core, detectors
from fathom.plans.catalog import _ALL, _DAY, _NORM, _XREF, BLOCKED, DUE, SQL, matches, query
from fathom.sources.views import table, with_views

_BASE = with_views("", *_ALL).rstrip() + "," + _XREF


def _family(c: str) -> str:
    rules = (("pe", "private equity|privateequity|pe fund"), ("vc", "venture|vc fund"), ("hedge", "hedge fund|hedgefund"), ("re", "real estate|realestate|re fund"))
    return "[" + ", ".join(f"CASE WHEN lower({c}) = '{k}' OR regexp_matches(lower({c}), '{p}') THEN '{k}' END" for k, p in rules) + "]"


def _standard(c: str) -> str:
    return f"CASE WHEN lower({c}) LIKE '%venture%' THEN 'Venture Capital' WHEN lower({c}) LIKE '%private equity%' OR lower({c}) LIKE '%buyout%' THEN 'Private Equity' WHEN lower({c}) LIKE '%hedge%' THEN 'Hedge Fund' WHEN lower({c}) LIKE '%real estate%' THEN 'Real Estate' WHEN lower({c}) LIKE '%securitized%' THEN 'Securitized Asset' WHEN lower({c}) LIKE '%other%' THEN 'Other' ELSE {c} END"


_OVERDUE = f"""late AS (SELECT adviser_entity_crd AS crd, max(latest_adv_year) AS latest_year FROM matches WHERE adviser_entity_crd IS NOT NULL GROUP BY 1 HAVING max(latest_adv_year) < {DUE + 1}),
overdue AS (SELECT crd, latest_year, count_if(year({_DAY}) > latest_year)::BIGINT AS n_later, 'high' AS severity FROM late JOIN matches m ON m.adviser_entity_crd = crd JOIN filings USING (accessionnumber) GROUP BY 1, 2)"""
_KINDS = f"""kinds AS (SELECT fund_id, accessionnumber, {_standard('fund_type')} AS adv_type, {_standard('investmentfundtype')} AS filed_type, 'medium' AS severity
FROM matches WHERE fund_type <> '' AND investmentfundtype <> '' AND NOT list_has_any(list_filter({_family('fund_type')}, lambda x: x IS NOT NULL), list_filter({_family('investmentfundtype')}, lambda x: x IS NOT NULL)) AND lower(trim(fund_type)) <> lower(trim(investmentfundtype)))"""
_MISSING = f"""missing AS (SELECT accessionnumber, min(adviser_entity_crd) AS crd, 'medium' AS severity FROM numbers JOIN funds USING (fund_id) JOIN filings ON trim(raw) = file_num
WHERE adviser_entity_crd IS NOT NULL AND year({_DAY}) < {DUE} AND accessionnumber NOT IN (SELECT accessionnumber FROM matches) GROUP BY 1)"""


@query("de02_overdue_amendments")
def de02(spark, d):
    return detectors.overdue_amendments(matches(spark, d), table(spark, d, "filings"), DUE + 1)


@query("de04_fund_type_mismatch")
def de04(spark, d):
    return detectors.fund_type_mismatch(matches(spark, d))


@query("de05_missing_funds")
def de05(spark, d):
    return detectors.missing_funds(table(spark, d, "funds"), table(spark, d, "filings"), matches(spark, d), DUE)


@query("de08_all_issues")
def de08(spark, d):
    return detectors.all_issues(overdue=(de02(spark, d), "crd"), fund_type=(de04(spark, d), "accessionnumber"), missing_fund=(de05(spark, d), "accessionnumber"))


SQL["de02_overdue_amendments"] = f"{_BASE}, {_OVERDUE} SELECT * FROM overdue"
SQL["de04_fund_type_mismatch"] = f"{_BASE}, {_KINDS} SELECT * FROM kinds"
SQL["de05_missing_funds"] = f"{_BASE}, {_MISSING} SELECT * FROM missing"
SQL["de08_all_issues"] = f"""{_BASE}, {_OVERDUE}, {_KINDS}, {_MISSING}
SELECT 'overdue' AS issue_type, crd::VARCHAR AS subject, severity, 1 AS rank FROM overdue UNION ALL SELECT 'fund_type', accessionnumber, severity, 2 FROM kinds UNION ALL SELECT 'missing_fund', accessionnumber, severity, 2 FROM missing"""


@query("de01_needs_registration")
def de01(spark, d):
    return detectors.needs_registration(table(spark, d, "filings"), matches(spark, d), table(spark, d, "advisers"), BLOCKED, "1998-06-30")


@query("si02_edit_similarity")
def si02(spark, d):
    names = matches(spark, d).select("fund_id", "accessionnumber").join(table(spark, d, "funds").select("fund_id", "fund_name"), "fund_id").join(table(spark, d, "filings").select("accessionnumber", "entityname"), "accessionnumber")
    return names.select("fund_id", F.round(similar.edit_similarity(F.col("fund_name"), F.col("entityname")), 6).alias("similarity"), F.round(similar.jaro_winkler("fund_name", "entityname"), 6).alias("jaro_winkler"))


_SAME = "CASE WHEN a[1:1] <> b[1:1] THEN 0 WHEN a[1:2] <> b[1:2] THEN 1 WHEN a[1:3] <> b[1:3] THEN 2 WHEN a[1:4] <> b[1:4] THEN 3 ELSE 4 END"
SQL["si02_edit_similarity"] = f"""{_BASE}, names AS (SELECT fund_id, fund_name AS f, entityname AS e, lower(fund_name) AS a, lower(entityname) AS b FROM matches JOIN funds USING (fund_id) JOIN filings USING (accessionnumber))
SELECT fund_id, round((greatest(length(f), length(e)) - levenshtein(f, e)) / greatest(length(f), length(e)), 6) AS similarity,
  round(jaro_similarity(a, b) + ({_SAME}) * 0.1 * (1 - jaro_similarity(a, b)), 6) AS jaro_winkler FROM names"""


@query("sf22_currency", "SELECT crd, CASE WHEN total_aum IS NULL OR total_aum = 0 THEN 'N/A' WHEN total_aum >= 1e12 THEN printf('$%.1fT', total_aum / 1e12) WHEN total_aum >= 1e9 THEN printf('$%.1fB', total_aum / 1e9) WHEN total_aum >= 1e6 THEN printf('$%.1fM', total_aum / 1e6) WHEN total_aum >= 1e3 THEN printf('$%.0fK', total_aum / 1e3) ELSE printf('$%.0f', total_aum) END AS aum FROM advisers", "advisers")
def sf22(spark, d):
    return table(spark, d, "advisers").select("crd", formats.currency(F.col("total_aum").cast("decimal(24,2)")).alias("aum"))


_PHONE = "CASE c_custkey % 4 WHEN 0 THEN '555-' || lpad(CAST(c_custkey AS {0}), 7, '0') WHEN 1 THEN '1 (555) ' || lpad(CAST(c_custkey AS {0}), 7, '0') WHEN 2 THEN '44 20 555 ' || lpad(CAST(c_custkey AS {0}), 7, '0') ELSE '12-' || lpad(CAST(c_custkey AS {0}), 4, '0') END"


@query("sf21_phones", f"""WITH p AS (SELECT c_custkey, {_PHONE.format('VARCHAR')} AS raw FROM customer), n AS (SELECT *, regexp_replace(raw, '[^0-9+]', '', 'g') AS g FROM p)
SELECT c_custkey, CASE WHEN length(g) < 7 THEN raw WHEN length(g) = 10 THEN '(' || g[1:3] || ') ' || g[4:6] || '-' || g[7:] WHEN length(g) = 11 AND g[1] = '1' THEN '+1 (' || g[2:4] || ') ' || g[5:7] || '-' || g[8:]
  WHEN length(g) > 10 THEN '+' || g[:length(g) - 10] || ' ' || g[length(g) - 9:length(g) - 7] || ' ' || g[length(g) - 6:length(g) - 4] || ' ' || g[length(g) - 3:] ELSE raw END AS phone FROM n""")
def sf21(spark, d):
    return table(spark, d, "customer").select("c_custkey", formats.phone(F.expr(_PHONE.format("STRING"))).alias("phone"))


@query("sf25_standard_types", f"SELECT id, {_standard('investmentfundtype')} AS kind FROM filings", "filings")
def sf25(spark, d):
    return table(spark, d, "filings").select("id", formats.standard_type(F.col("investmentfundtype")).alias("kind"))


@query("jn20_prefix_lookup", f""", n AS (SELECT id, string_split({_NORM.format("regexp_extract(entityname, '(?i),?\\s+a\\s+series\\s+of\\s+(.+?)\\s*,?\\s*$', 1)")}, ' ') AS w FROM filings),
p AS (SELECT id, array_to_string(w[1:k], ' ') AS key FROM (SELECT id, w, unnest(range(least(2, len(w)), len(w) + 1)) AS k FROM n WHERE length(array_to_string(w, ' ')) >= 5))
SELECT id, max_by(key, length(key)) AS key FROM p WHERE key IN (SELECT upper(p_name) FROM part) GROUP BY id""", "filings")
def jn20(spark, d):
    names = table(spark, d, "filings").select("id", T.series_master(F.col("entityname")).alias("name")).filter("name IS NOT NULL")
    return detectors.prefix_lookup(names, table(spark, d, "part").select(T.normalised_name(F.col("p_name")).alias("key")))


_OLD = "SELECT crd, CASE crd % 5 WHEN 0 THEN 'manually_verified' WHEN 1 THEN 'auto_enriched' WHEN 2 THEN 'auto_enriched' ELSE 'no_data_found' END AS status, CASE WHEN crd % 2 = 0 THEN adviser_name ELSE '' END AS site FROM advisers WHERE crd % 7 <> 6"
_NEW = "SELECT crd, 'auto_enriched' AS status, CASE WHEN crd % 3 <> 0 THEN upper(adviser_name) END AS site FROM advisers WHERE crd % 4 <> 3"


@query("sk07_preserving_merge", f""", a AS ({_OLD}), b AS ({_NEW})
SELECT coalesce(a.crd, b.crd) AS crd, CASE WHEN b.crd IS NULL OR a.status = 'manually_verified' OR a.status = 'auto_enriched' AND coalesce(b.status, '') = '' THEN a.status WHEN a.status = 'auto_enriched' THEN a.status ELSE b.status END AS status,
  CASE WHEN b.crd IS NULL OR a.status = 'manually_verified' THEN a.site WHEN a.status = 'auto_enriched' AND (a.site <> '' OR coalesce(b.site, '') = '') THEN a.site ELSE b.site END AS site FROM a FULL JOIN b ON a.crd = b.crd""", "advisers")
def sk07(spark, d):
    rows = table(spark, d, "advisers")
    old, new = (spark.sql(q.replace("FROM advisers", "FROM {rows}"), rows=rows) for q in (_OLD, _NEW))
    return detectors.preserving_merge(old, new, "crd", "status", ["site"])


@query("ma05_confidence", "SELECT c_custkey, confidence, CASE WHEN confidence >= 0.7 THEN 'auto_enriched' WHEN confidence >= 0.4 THEN 'needs_manual_review' ELSE 'no_data_found' END AS status FROM (SELECT c_custkey, ((c_custkey % 2 = 0)::INT * 35 + (c_custkey % 3 = 0)::INT * 20 + (c_custkey % 5 = 0)::INT * 15 + (c_custkey % 4 = 0)::INT * 10) / 100.0::DOUBLE AS confidence FROM customer)")
def ma05(spark, d):
    by = lambda n: F.col("c_custkey") % n == 0
    rows = table(spark, d, "customer").select("c_custkey", formats.confidence(website_url=by(2), linkedin_company_url=by(3), primary_contact_email=by(5), team=by(4)).alias("confidence"))
    return rows.withColumn("status", formats.status_of(F.col("confidence")))


@query("wn07_top_five", "SELECT cik, string_agg(accessionnumber, ',' ORDER BY amount DESC, id) AS largest FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY amount DESC, id) AS n FROM filings) WHERE n <= 5 GROUP BY cik", "filings")
def wn07(spark, d):
    ranked = table(spark, d, "filings").withColumn("n", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("amount"), "id"))).filter("n <= 5")
    return ranked.groupBy("cik").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "accessionnumber"))), lambda x: x["accessionnumber"]), ",").alias("largest"))


@query("ag04_counts_by_status", "SELECT count_if(isamendment = 'true') AS amendments, count_if(isamendment = 'false') AS originals, count_if(isamendment IS NULL) AS unknown FROM filings", "filings")
def ag04(spark, d):
    flag = F.col("isamendment")
    return table(spark, d, "filings").agg(F.count_if(flag == "true").alias("amendments"), F.count_if(flag == "false").alias("originals"), F.count_if(flag.isNull()).alias("unknown"))


@query("ag17_filings_per_cik", f"SELECT cik, count(*) AS n, min({_DAY}) AS first_filing, max({_DAY}) AS last_filing, max_by(accessionnumber, id) AS last_accession, count(DISTINCT investmentfundtype) AS n_types, sum(amount::DECIMAL(18,2))::DOUBLE AS total FROM filings GROUP BY 1", "filings")
def ag17(spark, d):
    day = T.mixed_date(F.col("filing_date"))
    return table(spark, d, "filings").groupBy("cik").agg(F.count("*").alias("n"), F.min(day).alias("first_filing"), F.max(day).alias("last_filing"), F.max_by("accessionnumber", "id").alias("last_accession"), F.count_distinct("investmentfundtype").alias("n_types"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


@query("fl26_date_window", f"SELECT id, {_DAY} AS filed, date_diff('day', {_DAY}, DATE '1998-06-30') AS age FROM filings WHERE {_DAY} BETWEEN DATE '1998-01-01' AND DATE '1998-04-30' AND isamendment <> 'true'", "filings")
def fl26(spark, d):
    rows = table(spark, d, "filings").filter("isamendment <> 'true'").select("id", T.mixed_date(F.col("filing_date")).alias("filed"))
    return rows.filter(F.col("filed").between("1998-01-01", "1998-04-30")).withColumn("age", F.date_diff(F.lit("1998-06-30").cast("date"), "filed").cast("long"))


@query("st01_priority_union", "SELECT crd, min_by(origin, place) AS origin FROM (SELECT crd, 'exempt' AS origin, 1 AS place FROM advisers WHERE lower(exemption_2b1) IN ('y', 'true') UNION ALL SELECT adviser_entity_crd, 'funds', 2 FROM funds) GROUP BY crd", "advisers", "funds")
def st01(spark, d):
    exempt = table(spark, d, "advisers").filter(T.is_yes(F.col("exemption_2b1"))).select("crd", F.lit("exempt").alias("origin"), F.lit(1).alias("place"))
    owners = table(spark, d, "funds").select(F.col("adviser_entity_crd").alias("crd"), F.lit("funds").alias("origin"), F.lit(2).alias("place"))
    return exempt.unionByName(owners).groupBy("crd").agg(F.min_by("origin", "place").alias("origin"))
