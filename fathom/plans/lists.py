"""Registered queries of lists: searches, filters, pages, joins for display and samples, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.operators import listings as L
from fathom.operators.core import newest_per
from fathom.plans.catalog import query
from fathom.plans.matching import form_sql
from fathom.sources.listings import firm
from fathom.sources.views import table


def _has(text: str, *columns: str) -> str:
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), '{text}'), false)" for c in columns) + ")"


def _text(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ")"


_DAY = "coalesce(try_strptime(filing_date, '%Y-%m-%d'), try_strptime(filing_date, '%d-%b-%Y'))::DATE"
_DAY0 = f"coalesce({_DAY}, DATE '1970-01-01')"


def _iso(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ('', '-') THEN coalesce(strftime(coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d-%b-%Y')), '%Y-%m-%d'), {c}) END"


_MASTER = r"regexp_extract({}, '(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$', 1)"
_NUMBER = r"try_cast(nullif(regexp_extract({}, '^\s*([+-]?\d*\.?\d+)', 1), '') AS DOUBLE)"


def _display(c: str) -> str:
    return form_sql(c, "display")


def _investor(c: str) -> str:
    return form_sql(c, "investor")


@query("fl03_adviser_search", f"""SELECT r.crd, adviser_name, total_aum, aum_2025, coalesce(n, 0) AS fund_count FROM (SELECT * FROM registry WHERE {_has('hol', 'adviser_name', 'adviser_entity_legal_name', 'other_business_names')}
  AND type = 'RIA' AND exemption_2b2 = 'Y' AND total_aum >= 100e6 AND total_aum <= 9000e6 ORDER BY aum_2025 DESC NULLS LAST, crd LIMIT 40) r LEFT JOIN (SELECT adviser_entity_crd AS crd, count(*) AS n FROM vehicles GROUP BY 1) v ON r.crd = v.crd""", "registry", "vehicles")
def fl03(spark, d):
    rows = L.search_advisers(table(spark, d, "registry"), table(spark, d, "vehicles"), "hol", "", "RIA", "private_fund", 100, 9000, 40)
    return rows.select("crd", "adviser_name", "total_aum", "aum_2025", "fund_count")


@query("fl10_search_names", f"SELECT crd FROM registry WHERE {_has('holdings', 'adviser_name', 'adviser_entity_legal_name', 'other_business_names')}", "registry")
def fl10(spark, d):
    return L.search_advisers(table(spark, d, "registry"), table(spark, d, "vehicles"), "Holdings", limit=None).select("crd")


@query("fl12_fund_filters", f"""SELECT fund_id FROM vehicles WHERE {_has('capital', 'fund_name', 'adviser_entity_legal_name')} AND coalesce(exclusion_3c1 <> 'Y', true) AND exclusion_3c7 = 'Y'""", "vehicles")
def fl12(spark, d):
    return L.search_funds(table(spark, d, "vehicles"), "capital", "all", "no", "yes").select("fund_id")


@query("fl15_search_scopes", f"""SELECT 'name' AS scope, count(*) AS n FROM vehicles WHERE {_has('ventures', 'fund_name')} UNION ALL SELECT 'adviser', count(*) FROM vehicles WHERE {_has('ventures', 'adviser_entity_legal_name')}
  UNION ALL SELECT 'all', count(*) FROM vehicles WHERE {_has('ventures', 'fund_name', 'adviser_entity_legal_name')} UNION ALL SELECT 'related', 0""", "vehicles")
def fl15(spark, d):
    parts = [L.search_funds(table(spark, d, "vehicles"), "Ventures", s).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n") for s in ("name", "adviser", "all", "related")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("so02_fund_page", """SELECT fund_id, fund_name, latest_gross_asset_value, (SELECT count(*) FROM vehicles) AS total, ((SELECT count(*) FROM vehicles) + 29)::BIGINT // 30 AS total_pages, 3 < ((SELECT count(*) FROM vehicles) + 29) // 30 AS has_more
  FROM vehicles ORDER BY latest_gross_asset_value ASC NULLS LAST, fund_id LIMIT 30 OFFSET 60""", "vehicles")
def so02(spark, d):
    return L.page(table(spark, d, "vehicles"), "fund_id", 3, 30, "latest_gross_asset_value", True).select("fund_id", "fund_name", "latest_gross_asset_value", "total", "total_pages", "has_more")


@query("so12_fund_page_default", """SELECT fund_id, updated_at, (SELECT count(*) FROM vehicles) AS total, ((SELECT count(*) FROM vehicles) + 499)::BIGINT // 500 AS total_pages, 1 < ((SELECT count(*) FROM vehicles) + 499) // 500 AS has_more
  FROM vehicles ORDER BY updated_at DESC NULLS LAST, fund_id LIMIT 500""", "vehicles")
def so12(spark, d):
    return L.page(table(spark, d, "vehicles"), "fund_id", 1, 9999, "no such column").select("fund_id", "updated_at", "total", "total_pages", "has_more")


#: Stored matches of funds and filings; scores below 1 are old guesses.
_STORED = "stored AS (SELECT 'Deal ' || (id % 2000) || ', a series of ' || {firm} AS adv_fund_name, entityname AS formd_entity_name, filing_date AS formd_filing_date, totalofferingamount AS formd_offering_amount, accessionnumber AS formd_accession, CASE WHEN id % 3 = 0 THEN 0.7 ELSE 1.0 END AS match_score FROM notices WHERE id % 2 = 1)".format(firm=firm("id % 2000"))


def stored_matches(spark, d):
    sql = _STORED.removeprefix("stored AS (").removesuffix(")").replace("FROM notices", "FROM {notices}")
    return spark.sql(sql, notices=table(spark, d, "notices"))


@query("jn09_funds_with_filings", f""", {_STORED}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY adv_fund_name ORDER BY match_score DESC, formd_accession) AS k FROM stored WHERE match_score = 1) WHERE k = 1)
SELECT fund_id, formd_entity_name AS form_d_entity_name, formd_accession AS form_d_accession, formd_offering_amount AS form_d_offering_amount, related_names, related_roles, adv_fund_name IS NOT NULL AS has_form_d_match, 'adv' AS source
FROM vehicles LEFT JOIN best ON fund_name = adv_fund_name LEFT JOIN notices ON formd_accession = accessionnumber""", "vehicles", "notices")
def jn09(spark, d):
    rows = L.with_filings(table(spark, d, "vehicles"), stored_matches(spark, d), table(spark, d, "notices"))
    return rows.select("fund_id", "form_d_entity_name", "form_d_accession", "form_d_offering_amount", "related_names", "related_roles", "has_form_d_match", "source")


_SHOWN = ", ".join(f"{c} AS {a}" for a, c in L.SHOWN.items())
_ADDRESS = "array_to_string(list_filter([street1, city, stateorcountry, zipcode], lambda x: x <> ''), ', ') AS form_d_address, 'formd' AS source"


def _filings_sql(where: str, days: str, limit: int | str) -> str:
    return f"SELECT id, {_SHOWN}, {_ADDRESS} FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(cik, ''), nullif(entityname, '')) ORDER BY {_DAY0} DESC, id DESC) AS k FROM (SELECT * FROM notices WHERE {where} ORDER BY id DESC LIMIT {limit}) WHERE {days}) WHERE k = 1"


@query("pj02_filing_list", _filings_sql(_has("series", "entityname", "related_names"), f"{_DAY0} >= DATE '1996-01-01' AND {_DAY0} <= DATE '2000-06-30'", 2000), "notices")
def pj02(spark, d):
    return L.search_filings(table(spark, d, "notices"), "Series", start="1996-01-01", end="2000-06-30", limit=5000)


@query("fl04_filings_between", _filings_sql("true", f"{_DAY0} >= DATE '1996-01-01' AND {_DAY0} <= DATE '1997-06-30'", "ALL"), "notices")
def fl04_between(spark, d):
    """Of all filings, not of the newest few by id."""
    return L.search_filings(table(spark, d, "notices"), start="1996-01-01", end="1997-06-30", limit=None)


@query("wn01_latest_or_named", _filings_sql("stateorcountry = 'CA'", "true", 1000), "notices")
def wn01(spark, d):
    return L.search_filings(table(spark, d, "notices"), state="CA")


@query("wn01_latest_of_all", f"SELECT coalesce(nullif(cik, ''), entityname) AS key, max_by(id, ({_DAY0}, id)) AS id FROM notices GROUP BY 1", "notices")
def wn01_all(spark, d):
    rows = table(spark, d, "notices").withColumn("key", F.coalesce(F.nullif("cik", F.lit("")), "entityname"))
    return rows.groupBy("key").agg(F.max_by("id", F.struct(T.filing_date(F.col("filing_date")), "id")).alias("id"))


_WHO = """list_transform(string_split(coalesce({0}, ''), '|'), lambda x: trim(x))"""
_PROMOTER = f"""p0 AS (SELECT id, {_WHO.format('related_names')} AS n, list_position(list_transform({_WHO.format('related_roles')}, lambda r: contains(lower(r), 'promoter')), true) AS k FROM notices),
p AS (SELECT id, lower(CASE WHEN k > 0 THEN n[k] ELSE n[1] END) AS who FROM p0 WHERE CASE WHEN k > 0 THEN n[k] ELSE n[1] END NOT IN ('', 'N/A') AND NOT regexp_full_match(CASE WHEN k > 0 THEN n[k] ELSE n[1] END, '\\d+'))"""


@query("jn21_promoter_advisers", f""", {_PROMOTER}, a AS (SELECT crd, lower({_text('adviser_name', 'adviser_entity_legal_name')}) AS name FROM registry)
SELECT id, who, crd, name AS adviser FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, crd) AS k FROM p JOIN a ON (contains(who, name) OR contains(name, who)) AND length(who) >= 5 AND length(name) >= 5) WHERE k = 1""", "notices", "registry")
def jn21(spark, d):
    return L.promoter_advisers(table(spark, d, "notices"), table(spark, d, "registry"))


@query("ar04_promoters", f", {_PROMOTER} SELECT id, who FROM p WHERE who IS NOT NULL", "notices")
def ar04(spark, d):
    return table(spark, d, "notices").select("id", F.lower(L.promoter(F.col("related_names"), F.col("related_roles"))).alias("who")).filter("who IS NOT NULL")


_ISSUES = f"""shown AS (SELECT f.id, adviser_crd AS crd, discrepancy_type AS type, severity, status, detected_date,
  coalesce({_text('adviser_name', 'adviser_entity_legal_name', "metadata->>'$.entity_name'", "metadata->>'$.adviser_name'", "metadata->>'$.fund_name'")}, 'Unknown') AS entity_name,
  {_text("metadata->>'$.sample_non_vc_funds[0].name'", "metadata->>'$.primary_fund_name'", "metadata->>'$.adv_fund_name'", "metadata->>'$.fund_name'")} AS fund_name,
  {_text('regulatory_contact_email', "metadata->>'$.contact_email'")} AS email, {_text('phone_number', "metadata->>'$.contact_phone'")} AS phone, primary_website AS website
  FROM findings f LEFT JOIN registry ON crd = adviser_crd WHERE {{}})"""


@query("fl06_issue_list", f""", {_ISSUES.format("status = 'active' AND severity IN ('high', 'critical') AND discrepancy_type IN ('fund_type_mismatch', 'vc_exemption_violation')")} SELECT * FROM shown""", "findings", "registry")
def fl06(spark, d):
    rows = L.listed_issues(table(spark, d, "findings"), table(spark, d, "registry"), "high, critical", "fund_type_mismatch,vc_exemption_violation")
    return rows.select("*", "contact_info.*").drop("contact_info")


@query("fl13_issue_search", f""", {_ISSUES.format("status = 'active' AND " + _has('deal 1', 'description', "metadata->>'$.fund_name'", "metadata->>'$.entity_name'"))} SELECT id, entity_name, fund_name FROM shown""", "findings", "registry")
def fl13(spark, d):
    return L.listed_issues(table(spark, d, "findings"), table(spark, d, "registry"), query="Deal 1").select("id", "entity_name", "fund_name")


@query("so03_issue_order", "SELECT id, severity, detected_date FROM findings WHERE status = 'active' ORDER BY severity DESC, detected_date DESC, id LIMIT 100", "findings")
def so03(spark, d):
    return table(spark, d, "findings").filter("status = 'active'").orderBy(F.desc("severity"), F.desc("detected_date"), "id").limit(100).select("id", "severity", "detected_date")


@query("pj16_issues_as_matches", f""", {_ISSUES.format("true")} SELECT id, coalesce(nullif(fund_name, ''), entity_name) AS adv_fund_name, coalesce(nullif(fund_name, ''), entity_name) AS formd_entity_name, entity_name AS adviser_entity_legal_name, crd AS adviser_entity_crd, type AS issues, type AS discrepancy_type, severity FROM shown""", "findings", "registry")
def pj16(spark, d):
    return L.as_matches(L.listed_issues(table(spark, d, "findings"), table(spark, d, "registry"), status=""))


_MULTI = """multi AS (SELECT manager_key AS id, display_name, coalesce(try_cast(num_platforms AS INT), 0) AS num_platforms, array_to_string(list_filter(string_split(coalesce(platforms_used, ''), ', '), lambda x: x <> ''), '|') AS platforms, coalesce(try_cast(num_filings AS INT), 0) AS num_filings,
  nullif(ia_firm_name, '') AS ia_firm_name, array_to_string(string_split(coalesce(sample_entities, ''), ' | ')[1:3], '|') AS sample_entities, CASE WHEN json_valid(replace(team_members, '''', '"')) THEN array_to_string((replace(team_members, '''', '"')::JSON)->>'$[*].name', '|') ELSE '' END AS team FROM platform_managers WHERE {})"""


def _flat(rows):
    return rows.select("id", "display_name", "num_platforms", F.array_join("platforms", "|").alias("platforms"), "num_filings", "ia_firm_name", F.array_join("sample_entities", "|").alias("sample_entities"), F.array_join("team", "|").alias("team"))


@query("fl18_platform_managers", f""", {_MULTI.format("display_name <> '' AND try_cast(num_platforms AS INT) >= 2 AND (" + _has('carta', 'platforms_used') + " OR " + _has('sydecar', 'platforms_used') + ")")} SELECT * FROM multi""", "platform_managers")
def fl18(spark, d):
    return _flat(L.platform_managers(table(spark, d, "platform_managers"), platforms="Carta, sydecar"))


@query("fl20_platform_manager_search", f""", {_MULTI.format("display_name <> '' AND " + _has('deal', 'display_name', 'ia_firm_name', 'sample_entities'))} SELECT * FROM multi""", "platform_managers")
def fl20(spark, d):
    return _flat(L.platform_managers(table(spark, d, "platform_managers"), "Deal", least=1))


@query("so05_most_filings", f""", {_MULTI.format("display_name <> ''")} SELECT id, num_filings FROM multi ORDER BY num_filings DESC, id LIMIT 50""", "platform_managers")
def so05(spark, d):
    return L.platform_managers(table(spark, d, "platform_managers"), least=1).orderBy(F.desc("num_filings"), "id").limit(50).select("id", "num_filings")


@query("ag11_platforms", "SELECT DISTINCT trim(p) AS platform FROM (SELECT unnest(string_split(coalesce(platforms_used, ''), ', ')) AS p FROM platform_managers) WHERE trim(p) <> ''", "platform_managers")
def ag11(spark, d):
    return table(spark, d, "platform_managers").select(F.explode(F.split("platforms_used", ", ")).alias("platform")).select(F.trim("platform").alias("platform")).filter("platform <> ''").distinct()


@query("jn26_unified", f""", r AS (SELECT *, row_number() OVER (PARTITION BY coalesce('c' || linked_crd, 'r' || id) ORDER BY id) AS k FROM records),
b AS (SELECT a.*, r.id AS record_id, r.linked_crd, r.series_master_llc, r.website_url, r.fund_type AS rf, coalesce(total_aum <> 0, false) OR coalesce(aum_2023 <> 0, false) OR coalesce(aum_2024 <> 0, false) OR coalesce(aum_2025 <> 0, false) AS act FROM registry a FULL JOIN (SELECT * FROM r WHERE k = 1) r ON a.crd = r.linked_crd)
SELECT coalesce(crd, linked_crd) AS crd, record_id, {_text('adviser_name', 'adviser_entity_legal_name', 'series_master_llc')} AS name, {_text('website_url', 'primary_website')} AS website, crd IS NOT NULL AND act AS has_form_adv, crd IS NOT NULL AND NOT act AS is_adviser_defunct, record_id IS NOT NULL AS has_enriched_data, total_aum AS aum, rf AS fund_type FROM b""", "registry", "records")
def jn26(spark, d):
    return L.unified(table(spark, d, "registry"), table(spark, d, "records"))


@query("sc08_one_adviser", "SELECT crd, adviser_name FROM registry WHERE crd = 3", "registry")
def sc08(spark, d):
    return L.exactly_one(table(spark, d, "registry").filter("crd = 3")).select("crd", "adviser_name")


@query("sc09_first_match", "SELECT fund_id, fund_name FROM vehicles WHERE adviser_entity_crd = 7 ORDER BY fund_id LIMIT 1", "vehicles")
def sc09(spark, d):
    return L.first_of(table(spark, d, "vehicles").filter("adviser_entity_crd = 7"), F.col("fund_id")).select("fund_id", "fund_name")


_DUE = "2024-05-01T00:00:00Z"


@query("sc07_due_for_retry", f"SELECT id, next_retry_at, retry_count FROM records WHERE next_retry_at <= '{_DUE}' ORDER BY next_retry_at, id LIMIT 200", "records")
def sc07(spark, d):
    return table(spark, d, "records").filter(F.col("next_retry_at") <= _DUE).orderBy("next_retry_at", "id").limit(200).select("id", "next_retry_at", "retry_count")


_ROLLED = f"""m0 AS (SELECT id, trim({_MASTER.format('entityname')}) AS series_master, {_DAY0} AS day, coalesce({_NUMBER.format('totalofferingamount')}, 0)::DECIMAL(20,2) AS amount, related_names FROM notices WHERE industrygrouptype = 'Pooled Investment Fund' AND isamendment <> 'true'),
rolled AS (SELECT series_master, count(*) AS fund_count, sum(amount)::DOUBLE AS total_offering_amount, min(day) AS first_filing, arg_min(coalesce(related_names, ''), (-date_diff('day', DATE '1970-01-01', day), id)) AS related_names FROM m0 WHERE series_master <> '' AND NOT regexp_matches(lower(series_master), '{"|".join(L.UMBRELLAS)}') GROUP BY 1)"""
_KEPT = f"""keys AS (SELECT lower(series_master_llc) AS key, 0 AS prio, -id AS o, id FROM records WHERE series_master_llc <> '' UNION ALL SELECT lower({_MASTER.format('series_master_llc')}), 1, id, id FROM records WHERE {_MASTER.format('series_master_llc')} <> ''),
kept AS (SELECT key, arg_min(id, (prio, o)) AS record_id FROM keys GROUP BY key)"""


@query("ag02_managers_of_pools", f", {_ROLLED} SELECT series_master, fund_count, total_offering_amount, first_filing FROM rolled", "notices")
def ag02(spark, d):
    return L.managers_of(table(spark, d, "notices")).drop("related_names")


@query("jn18_looked_into", f""", {_ROLLED}, {_KEPT} SELECT series_master, record_id FROM rolled LEFT JOIN kept ON lower(series_master) = key""", "notices", "records")
def jn18(spark, d):
    return L.looked_into(L.managers_of(table(spark, d, "notices")), table(spark, d, "records")).select("series_master", F.col("record.id").alias("record_id"))


def investors_of(spark, d):
    """Investors by exact investor form of the manager's name."""
    known = table(spark, d, "investors_b").withColumn("key", N.normal(F.col("investor_name"), "investor")).filter("key <> ''")
    known = newest_per(known, F.col("key"), F.col("investor_name"), F.col("website_url")).select("key", F.col("website_url").alias("investor_url"), F.col("primary_contact_email").alias("investor_mail"), F.lit("Fund of a list").alias("investor_type"))
    asked = L.managers_of(table(spark, d, "notices")).select("series_master", N.normal(F.col("series_master"), "investor").alias("key"))
    return asked.join(known, "key").drop("key")


@query("pj15_new_managers", f""", {_ROLLED}, {_KEPT}, inv AS (SELECT * FROM (SELECT *, {_investor('investor_name')} AS key, row_number() OVER (PARTITION BY {_investor('investor_name')} ORDER BY investor_name, website_url NULLS FIRST) AS k FROM investors_b) WHERE k = 1 AND key <> ''),
j AS (SELECT r.*, c.id AS record_id, c.website_url AS w, c.primary_contact_email AS e, c.fund_type AS t, i.website_url AS iw, i.primary_contact_email AS ie, i.key IS NOT NULL AS ext, c.id IS NOT NULL AND {_text('c.website_url', 'c.linkedin_company_url')} IS NULL AS hidden
  FROM rolled r LEFT JOIN kept ON lower(series_master) = kept.key LEFT JOIN records c ON c.id = record_id LEFT JOIN inv i ON i.key = {_investor('series_master')})
SELECT series_master, fund_count, total_offering_amount, first_filing, record_id, CASE WHEN hidden THEN nullif(w, '') ELSE {_text('w', 'iw')} END AS website, CASE WHEN hidden THEN nullif(e, '') ELSE {_text('e', 'ie')} END AS email, coalesce(nullif(t, ''), CASE WHEN ext THEN 'Fund of a list' END) AS fund_type, hidden AS suppressed, ext AS has_external_db FROM j""", "notices", "records", "investors_b")
def pj15(spark, d):
    return L.merged(L.looked_into(L.managers_of(table(spark, d, "notices")), table(spark, d, "records")), investors_of(spark, d))


_SHORTER, _LONGER = "least(length({a}), length({b}))", "greatest(length({a}), length({b}))"
#: hamming wants texts of one length
_POSITIONAL = f"({_SHORTER} - hamming(left({{a}}, {_SHORTER}), left({{b}}, {_SHORTER})))::DOUBLE / {_LONGER}"
_NAMED = f"""
fa AS (SELECT fund_id, lower(trim(fund_name)) AS key, {_display('fund_name')} AS s FROM vehicles WHERE fund_name <> ''),
fb AS (SELECT id, lower(trim(entityname)) AS key, {_display('entityname')} AS s FROM notices WHERE entityname <> ''),
sure AS (
  SELECT fund_id, max(fb.id) AS id, 0 AS how, 1.0::DOUBLE AS score FROM fa JOIN fb USING (key) GROUP BY fund_id
  UNION ALL SELECT fund_id, min(fb.id), 1, 1.0 FROM fa JOIN fb USING (s) GROUP BY fund_id),
da AS (SELECT DISTINCT s, length(s) AS n FROM fa WHERE fund_id NOT IN (SELECT fund_id FROM sure) AND s <> ''), db AS (SELECT s, min(id) AS id, length(s) AS n FROM fb WHERE s <> '' GROUP BY s),
nr AS (
  SELECT da.s, db.id, {_POSITIONAL.format(a='da.s', b='db.s')} AS score
  FROM da JOIN db ON least(da.n, db.n)::DOUBLE / greatest(da.n, db.n) >= 0.9 AND {_POSITIONAL.format(a='da.s', b='db.s')} >= 0.9),
hits AS (SELECT * FROM sure UNION ALL SELECT fund_id, id, 2, score FROM fa JOIN nr USING (s)),
named AS (SELECT fund_id, id, how, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY how, score DESC, id) AS k FROM hits) WHERE k = 1)"""


def named(spark, d):
    return L.best_named(table(spark, d, "vehicles"), table(spark, d, "notices"))


@query("jn23_best_named", f", {_NAMED} SELECT * FROM named", "vehicles", "notices")
def jn23(spark, d):
    return named(spark, d)


_COMBINED = f"""fs AS (SELECT id, entityname, totalofferingamount, investmentfundtype, {_iso('filing_date')} AS filed FROM notices),
al AS (SELECT fund_name, 'adv' AS source, fund_type, investmentfundtype AS investment_fund_type, totalofferingamount AS form_d_offering_amount, fs.id IS NOT NULL AS has_form_d_match, coalesce({_iso('updated_at')}, filed) AS sort_date, v.fund_id AS o FROM vehicles v LEFT JOIN named USING (fund_id) LEFT JOIN fs ON fs.id = named.id
  UNION ALL SELECT entityname, 'formd', NULL, investmentfundtype, totalofferingamount, true, filed, id FROM fs WHERE entityname <> '' AND id NOT IN (SELECT id FROM named)),
combined AS (SELECT * EXCLUDE (o, key, k) FROM (SELECT *, {_display("coalesce(fund_name, '')")} AS key, row_number() OVER (PARTITION BY {_display("coalesce(fund_name, '')")} ORDER BY source = 'adv' DESC, (source = 'adv' AND has_form_d_match) DESC, o) AS k FROM al) WHERE k = 1 AND key <> '')"""


def combined(spark, d):
    return L.combined(table(spark, d, "vehicles"), named(spark, d), table(spark, d, "notices"))


@query("wn02_best_of_each_name", f", {_NAMED}, {_COMBINED} SELECT * FROM combined", "vehicles", "notices")
def wn02(spark, d):
    return combined(spark, d)


_AMOUNT = _NUMBER.format("regexp_replace(form_d_offering_amount, '[$,]', '', 'g')")


@query("fl22_narrowed_funds", f", {_NAMED}, {_COMBINED} SELECT fund_name, source, sort_date FROM combined WHERE {_has('hedge fund', 'investment_fund_type', 'fund_type')} AND sort_date >= '1990-01-01' AND sort_date <= '2024-12-31'", "vehicles", "notices")
def fl22(spark, d):
    return L.narrowed(combined(spark, d), "hedge", start="1990-01-01", end="2024-12-31").select("fund_name", "source", "sort_date")


@query("fl23_amount_range", f", {_NAMED}, {_COMBINED} SELECT fund_name, form_d_offering_amount FROM combined WHERE nullif({_AMOUNT}, 0) >= 1000 AND nullif({_AMOUNT}, 0) <= 900000", "vehicles", "notices")
def fl23(spark, d):
    return L.narrowed(combined(spark, d), least=1000, most=900000).select("fund_name", "form_d_offering_amount")


@query("so06_blanks_last", f"SELECT id, totalofferingamount FROM notices ORDER BY nullif({_NUMBER.format('''regexp_replace(totalofferingamount, '[$,]', '', 'g')''')}, 0) ASC NULLS LAST, id LIMIT 60", "notices")
def so06(spark, d):
    return table(spark, d, "notices").orderBy(F.asc_nulls_last(F.nullif(T.amount(F.col("totalofferingamount")), F.lit(0.0))), "id").limit(60).select("id", "totalofferingamount")


@query("so10_published_first", "SELECT id, is_published FROM records ORDER BY is_published DESC, id LIMIT 60", "records")
def so10(spark, d):
    return table(spark, d, "records").orderBy(F.desc("is_published"), "id").limit(60).select("id", "is_published")


@query("so15_largest", f"SELECT series_master, total_offering_amount FROM ({'WITH ' + _ROLLED} SELECT * FROM rolled) ORDER BY total_offering_amount DESC, series_master LIMIT 200", "notices")
def so15(spark, d):
    return L.managers_of(table(spark, d, "notices")).orderBy(F.desc("total_offering_amount"), "series_master").limit(200).select("series_master", "total_offering_amount")


@query("so17_sample", "SELECT id FROM notices ORDER BY md5(id || '-7'), id LIMIT 50", "notices")
def so17(spark, d):
    return L.sample(table(spark, d, "notices"), "id", 50, 7).select("id")


@query("so18_strided_sample", "SELECT id FROM notices ORDER BY (id * 37) % (SELECT count(*) FROM notices), id LIMIT 40", "notices")
def so18(spark, d):
    return L.strided(table(spark, d, "notices"), "id", 40).select("id")


@query("fl08_prefix", "SELECT crd FROM registry WHERE starts_with(lower(adviser_name), 'alc')", "registry")
def fl08(spark, d):
    return table(spark, d, "registry").filter(L.starts("ALC", "adviser_name")).select("crd")


@query("fl09_words_in_order", "SELECT id FROM notices WHERE entityname ILIKE '%deal%series%capital%'", "notices")
def fl09(spark, d):
    return table(spark, d, "notices").filter(L.in_order("deal series capital", "entityname")).select("id")


@query("fl21_linked", "SELECT linked_crd IS NOT NULL AS linked, count(*) AS n, count_if(website_url IS NOT NULL AND website_url <> '') AS with_site FROM records GROUP BY 1", "records")
def fl21(spark, d):
    there = F.col("website_url").isNotNull() & (F.col("website_url") != "")
    return table(spark, d, "records").groupBy(F.col("linked_crd").isNotNull().alias("linked")).agg(F.count("*").alias("n"), F.count_if(there).alias("with_site"))


@query("jn25_merged_references", f""", ra AS (SELECT * FROM (SELECT *, {_investor('investor_name')} AS key, row_number() OVER (PARTITION BY {_investor('investor_name')} ORDER BY investor_name, website_url NULLS FIRST) AS k FROM investors_b) WHERE k = 1 AND key <> ''),
rb AS (SELECT * FROM (SELECT *, {_investor('investor_name')} AS key, row_number() OVER (PARTITION BY {_investor('investor_name')} ORDER BY investor_name, website_url NULLS FIRST) AS k FROM investors_a) WHERE k = 1 AND key <> '')
SELECT coalesce(ra.key, rb.key) AS key, coalesce(ra.investor_name, rb.investor_name) AS investor_name, {_text('ra.website_url', 'rb.website_url')} AS website_url, ra.primary_contact_email, try_cast(nullif(regexp_extract(regexp_replace(check_min, '[$,\\s]', '', 'g'), '^([+-]?\\d+)', 1), '') AS BIGINT) AS check_min,
  CASE WHEN ra.key IS NOT NULL AND rb.key IS NOT NULL THEN 'merged' WHEN ra.key IS NOT NULL THEN 'contacts' ELSE 'terms' END AS source FROM ra FULL JOIN rb ON ra.key = rb.key""", "investors_a", "investors_b")
def jn25(spark, d):
    return L.merged_references(table(spark, d, "investors_b"), table(spark, d, "investors_a"))

