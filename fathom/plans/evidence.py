"""Registered queries from evidence to public records, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.operators import evidence as E
from fathom.operators.core import newest_per
from fathom.plans.catalog import query
from fathom.plans.gates import _PAGES, _TEAM
from fathom.plans.matching import _MAILS, _SITES, form_sql
from fathom.sources import work
from fathom.sources.views import table

#: When the sources were read, and the day that is asked about.
REGISTER_DAY, LIST_DAY, FOUND_DAY, BACK_DAY, AGAIN_DAY, AS_OF = "2024-01-10", "2024-02-01", "2024-03-01", "2024-04-01", "2024-05-01", "2024-05-15"


def _day(text: str):
    return F.lit(text).cast("timestamp")


def firms(spark, d):
    """Records as firms: their manager's name, the adviser they are linked to, else that of their name, and its site."""
    registry = table(spark, d, "registry").select("crd", "adviser_name", F.col("primary_website").alias("website"), F.col("regulatory_contact_email").alias("cco_email"), "phone_number")
    same = registry.filter("adviser_name <> ''").groupBy(F.lower("adviser_name").alias("key")).agg(F.min("crd").alias("same"))
    name = F.coalesce(F.nullif(T.series_master(F.col("series_master_llc")), F.lit("")), "series_master_llc")
    rows = table(spark, d, "records").select("id", name.alias("name"), F.lower(name).alias("key"), "linked_crd").join(same, "key", "left")
    rows = rows.select("id", "name", F.coalesce("linked_crd", "same").alias("wanted")).join(registry, F.col("wanted") == F.col("crd"), "left")
    return rows.select("id", "name", "crd", "website", "cco_email", "phone_number")


def evidence_log(spark, d):
    """What register, reference, search and sites say of the records; what lists said of each fifth is taken back later, and for each tenth said again."""
    ours, rows = firms(spark, d), table(spark, d, "records")
    register = E.from_register(ours.withColumnRenamed("website", "primary_website"), _day(REGISTER_DAY))
    form = N.normal(F.col("investor_name"), "investor")
    listed = newest_per(table(spark, d, "investors_b").withColumn("form", form).filter("form <> ''"), F.col("form"), F.col("investor_name"), F.col("website_url")).drop("investor_name")
    named = ours.select("id", N.normal(F.col("name"), "investor").alias("form")).join(listed, "form").withColumns({"list": F.lit("list"), "contact_name": F.when(F.col("id") % 3 == 0, "Kim Poe")})
    fifth, tenth = named.filter("id % 5 = 0"), named.filter("id % 10 = 0")
    lists = E.log(E.from_reference(named, _day(LIST_DAY)), E.from_reference(fifth, _day(BACK_DAY)).withColumn("withdrawn", F.lit(True)), E.from_reference(tenth, _day(AGAIN_DAY)))
    search = E.stated(rows, "website_url", F.col("website_url"), F.lit("brave_search"), "website_url", "weak", _day(FOUND_DAY), "search")
    links = F.when(F.col("id") % 2 == 1, "website_links_to_linkedin")
    pages = E.stated(rows, "linkedin_company_url", F.col("linkedin_company_url"), F.lit("website_html"), "linkedin_company_url", "strong", _day(FOUND_DAY), "website", 0, anchor=links)
    mails = E.stated(rows, "primary_contact_email", F.col("primary_contact_email"), F.lit("website_html"), "primary_contact_email", "medium", _day(FOUND_DAY), "website", 1, anchor=F.lit("found_on_candidate_website"))
    people = rows.select("id", F.posexplode(F.from_json("team_members", "array<struct<name: string, title: string>>")).alias("at", "one"))
    people = E.stated(people, "team_member", F.col("one.name"), F.lit("website_html"), "team_members", "medium", _day(FOUND_DAY), "website", F.col("at") + 2, anchor=F.lit("found_on_candidate_website"), title=F.col("one.title"))
    return E.log(register, lists, search, pages, mails, people)


def _investor(c: str) -> str:
    return form_sql(c, "investor")


_MASTER = r"regexp_extract(series_master_llc, '(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$', 1)"
_NOISY = "instagram|facebook|twitter|linkedin|youtube|plynk|apple\\.com|play\\.google"
_LIST = "'external_db:list'"
_LOG = f"""
named AS (SELECT id, coalesce(nullif({_MASTER}, ''), series_master_llc) AS name, linked_crd FROM records),
firms AS (
  SELECT n.id, n.name, r.crd, r.primary_website AS website, r.regulatory_contact_email AS cco, r.phone_number AS phone
  FROM (SELECT *, coalesce(linked_crd, (SELECT min(crd) FROM registry WHERE adviser_name <> '' AND lower(adviser_name) = lower(name))) AS wanted FROM named) n LEFT JOIN registry r ON r.crd = wanted),
listed AS (
  SELECT {_investor('investor_name')} AS form, website_url, primary_contact_email FROM investors_b WHERE {_investor('investor_name')} <> ''
  QUALIFY row_number() OVER (PARTITION BY {_investor('investor_name')} ORDER BY investor_name, website_url NULLS FIRST) = 1),
lists AS (SELECT id, website_url, primary_contact_email, CASE WHEN id % 3 = 0 THEN 'Kim Poe' END AS contact FROM firms JOIN listed ON form = {_investor('name')}),
said AS (
  SELECT id, 'website_url' AS type, website_url AS value, {_LIST} AS source, 'website_url' AS field, 'medium' AS strength, NULL AS anchor, NULL AS title, 1000000 AS place FROM lists
  UNION ALL SELECT id, 'primary_contact_email', primary_contact_email, {_LIST}, 'primary_contact_email', 'medium', NULL, NULL, 1000002 FROM lists
  UNION ALL SELECT id, 'team_member', contact, {_LIST}, 'contact_name', 'weak', NULL, NULL, 1000003 FROM lists),
people AS (
  SELECT id, generate_subscripts(p, 1) - 1 AS k, unnest(p) AS one
  FROM (SELECT id, CAST(json_extract(CASE WHEN json_valid(team_members) THEN team_members ELSE '[]' END, '$[*]') AS JSON[]) AS p FROM records)),
log AS (
  SELECT *, '{LIST_DAY}' AS day, false AS back FROM said
  UNION ALL SELECT *, '{BACK_DAY}', true FROM said WHERE id % 5 = 0
  UNION ALL SELECT *, '{AGAIN_DAY}', false FROM said WHERE id % 10 = 0
  UNION ALL SELECT id, 'website_url', website, 'sec_adv:crd:' || crd, 'primary_website', 'strong', 'sec_adv_crd:' || crd, NULL, 0, '{REGISTER_DAY}', false FROM firms WHERE NOT regexp_matches(lower(website), '{_NOISY}')
  UNION ALL SELECT id, 'primary_contact_email', lower(cco), 'sec_adv:crd:' || crd, 'cco_email', 'strong', 'sec_adv_crd:' || crd, NULL, 1, '{REGISTER_DAY}', false FROM firms
  UNION ALL SELECT id, 'phone_number', phone, 'sec_adv:crd:' || crd, 'phone_number', 'strong', 'sec_adv_crd:' || crd, NULL, 2, '{REGISTER_DAY}', false FROM firms
  UNION ALL SELECT id, 'website_url', website_url, 'brave_search', 'website_url', 'weak', NULL, NULL, 2000000, '{FOUND_DAY}', false FROM records
  UNION ALL SELECT id, 'linkedin_company_url', linkedin_company_url, 'website_html', 'linkedin_company_url', 'strong', CASE WHEN id % 2 = 1 THEN 'website_links_to_linkedin' END, NULL, 3000000, '{FOUND_DAY}', false FROM records
  UNION ALL SELECT id, 'primary_contact_email', primary_contact_email, 'website_html', 'primary_contact_email', 'medium', 'found_on_candidate_website', NULL, 3000001, '{FOUND_DAY}', false FROM records
  UNION ALL SELECT id, 'team_member', one->>'$.name', 'website_html', 'team_members', 'medium', 'found_on_candidate_website', one->>'$.title', 3000002 + k, '{FOUND_DAY}', false FROM people),
backs AS (SELECT id, type, value, source, max(day) AS day FROM log WHERE back GROUP BY ALL),
evidence AS (
  SELECT l.id, l.type, l.value, l.source, arg_max(field, (l.day, place)) AS field, arg_max(strength, (l.day, place)) AS strength, arg_max(anchor, (l.day, place)) AS anchor, arg_max(title, (l.day, place)) AS title, max(place) AS place, min(l.day) AS captured_at
  FROM log l LEFT JOIN backs b ON b.id = l.id AND b.type = l.type AND b.value = l.value AND b.source = l.source
  WHERE NOT back AND l.value <> '' AND (b.day IS NULL OR l.day > b.day) GROUP BY ALL)"""


@query("st07_present_evidence", f", {_LOG} SELECT id, type, value, source, field, strength, anchor, title, captured_at FROM evidence", "records", "registry", "investors_b")
def st07(spark, d):
    """The evidence of all sources that stands."""
    return E.present(evidence_log(spark, d), AS_OF).withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd")).drop("place")


_SOURCE = lambda field: f"(SELECT arg_min(source || ' ' || captured_at, place) FROM evidence e WHERE e.id = firms.id AND e.type = '{field}' AND e.value = s.value)"
_RECORDS = f"""{_LOG}, {_SITES},{_PAGES}, {_MAILS},{_TEAM},
team AS (
  SELECT t.id, count_if(v[1] = 'verified') AS sure, count_if(v[1] = 'candidate') AS maybe,
         string_agg(value || coalesce(' - ' || (SELECT arg_min(struct_pack(t := title), place) FROM evidence e WHERE e.id = t.id AND e.type = 'team_member' AND e.value = t.value).t, ''), '; ' ORDER BY value) FILTER (v[1] = 'verified') AS names
  FROM teamed t GROUP BY t.id),
joined AS (
  SELECT firms.id, crd, s.status AS s, p.status AS p, m.status AS m, coalesce(t.sure, 0) AS sure, coalesce(t.maybe, 0) AS maybe, s.value AS site, p.value AS page, m.value AS mail, s.reason AS why, names,
         {_SOURCE('website_url')} AS website_from
  FROM firms LEFT JOIN sited s ON s.id = firms.id LEFT JOIN paged p ON p.id = firms.id LEFT JOIN mailed m ON m.id = firms.id LEFT JOIN team t ON t.id = firms.id),
counted AS (
  SELECT *, len(list_filter([s, p, m], lambda x: x = 'verified')) + (sure > 0)::INT AS n, len(list_filter([s, p, m], lambda x: x = 'candidate')) + maybe AS maybes, coalesce(s = 'verified' OR p = 'verified', false) AS shown FROM joined)
SELECT id, CASE WHEN n > 0 AND maybes = 0 THEN 'verified' WHEN n > 0 THEN 'partial' WHEN maybes > 0 THEN 'candidates_only' ELSE 'no_data' END AS status,
       CASE WHEN shown THEN 'auto_enriched' WHEN n + maybes > 0 THEN 'candidates_only' ELSE 'no_data_found' END AS legacy_status, n / 4 AS confidence,
       array_to_string(list_filter([CASE WHEN crd IS NOT NULL OR (s = 'verified' AND starts_with(why, 'anchored_by:sec_adv_crd:')) THEN 'sec_adv_crd' END, CASE WHEN p = 'verified' THEN 'linkedin_self' END], lambda x: x IS NOT NULL), ',') AS anchors,
       CASE WHEN shown AND s = 'verified' THEN site END AS website, CASE WHEN shown AND p = 'verified' THEN page END AS linkedin, CASE WHEN shown AND m = 'verified' THEN mail END AS email,
       CASE WHEN shown THEN coalesce(names, '') END AS team, CASE WHEN shown AND s = 'verified' THEN website_from END AS website_from,
       NOT shown AS suppressed, CASE WHEN NOT shown THEN 'no_company_anchor' END AS suppressed_reason
FROM counted"""


@query("ru08_public_records", f", {_RECORDS}", "records", "registry", "investors_b")
def ru08(spark, d):
    """From records, register and reference to what is shown."""
    # both are read by each decision
    now, ours = work.written(E.present(evidence_log(spark, d), AS_OF), "evidence"), work.written(firms(spark, d), "firms")
    return E.records(now, ours).drop("field_evidence")
