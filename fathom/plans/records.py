"""Registered queries of writes to records, exports, work lists and groups of them, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.functions import web
from fathom.operators import listings as L
from fathom.operators import records as W
from fathom.plans.catalog import query
from fathom.plans.lists import _DAY0, _MASTER, _NUMBER, _ROLLED, _has, _text
from fathom.plans.matching import form_sql
from fathom.sources.views import table

NOW = "2024-06-30"


def rows_of(spark, d, sql: str, name: str):
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, d, name)})


_CHANGES = "SELECT id, CASE WHEN id % 2 = 0 THEN 'https://new.example/' || id END AS website_url, 'Seed' AS investment_stage FROM records WHERE id % 5 = 0"


@query("sk05_updated", f", c AS ({_CHANGES}) SELECT r.id, coalesce(c.website_url, r.website_url) AS website_url, coalesce(c.investment_stage, r.investment_stage) AS investment_stage, fund_type FROM records r LEFT JOIN c USING (id)", "records")
def sk05(spark, d):
    return W.updated(table(spark, d, "records"), rows_of(spark, d, _CHANGES, "records"), "id").select("id", "website_url", "investment_stage", "fund_type")


_ACTIONS = "SELECT id, CASE WHEN id % 3 = 0 THEN 'publish' ELSE 'skip' END AS action, CASE WHEN id % 4 = 0 THEN 'a shop' ELSE '' END AS reason FROM records WHERE id % 7 < 3"


@query("sk06_reviewed", f""", a AS ({_ACTIONS}) SELECT id, CASE action WHEN 'publish' THEN true WHEN 'skip' THEN false ELSE is_published END AS is_published, CASE action WHEN 'publish' THEN 'manually_verified' WHEN 'skip' THEN 'not_a_fund' ELSE enrichment_status END AS enrichment_status,
  CASE WHEN action = 'publish' THEN '{NOW}' END AS verified_at, CASE WHEN action = 'skip' THEN '{NOW}' END AS updated_at, CASE WHEN action = 'skip' THEN reason ELSE '' END AS flagged FROM records LEFT JOIN a USING (id)""", "records")
def sk06(spark, d):
    rows = W.reviewed(table(spark, d, "records"), rows_of(spark, d, _ACTIONS, "records"), NOW)
    return rows.select("id", "is_published", "enrichment_status", "verified_at", "updated_at", F.array_join("flagged_issues", ",").alias("flagged"))


_FOUND = "SELECT id + 20 AS id, CASE WHEN id % 2 = 0 THEN 'https://found.example/' || id ELSE '' END AS website_url, CASE WHEN id % 3 = 0 THEN 'x@found.example' END AS primary_contact_email FROM records WHERE id % 4 = 0"


@query("sk08_promoted", f""", f AS ({_FOUND}), j AS (SELECT coalesce(r.id, f.id) AS id, enrichment_status, r.website_url AS w, r.primary_contact_email AS e, nullif(f.website_url, '') AS fw, nullif(f.primary_contact_email, '') AS fe, f.id IS NOT NULL AS there, coalesce(enrichment_status = 'manually_verified', false) AS stays FROM records r FULL JOIN f ON r.id = f.id)
SELECT id, CASE WHEN stays OR NOT there THEN enrichment_status ELSE 'auto_enriched' END AS enrichment_status, CASE WHEN stays THEN w ELSE coalesce(fw, w) END AS website_url, CASE WHEN stays THEN e ELSE coalesce(fe, e) END AS primary_contact_email FROM j""", "records")
def sk08(spark, d):
    return W.promoted(table(spark, d, "records"), rows_of(spark, d, _FOUND, "records"), "id", ["website_url", "primary_contact_email"])


_TEAM = "SELECT firm_crd, owner_full_name, title_or_status FROM owners"
_STAFF = "SELECT firm_crd, 'New ' || id AS owner_full_name, 'Partner' AS title_or_status FROM owners WHERE firm_crd % 3 = 0 AND id % 5 = 0"


@query("sk09_children_replaced", f", n AS ({_STAFF}) SELECT * FROM ({_TEAM}) WHERE firm_crd NOT IN (SELECT firm_crd FROM n) UNION ALL SELECT * FROM n", "owners")
def sk09(spark, d):
    return W.children_replaced(rows_of(spark, d, _TEAM, "owners"), rows_of(spark, d, _STAFF, "owners"), "firm_crd")


_OLD, _NEW = "SELECT id, fund_type FROM records WHERE id % 3 <> 0", "SELECT id, 'new ' || fund_type AS fund_type FROM records WHERE id % 2 = 0"


@query("sk10_added", f", o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)", "records")
def sk10(spark, d):
    return W.added(rows_of(spark, d, _OLD, "records"), rows_of(spark, d, _NEW, "records"), "id")


@query("sk17_sites_blanked", f"SELECT id, CASE WHEN NOT coalesce(regexp_matches(website_url, '{web.BAD}'), false) THEN website_url END AS website_url FROM records", "records")
def sk17(spark, d):
    return W.blanked(table(spark, d, "records").select("id", "website_url"), "website_url", web.is_bad(F.col("website_url")))


@query("sk19_published", "SELECT id, series_master_llc, confidence_score FROM records WHERE is_published ORDER BY confidence_score DESC NULLS LAST, id LIMIT 100", "records")
def sk19(spark, d):
    return table(spark, d, "records").filter("is_published").orderBy(F.desc_nulls_last("confidence_score"), "id").limit(100).select("id", "series_master_llc", "confidence_score")


@query("sk24_queue", f", {_ROLLED}, q AS (SELECT DISTINCT series_master_llc AS manager FROM records WHERE id % 2 = 0 AND series_master_llc <> '') SELECT manager, 0 AS priority FROM q UNION ALL SELECT series_master, 5 FROM rolled WHERE series_master NOT IN (SELECT manager FROM q)", "notices", "records")
def sk24(spark, d):
    queue = table(spark, d, "records").filter("id % 2 = 0 AND series_master_llc <> ''").select(F.col("series_master_llc").alias("manager"), F.lit(0).alias("priority")).distinct()
    return W.added(queue, L.managers_of(table(spark, d, "notices")).select(F.col("series_master").alias("manager"), F.lit(5).alias("priority")), "manager")


@query("sk12_contact_lines", """, e AS (SELECT id, list_transform([series_master_llc, website_url, linkedin_company_url, fund_type, investment_stage], lambda x: CASE WHEN regexp_matches(coalesce(x, ''), '[,"\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE coalesce(x, '') END) AS f, CASE WHEN confidence_score <> 0 THEN printf('%.2f', confidence_score) ELSE '' END AS c, coalesce(enrichment_status, '') AS s FROM records WHERE website_url IS NOT NULL OR linkedin_company_url IS NOT NULL)
SELECT id, array_to_string(f, ',') || ',' || c || ',' || s AS line FROM e""", "records")
def sk12(spark, d):
    return W.contact_lines(table(spark, d, "records"))


_Q = "list_transform({}, lambda x: CASE WHEN regexp_matches(coalesce(x, ''), '[,\"\\n;]') THEN '\"' || replace(x, '\"', '\"\"') || '\"' ELSE coalesce(x, '') END)"


@query("sk13_full_lines", f""", f AS (SELECT lower(trim({_MASTER.format('entityname')})) AS key, id, {_DAY0} AS day, coalesce(filing_date, '') AS fd, nullif(cik, '') AS cik, {_NUMBER.format('totalofferingamount')}::DECIMAL(20,2) AS o, {_NUMBER.format('totalamountsold')}::DECIMAL(20,2) AS s, investmentfundtype AS k, list_transform(string_split(coalesce(federalexemptions_items_list, ''), ','), lambda x: trim(x)) AS codes FROM notices WHERE {_MASTER.format('entityname')} <> ''),
g AS (SELECT key, count(*) AS n, arg_min(fd, (day, id)) AS first, arg_max(fd, (day, id)) AS last, sum(o) AS o, sum(s) AS s, arg_min(struct_pack(k := k), (day, id)).k AS kind, array_to_string(list_sort(list_filter(list_distinct(flatten(list(codes))), lambda x: x <> '')), ', ') AS codes, min(cik) AS cik FROM f GROUP BY key),
r AS (SELECT records.*, g.* EXCLUDE (key) FROM records LEFT JOIN g ON g.key = lower(series_master_llc))
SELECT id, array_to_string({_Q.format("[series_master_llc, website_url, first, last, coalesce(n, 0)::VARCHAR, CASE WHEN o > 0 THEN round(o)::BIGINT::VARCHAR ELSE '' END, CASE WHEN s > 0 THEN round(s)::BIGINT::VARCHAR ELSE '' END, coalesce(nullif(fund_type, ''), nullif(kind, '')), codes, array_to_string(list_filter([headquarters_city, headquarters_state], lambda x: x <> ''), ', '), cik, enrichment_status]")}, ',') AS line FROM r""", "records", "notices")
def sk13(spark, d):
    return W.full_lines(table(spark, d, "records"), table(spark, d, "notices"))


@query("jn06_not_yet_looked_into", f", {_ROLLED} SELECT series_master, fund_count FROM rolled WHERE lower(trim(series_master)) NOT IN (SELECT lower(trim(series_master_llc)) FROM records WHERE series_master_llc IS NOT NULL)", "notices", "records")
def jn06(spark, d):
    return W.not_yet(L.managers_of(table(spark, d, "notices")), table(spark, d, "records")).select("series_master", "fund_count")


@query("wn09_recent_managers", f", {_ROLLED} SELECT series_master, first_filing FROM rolled WHERE lower(trim(series_master)) NOT IN (SELECT lower(trim(series_master_llc)) FROM records WHERE series_master_llc IS NOT NULL) AND length(series_master) >= 4 AND len(list_filter(string_split_regex(series_master, '\\s+'), lambda w: regexp_full_match(w, '[A-Za-z]{{2,}}'))) >= 2 ORDER BY first_filing DESC, series_master LIMIT 40", "notices", "records")
def wn09(spark, d):
    rows = W.not_yet(L.managers_of(table(spark, d, "notices")), table(spark, d, "records")).filter(W.worth_it(F.col("series_master")))
    return rows.orderBy(F.desc("first_filing"), "series_master").limit(40).select("series_master", "first_filing")


_PARTY = f"CASE WHEN trim(upper({{0}})) NOT IN ('N/A', '') AND upper({form_sql('{0}', 'party')}) NOT IN ('N/A', '') THEN {form_sql('{0}', 'party')} END"
_PARTIES = f"""s0 AS (SELECT id, list_transform(string_split(coalesce(related_names, ''), '|'), lambda x: trim(x)) AS ns, list_transform(string_split(coalesce(related_roles, ''), '|'), lambda x: trim(x)) AS rs FROM notices),
s1 AS (SELECT id, unnest(ns) AS raw, unnest(list_transform(range(1, len(ns) + 1), lambda i: coalesce(rs[i], ''))) AS role, generate_subscripts(ns, 1) AS place FROM s0), s2 AS (SELECT id, {_PARTY.replace('{0}', 'raw')} AS name, role, place FROM s1)"""


@query("ar05_parties", f", {_PARTIES} SELECT id, string_agg(name || CASE WHEN role <> '' THEN ' (' || role || ')' ELSE '' END, '; ' ORDER BY place) AS parties FROM s2 WHERE name <> '' GROUP BY id", "notices")
def ar05(spark, d):
    rows = table(spark, d, "notices").select("id", W.parties(F.col("related_names"), F.col("related_roles")).alias("p")).filter(F.size("p") > 0)
    return rows.select("id", F.array_join("p", "; ").alias("parties"))


@query("wn08_key_persons", f", {_PARTIES}, m AS (SELECT id, trim({_MASTER.format('entityname')}) AS manager FROM notices WHERE {_MASTER.format('entityname')} <> '') SELECT manager, arg_min(name, (id, place)) AS name, arg_min(CASE WHEN upper(role) <> 'N/A' THEN role ELSE '' END, (id, place)) AS role FROM m JOIN s2 USING (id) WHERE name <> '' GROUP BY manager", "notices")
def wn08(spark, d):
    rows = table(spark, d, "notices").select("id", F.trim(T.series_master(F.col("entityname"))).alias("manager"), W.key_person(F.col("related_names"), F.col("related_roles")).alias("p")).filter("manager IS NOT NULL AND p IS NOT NULL")
    return rows.groupBy("manager").agg(F.min_by("p", "id").alias("p")).select("manager", "p.name", F.coalesce("p.role", F.lit("")).alias("role"))


@query("ag16_places_of_managers", f"SELECT trim({_MASTER.format('entityname')}) AS manager, string_agg(DISTINCT stateorcountry, '; ' ORDER BY stateorcountry) AS places FROM notices WHERE {_MASTER.format('entityname')} <> '' AND stateorcountry <> '' GROUP BY 1", "notices")
def ag16(spark, d):
    rows = table(spark, d, "notices").select(F.trim(T.series_master(F.col("entityname"))).alias("manager"), "stateorcountry").filter("manager IS NOT NULL AND stateorcountry <> ''")
    return rows.groupBy("manager").agg(F.array_join(F.sort_array(F.collect_set("stateorcountry")), "; ").alias("places"))


@query("ag15_service_providers", """, p AS (SELECT adviser_entity_crd AS crd, 'auditor' AS kind, trim(unnest(string_split(auditing_firm_name, ';'))) AS name FROM vehicles UNION ALL SELECT adviser_entity_crd, 'custodian', trim(unnest(string_split(custodian_name, ';'))) FROM vehicles)
SELECT crd, kind, string_agg(DISTINCT name, '; ' ORDER BY name) AS names FROM p WHERE crd IS NOT NULL AND name <> '' AND NOT (kind = 'custodian' AND name = 'N') GROUP BY ALL""", "vehicles")
def ag15(spark, d):
    rows = table(spark, d, "vehicles").filter("adviser_entity_crd IS NOT NULL")
    one = lambda kind, c: rows.select(F.col("adviser_entity_crd").alias("crd"), F.lit(kind).alias("kind"), F.explode(F.split(c, ";")).alias("name"))
    both = one("auditor", "auditing_firm_name").union(one("custodian", "custodian_name")).withColumn("name", F.trim("name")).filter("name <> '' AND NOT (kind = 'custodian' AND name = 'N')")
    return both.groupBy("crd", "kind").agg(F.array_join(F.sort_array(F.collect_set("name")), "; ").alias("names"))


@query("ar06_owners", """, o AS (SELECT crd, generate_subscripts(string_split(owner_title_or_status, ';'), 1) AS i, string_split(owner_title_or_status, ';') AS t, string_split(coalesce(owner_full_legal_name, ''), ';') AS n, string_split(coalesce(direct_or_indirect_owner, ''), ';') AS k, string_split(coalesce(ownership_amount, ''), ';') AS m FROM registry WHERE owner_title_or_status <> ''),
s AS (SELECT crd, i, coalesce(nullif(trim(n[i]), ''), 'N/A') AS n, coalesce(nullif(trim(t[i]), ''), 'N/A') AS t, coalesce(nullif(trim(k[i]), ''), 'N/A') AS k, coalesce(nullif(trim(m[i]), ''), 'N/A') AS m FROM o)
SELECT crd, string_agg(n || '/' || t || '/' || k || '/' || m, '; ' ORDER BY i) AS owners FROM s WHERE n <> 'N/A' GROUP BY crd""", "registry")
def ar06(spark, d):
    rows = table(spark, d, "registry").select("crd", W.owners_of(*(F.col(c) for c in ("owner_title_or_status", "owner_full_legal_name", "direct_or_indirect_owner", "ownership_amount"))).alias("o")).filter(F.size("o") > 0)
    return rows.select("crd", F.array_join(F.transform("o", lambda o: F.concat_ws("/", o["name"], o["title"], o["type"], o["amount"])), "; ").alias("owners"))


@query("ru11_filed_team", rf""", t0 AS (SELECT id, lower(trim({_MASTER.format('entityname')})) AS manager, list_filter(list_transform(string_split(related_names, '|'), lambda x: trim(x)), lambda x: x <> '') AS ns, list_filter(list_transform(string_split(coalesce(related_roles, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS rs FROM notices WHERE {_MASTER.format('entityname')} <> '' AND related_names IS NOT NULL),
t1 AS (SELECT id, manager, unnest(ns) AS name, unnest(list_transform(range(1, len(ns) + 1), lambda i: coalesce(rs[i], ''))) AS role, generate_subscripts(ns, 1) AS place FROM t0),
t2 AS (SELECT manager, arg_min(struct_pack(n := name, r := role, i := id, p := place), (id, place, name, role)) AS x FROM t1 WHERE NOT regexp_matches(role, '{W.SERVICE}') AND NOT regexp_matches(name, '{N.PLATFORM_STAFF}') AND NOT regexp_matches(name, '{W.FIRMS}') GROUP BY manager, lower(name)),
t3 AS (SELECT manager, x, row_number() OVER (PARTITION BY manager ORDER BY regexp_matches(lower(x.r), '{W.INVESTING}') DESC, x.i, x.p, x.n, x.r) AS n FROM t2) SELECT manager, string_agg(x.n || ': ' || x.r, '; ' ORDER BY n) AS team FROM t3 WHERE n <= 10 GROUP BY manager""", "notices")
def ru11(spark, d):
    return W.filed_team(table(spark, d, "notices")).select("manager", F.array_join("team", "; ").alias("team"))


_A = "SELECT firm_crd AS id, owner_full_name AS name, title_or_status AS title, '' AS email FROM owners WHERE id % 2 = 0"
_B = "SELECT firm_crd AS id, upper(owner_full_name) AS name, 'Founder' AS title, 'x' || id || '@y.com' AS email FROM owners WHERE id % 3 = 0"


@query("jn29_merged_team", f""", a AS (SELECT id, lower(trim(name)) AS k, min(struct_pack(name := name, title := title, email := email)) AS x FROM ({_A}) GROUP BY ALL), b AS (SELECT id, lower(trim(name)) AS k, min(struct_pack(name := name, title := title, email := email)) AS x FROM ({_B}) GROUP BY ALL)
SELECT coalesce(a.id, b.id) AS id, {_text('a.x.name', 'b.x.name')} AS name, {_text('a.x.title', 'b.x.title')} AS title, {_text('a.x.email', 'b.x.email')} AS email FROM a FULL JOIN b ON a.id = b.id AND a.k = b.k""", "owners")
def jn29(spark, d):
    return W.merged_team(rows_of(spark, d, _A, "owners"), rows_of(spark, d, _B, "owners"))


@query("ag22_status_groups", "SELECT enrichment_status, count(*) AS n, round(avg(confidence_score), 2) AS average, count_if(linked_crd IS NOT NULL)::BIGINT AS linked FROM records GROUP BY 1", "records")
def ag22(spark, d):
    return table(spark, d, "records").groupBy("enrichment_status").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 2).alias("average"), F.count_if(F.col("linked_crd").isNotNull()).alias("linked"))


@query("ag24_batch_counters", "SELECT count(*) AS total, count_if(enrichment_status = 'auto_enriched')::BIGINT AS auto, count_if(enrichment_status = 'needs_manual_review')::BIGINT AS needs, count_if(enrichment_status = 'no_data_found')::BIGINT AS no_data, count_if(enrichment_status IS NULL)::BIGINT AS errors FROM records", "records")
def ag24(spark, d):
    is_ = lambda v: F.count_if(F.col("enrichment_status") == v)
    return table(spark, d, "records").agg(F.count("*").alias("total"), is_("auto_enriched").alias("auto"), is_("needs_manual_review").alias("needs"), is_("no_data_found").alias("no_data"), F.count_if(F.col("enrichment_status").isNull()).alias("errors"))


@query("fl36_shapes", r"SELECT id, coalesce(regexp_matches(website_url, '(?i)^https?://\S+\.\S+'), false) AS site, coalesce(regexp_matches(linkedin_company_url, '(?i)linkedin\.com/(company|in)/'), false) AS page, coalesce(regexp_full_match(primary_contact_email, '[^\s@]+@[^\s@]+\.[^\s@]+'), false) AS mail FROM records", "records")
def fl36(spark, d):
    test = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    return table(spark, d, "records").select("id", test("website_url", r"(?i)^https?://\S+\.\S+").alias("site"), test("linkedin_company_url", r"(?i)linkedin\.com/(company|in)/").alias("page"), test("primary_contact_email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$").alias("mail"))


@query("ag08_counts", f"SELECT count(*) AS rows, count_if({_has('fund', 'entityname')})::BIGINT AS funds, count(DISTINCT cik) AS ciks FROM notices", "notices")
def ag08(spark, d):
    return table(spark, d, "notices").agg(F.count("*").alias("rows"), F.count_if(L.holds("fund", "entityname")).alias("funds"), F.count_distinct("cik").alias("ciks"))
