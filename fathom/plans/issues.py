"""Registered queries of registration lookups and of detectors as stored issues, and the SQL each is held against.

The SQL compares every name with every adviser; the queries join on words, beginnings and persons.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.operators import detectors
from fathom.operators import issues as I
from fathom.operators import listings as L
from fathom.operators import matching as M
from fathom.operators import registry as R
from fathom.operators.core import cross_reference
from fathom.plans.catalog import _ALL, _DAY, _XREF, DUE, SQL, matches, query
from fathom.plans.detections import _family, _standard
from fathom.plans.lists import _DAY0, _KEPT, _MASTER, _NUMBER, _ROLLED, _investor, _text
from fathom.plans.matching import _GATE_WORDS, _SIGNALS, _TIER, form_sql
from fathom.sources import work
from fathom.sources.views import table, with_views

NOW = "2001-06-30"

# --- lookups -----------------------------------------------------------------------------------------------------

_STOP = list(T.STOPWORDS)
_MORE = "lambda w: length(w) >= {n} AND NOT list_contains({stop}, lower(w)) AND NOT regexp_matches(w, '(?i)^[ivx]+$')"
_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) >= 2))"
_PLAIN = r"trim(regexp_replace(regexp_replace(upper(coalesce({0}, '')), '[^\w\s,''-]', ' ', 'g'), '\s+', ' ', 'g'))"


def _said(kind: str, *values: str) -> str:
    """The text of an issue with its values."""
    parts = ["'" + part.replace("'", "''") + "'" for part in I.TEXTS[kind].split("{}")]
    return " || ".join(x for pair in zip(parts, [f"coalesce({v}::VARCHAR, 'null')" for v in values] + [""]) for x in pair if x)


def _person(c: str) -> str:
    """Words of a person's name, the last name last."""
    p = _PLAIN.format(c)
    good = "lambda w: length(w) > 1 AND w <> 'NMN'"
    return f"CASE WHEN contains({p}, ',') THEN list_concat(list_filter(string_split(coalesce(string_split_regex({p}, '\\s*,\\s*')[2], ''), ' '), {good}), CASE WHEN length(string_split_regex({p}, '\\s*,\\s*')[1]) > 1 THEN [string_split_regex({p}, '\\s*,\\s*')[1]] ELSE [] END) ELSE list_filter(string_split({p}, ' '), {good}) END"


def _lookup(tries: str, roles: bool = False) -> str:
    """CTE lk (key, crd, adviser_name, source) over the CTE tries (key, name, related_names, related_roles)."""
    people = "list_filter(list_transform(string_split(coalesce(related_names, ''), '|'), lambda x: trim(x)), lambda x: length(x) > 3)[1:5]"
    cut = "list_transform(string_split(coalesce({}, ''), '|'), lambda x: trim(x))"
    return f"""ky AS (SELECT * FROM registry WHERE adviser_name <> ''),
bs AS (SELECT *, {form_sql('name', 'base')} AS base, list_filter(string_split_regex({form_sql('name', 'base')}, '\\s+'), lambda x: x <> '') AS bw FROM {tries}),
ask AS (SELECT key, 0 AS way, base FROM bs WHERE length(base) >= 3 AND len(list_filter(string_split_regex(base, '\\s+'), {_MORE.format(n=3, stop=_STOP)})) > 0
  UNION ALL SELECT key, 1, bw[1] || ' ' || bw[2] FROM bs WHERE list_contains({_STOP}, lower(bw[1])) AND len(list_filter([bw[2]], {_MORE.format(n=4, stop=_STOP)})) > 0),
nd AS (SELECT DISTINCT base, list_filter({_WORDS.format('base')}, lambda w: regexp_matches(w, '[a-z]')) AS need FROM ask),
h1 AS (SELECT base, arg_min(struct_pack(crd := crd, adviser_name := adviser_name), (length(adviser_name), crd)) AS hit FROM nd JOIN ky ON len(need) > 0 AND contains(lower(adviser_name), lower(base)) AND list_has_all({_WORDS.format('adviser_name')}, need) GROUP BY base),
pr AS (SELECT key, list_filter(list_zip({cut.format('related_names')}, {cut.format('related_roles') if roles else '[]'}), lambda x: length(x[1]) >= 3 AND (coalesce(trim(regexp_replace(x[2], '[,;]', '', 'g')), '') = '' OR regexp_matches(upper(x[2]), '{M.ROLES}')))[1:8] AS ps FROM {tries}),
p1 AS (SELECT key, unnest(ps)[1] AS person, generate_subscripts(ps, 1) AS place FROM pr),
p2 AS (SELECT key, place, {_person('person')} AS w FROM p1),
ow AS (SELECT id AS owner_id, firm_crd AS crd, {_person('owner_full_name')} AS w FROM owners WHERE owner_type = 'I' AND regexp_matches(upper(trim(title_or_status)), '{R.TITLES}')),
h3 AS (SELECT key, arg_min(struct_pack(crd := ky.crd, adviser_name := adviser_name), (place, owner_id)) AS hit FROM p2 JOIN ow ON p2.w[1] = ow.w[1] AND p2.w[-1] = ow.w[-1] AND length(p2.w[1]) >= 2 AND length(p2.w[-1]) >= 2 JOIN ky ON ky.crd = ow.crd GROUP BY key),
q1 AS (SELECT key, upper(string_split(base, ' ')[1]) AS word, {people} AS ps FROM bs), q2 AS (SELECT key, word, string_split_regex(unnest(ps), '\\s+') AS w, generate_subscripts(ps, 1) AS place FROM q1),
q3 AS (SELECT * FROM q2 WHERE len(w) >= 2 AND length(w[-1]) >= 3), q4 AS (SELECT DISTINCT lower(w[-1]) AS part FROM q3), q5 AS (SELECT part, crd, adviser_name FROM q4 JOIN ky ON contains(lower(adviser_name), part)),
h4 AS (SELECT key, arg_min(struct_pack(crd := crd, adviser_name := adviser_name), (place, crd)) AS hit FROM q3 JOIN q5 ON lower(w[-1]) = part WHERE contains(upper(adviser_name), upper(w[1])) OR (word <> '' AND contains(upper(adviser_name), word)) GROUP BY key),
al4 AS (SELECT key, hit, way FROM ask JOIN h1 USING (base) UNION ALL SELECT key, hit, 2 FROM h3 UNION ALL SELECT key, hit, 3 FROM h4),
lk AS (SELECT key, b.h.crd AS crd, b.h.adviser_name AS adviser_name, {list(R.WAYS)}[b.way + 1] AS source FROM (SELECT key, arg_min(struct_pack(h := hit, way := way), way) AS b FROM al4 GROUP BY key))"""


def _variants(src: str, extra: bool) -> str:
    """CTE steps (id, v, k): the variants of src (id, name) in order; with extra, of its base form too."""
    second = f"trim({form_sql('name', 'base')})" if extra else "NULL"
    return f"""va AS (SELECT id, name, {form_sql('name', 'stripped')} AS p, {second} AS m FROM {src}),
vb AS (SELECT *, trim(regexp_replace(p, '(?i)\\s+({'|'.join(N.TAILS)})\\s*$', '')) AS cut, list_filter(regexp_split_to_array(p, '\\s+'), lambda w: length(w) >= 2) AS w FROM va),
vc AS (SELECT id, unnest([{'name' if extra else 'NULL'}, p, m, CASE WHEN cut <> p AND length(cut) >= 3 THEN cut END, CASE WHEN cut <> p AND length(cut) >= 3 THEN {form_sql('cut', 'stripped')} END, CASE WHEN len(w) >= 3 THEN w[1] || ' ' || w[2] END, CASE WHEN len(w) >= 2 AND NOT list_contains({list(N.GENERIC)}, lower(w[1])) THEN w[1] END]) AS v, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS k FROM vb),
steps AS (SELECT id, v, min(k) AS k FROM vc WHERE length(v) >= 3 GROUP BY ALL)"""


_SHARED = f"list_intersect({_GATE_WORDS.format('v')}, {_GATE_WORDS.format('adviser_name')})"


def _search(src: str, extra: bool = True) -> str:
    """CTE se (id, crd, adviser_name, source, variant) over src (id, name, related_names, related_roles)."""
    return f"""{_variants(src, extra)}, tries AS (SELECT struct_pack(id := id, k := k) AS key, v AS name, related_names, related_roles FROM steps JOIN {src} USING (id)), {_lookup('tries', True)},
gt AS (SELECT key.id AS id, key.k AS k, v, crd, adviser_name, source, {_SHARED} AS s FROM lk JOIN steps ON steps.id = key.id AND steps.k = key.k),
se AS (SELECT id, arg_min(crd, k) AS crd, arg_min(adviser_name, k) AS adviser_name, arg_min(source, k) AS source, arg_min(v, k) AS variant FROM gt WHERE len(s) >= 2 OR len(list_filter(s, lambda w: length(w) >= 5)) > 0 GROUP BY id)"""


_ASKED = ", asked AS (SELECT id, entityname AS name, related_names, related_roles FROM notices WHERE entityname <> '')"


def asked(spark, d):
    rows = table(spark, d, "notices").filter("entityname <> ''")
    return rows.select(F.col("id").alias("key"), F.col("entityname").alias("name"), "related_names", "related_roles")


def base_tables(spark, d):
    return table(spark, d, "registry"), table(spark, d, "owners")


@query("mx01_registration_lookup", f"{_ASKED}, tries AS (SELECT id AS key, * FROM asked), {_lookup('tries', True)} SELECT key AS id, crd, adviser_name, source FROM lk", "notices", "registry", "owners")
def mx01(spark, d):
    return R.lookup(asked(spark, d), *base_tables(spark, d)).withColumnRenamed("key", "id")


@query("mx02_registration_search", f"{_ASKED}, {_search('asked')} SELECT * FROM se", "notices", "registry", "owners")
def mx02(spark, d):
    return R.search(asked(spark, d), *base_tables(spark, d)).withColumnRenamed("key", "id")


@query("mx15_first_lookup", f"""{_ASKED}, b AS (SELECT id, {form_sql('name', 'base')} AS base FROM asked), ky AS (SELECT * FROM registry WHERE adviser_name <> ''), db AS (SELECT DISTINCT base FROM b),
w AS (SELECT base, count(*) AS n FROM db JOIN ky ON length(base) >= 3 AND contains(lower(adviser_name), lower(base)) GROUP BY base), p AS (SELECT base, count(*) AS n FROM db JOIN ky ON length(string_split(base, ' ')[1]) >= 3 AND starts_with(lower(adviser_name), lower(string_split(base, ' ')[1])) GROUP BY base)
SELECT id, coalesce(w.n, p.n) AS n, CASE WHEN w.n IS NOT NULL THEN 'database' ELSE 'database_partial' END AS source FROM b LEFT JOIN w ON w.base = b.base LEFT JOIN p ON p.base = b.base WHERE coalesce(w.n, p.n) IS NOT NULL""", "notices", "registry")
def mx15(spark, d):
    return R.first_lookup(asked(spark, d), table(spark, d, "registry")).withColumnRenamed("key", "id")


@query("jn22_by_principals", f"""{_ASKED}, q1 AS (SELECT id, list_filter(list_transform(string_split(coalesce(related_names, ''), '|'), lambda x: trim(x)), lambda x: length(x) > 3)[1:5] AS ps FROM asked), q2 AS (SELECT id, unnest(ps) AS person, generate_subscripts(ps, 1) AS place FROM q1), q3 AS (SELECT id, place, {_person('person')} AS w FROM q2),
ow AS (SELECT id AS owner_id, firm_crd AS crd, {_person('owner_full_name')} AS w FROM owners WHERE owner_type = 'I' AND regexp_matches(upper(trim(title_or_status)), '{R.TITLES}'))
SELECT q3.id, arg_min(ow.crd, (place, owner_id)) AS crd FROM q3 JOIN ow ON q3.w[1] = ow.w[1] AND q3.w[-1] = ow.w[-1] AND length(q3.w[1]) >= 2 AND length(q3.w[-1]) >= 2 JOIN registry ON registry.crd = ow.crd AND adviser_name <> '' GROUP BY q3.id""", "notices", "registry", "owners")
def jn22(spark, d):
    return R.by_principals(asked(spark, d).select("key", "related_names"), table(spark, d, "owners"), table(spark, d, "registry")).withColumnRenamed("key", "id")


_KNOWN = f"inv AS (SELECT * FROM (SELECT *, {_investor('investor_name')} AS form, row_number() OVER (PARTITION BY {_investor('investor_name')} ORDER BY investor_name, website_url NULLS FIRST) AS n FROM investors_a) WHERE n = 1 AND form <> '')"


@query("mx11_identities", f"""{_ASKED}, {_search('asked', False)}, {_KNOWN}, re AS (SELECT id, 'sec_adv_crd' AS anchor, se.crd, se.adviser_name, CASE WHEN NOT regexp_matches(lower(primary_website), '{"|".join(x.replace(".", "[.]") for x in R.NOISY)}') THEN nullif(primary_website, '') END AS primary_website, variant AS matched_variant FROM se LEFT JOIN registry ON registry.crd = se.crd),
px AS (SELECT id, v, k, string_split({_investor('v')}, ' ') AS w FROM steps WHERE id NOT IN (SELECT id FROM re)), py AS (SELECT id, v, k, array_to_string(w[1:n], ' ') AS form FROM (SELECT *, unnest(range(least(2, len(w)), len(w) + 1)) AS n FROM px)),
ex AS (SELECT py.id, arg_min(struct_pack(n := investor_name, u := website_url, v := v), (k, -length(py.form))) AS b FROM py JOIN inv ON inv.form = py.form GROUP BY py.id)
SELECT a.id, coalesce(re.anchor, CASE WHEN ex.id IS NOT NULL THEN 'external_db' END) AS anchor, re.crd::VARCHAR AS crd, coalesce(re.adviser_name, b.n) AS adviser_name, CASE WHEN re.id IS NOT NULL THEN re.primary_website ELSE nullif(b.u, '') END AS primary_website, coalesce(matched_variant, b.v) AS matched_variant, re.id IS NOT NULL OR ex.id IS NOT NULL AS resolved
FROM asked a LEFT JOIN re ON re.id = a.id LEFT JOIN ex ON ex.id = a.id""", "notices", "registry", "owners", "investors_a")
def mx11(spark, d):
    return R.identities(asked(spark, d), *base_tables(spark, d), table(spark, d, "investors_a")).withColumnRenamed("key", "id")


_CUT = "list_transform(string_split(coalesce({}, ''), '|'), lambda x: trim(x))"
_SERIES = r"coalesce(nullif(trim(regexp_extract(entityname, '(?i)[,\s]+a\s+series\s+of\s+(.+?)$', 1)), ''), nullif(trim(regexp_extract(entityname, '(?i)\s+-\s+series\s+of\s+(.+?)$', 1)), ''))"
_COMPANIES = f"""z0 AS (SELECT id, entityname, list_transform({_CUT.format('related_names')}, lambda x: regexp_replace(x, '^--\\s*', '')) AS ns, {_CUT.format('related_roles')} AS rs FROM notices),
z1 AS (SELECT id, entityname, unnest(ns) AS name, unnest(list_transform(range(1, len(ns) + 1), lambda i: coalesce(rs[i], ''))) AS role, generate_subscripts(ns, 1) AS place FROM z0),
companies AS (SELECT id, name, role, place, CASE WHEN regexp_matches(lower(role), 'managing|general partner|director') THEN 1 ELSE 2 END AS priority FROM z1 WHERE regexp_matches(trim(name), '{N.COMPANY}') AND NOT regexp_matches(lower(role), '{R.SERVANTS}') AND NOT regexp_matches(upper(name), '{R.FUND_WORDS}'))"""


@query("ar02_related_companies", f", {_COMPANIES} SELECT id, string_agg(name || ' (' || role || ')', '; ' ORDER BY priority, place) AS companies FROM companies GROUP BY id", "notices")
def ar02(spark, d):
    rows = table(spark, d, "notices").select("id", R.related_companies(F.col("related_names"), F.col("related_roles")).alias("c")).filter(F.size("c") > 0)
    return rows.select("id", F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit(" ("), x["role"], F.lit(")"))), "; ").alias("companies"))


_ENTITY = form_sql("entityname", "entity")
_CANDIDATES = f"""{_COMPANIES}, c0 AS (SELECT id, {_SERIES} AS name, 'series_pattern' AS source, 1 AS priority, 0 AS o FROM notices UNION ALL SELECT id, name, 'related_names', CASE WHEN priority = 1 THEN 2 ELSE 3 END, priority * 1000 + place FROM companies
  UNION ALL SELECT id, {_ENTITY}, 'entity_name', 4, 1000000 FROM notices WHERE regexp_matches(trim({_ENTITY}), '{N.COMPANY}')),
c1 AS (SELECT *, {form_sql('name', 'registration')} AS form FROM c0 WHERE name IS NOT NULL), c2 AS (SELECT *, row_number() OVER (PARTITION BY id, form ORDER BY o) AS n FROM c1),
cands AS (SELECT id, name, source, priority, form, row_number() OVER (PARTITION BY id ORDER BY o) AS place FROM c2 WHERE n = 1)"""


def candidates(spark, d):
    rows = R.spread(table(spark, d, "notices").select("id", "entityname", "related_names", "related_roles"))
    rows = rows.select(F.col("id").alias("key"), F.posexplode(R.firm_candidates(F.col("entityname"), F.col("related_names"), F.col("related_roles"))).alias("place", "c"))
    return rows.select("key", "place", "c.*")


@query("ar08_firm_candidates", f", {_CANDIDATES} SELECT id, place, name, source, priority FROM cands", "notices")
def ar08(spark, d):
    return candidates(spark, d).select(F.col("key").alias("id"), (F.col("place") + 1).cast("long").alias("place"), "name", "source", "priority")


_SCORE = "CASE WHEN na = '' OR nb = '' THEN 0 WHEN na = nb THEN 1 WHEN contains(na, nb) OR contains(nb, na) THEN 0.9 WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 WHEN len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) IN (len(ta), len(tb)) THEN 0.95 WHEN len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) > 0 AND len(list_intersect(ta, tb))::DOUBLE / greatest(len(ta), len(tb)) >= 0.5 THEN 0.85 WHEN len(wa) >= 2 AND len(wb) >= 2 AND wa[1:2] = wb[1:2] THEN 0.85 ELSE len(list_intersect(wa, wb))::DOUBLE / greatest(len(wa), len(wb)) END"


@query("mx10_index_matches", f""", {_CANDIDATES}, ky AS (SELECT crd, adviser_name, {form_sql('adviser_name', 'registration')} AS fb FROM registry WHERE adviser_name <> ''),
pairs AS (SELECT a.name AS id, a.name AS a, adviser_name AS b, crd FROM (SELECT DISTINCT name FROM cands WHERE form <> '') a JOIN ky ON fb <> ''), t AS (SELECT *, {form_sql('a', 'registration')} AS na, {form_sql('b', 'registration')} AS nb FROM pairs),
u AS (SELECT *, list_filter(string_split(na, ' '), lambda w: length(w) > 1) AS wa, list_filter(string_split(nb, ' '), lambda w: length(w) > 1) AS wb FROM t), v AS (SELECT *, list_filter(wa, lambda w: NOT list_contains({list(N.TIER_GENERIC)}, w)) AS ta, list_filter(wb, lambda w: NOT list_contains({list(N.TIER_GENERIC)}, w)) AS tb FROM u),
fz AS (SELECT a AS name, min(crd) AS crd FROM v WHERE {_SCORE} >= 0.8 GROUP BY a), et AS (SELECT fb AS form, max(crd) AS crd FROM ky WHERE fb <> '' GROUP BY fb),
al AS (SELECT id, place, name, source, et.crd, 'exact' AS match_type FROM cands JOIN et USING (form) UNION ALL SELECT id, place, name, source, fz.crd, 'fuzzy' FROM cands JOIN fz USING (name)),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, match_type) AS n FROM al)
SELECT id, b.crd, adviser_name AS matched_name, name AS candidate_name, source, match_type FROM b JOIN registry ON registry.crd = b.crd WHERE n = 1""", "notices", "registry")
def mx10(spark, d):
    return R.index_matches(candidates(spark, d), table(spark, d, "registry")).withColumnRenamed("key", "id")


_MANAGER = f"""y0 AS (SELECT id, entityname, list_transform({_CUT.format('related_names')}, lambda x: regexp_replace(x, '^[-\\s]+', '')) AS ns, {_CUT.format('related_roles')} AS rs FROM notices),
y1 AS (SELECT id, unnest(ns) AS name, unnest(list_transform(range(1, len(ns) + 1), lambda i: coalesce(rs[i], ''))) AS role, generate_subscripts(ns, 1) AS place FROM y0),
y2 AS (SELECT id, name, CASE WHEN contains(lower(role), 'executive officer') THEN 1 ELSE 2 END AS priority, place, 'related_names' AS source FROM y1 WHERE regexp_matches(name, '(?i)\\b(LLC|L\\.?L\\.?C\\.?|LP|L\\.?P\\.?|LTD|LIMITED|INC|INCORPORATED)\\b') AND regexp_matches(name, '(?i)(GP|General Partner|Management|Manager|Advisor|Adviser)')
  UNION ALL SELECT id, trim(regexp_extract(entityname, '(?i),?\\s+a\\s+series\\s+of\\s+(.+)$', 1)), 1, 10000000, 'series_pattern' FROM notices WHERE trim(regexp_extract(entityname, '(?i),?\\s+a\\s+series\\s+of\\s+(.+)$', 1)) <> ''),
entities AS (SELECT id, arg_min(name, (priority, place)) AS name, arg_min(source, (priority, place)) AS source FROM y2 GROUP BY id)"""


@query("ar03_manager_entities", f", {_MANAGER} SELECT * FROM entities", "notices")
def ar03(spark, d):
    return table(spark, d, "notices").select("id", R.manager_entity(F.col("related_names"), F.col("related_roles"), F.col("entityname")).alias("m")).filter("m IS NOT NULL").select("id", "m.name", "m.source")


#: Filings taken as matched in the queries over notices.
_MATCHED = "matched AS (SELECT accessionnumber FROM notices WHERE id % 4 = 2)"


def matched(spark, d):
    return table(spark, d, "notices").filter("id % 4 = 2").select("accessionnumber")


_MATCH_INDEX = f"""ky AS (SELECT crd, adviser_name, {form_sql('adviser_name', 'registration')} AS fb FROM registry WHERE adviser_name <> ''),
asked AS (SELECT DISTINCT name, {form_sql('name', 'registration')} AS form FROM cand),
pairs AS (SELECT name AS id, name AS a, adviser_name AS b, form AS na, fb AS nb FROM asked JOIN ky ON form <> '' AND fb <> ''),
u AS (SELECT *, list_filter(string_split(na, ' '), lambda w: length(w) > 1) AS wa, list_filter(string_split(nb, ' '), lambda w: length(w) > 1) AS wb FROM pairs),
v AS (SELECT *, list_filter(wa, lambda w: NOT list_contains({list(N.TIER_GENERIC)}, w)) AS ta, list_filter(wb, lambda w: NOT list_contains({list(N.TIER_GENERIC)}, w)) AS tb FROM u),
hits AS (SELECT DISTINCT a AS name FROM v WHERE {_SCORE} >= 0.8)"""


@query("de09_graded_by_candidates", f""", {_CANDIDATES}, {_MATCHED},
n AS (
  SELECT *, {_DAY} AS day FROM notices
  WHERE cik IS NOT NULL AND accessionnumber NOT IN (SELECT accessionnumber FROM matched) AND date_diff('day', {_DAY}, DATE '{NOW}') > 60),
cand AS (
  SELECT id, place, name, source FROM cands WHERE id IN (SELECT id FROM n)
  UNION ALL SELECT id, 1, entityname, 'entity_name_raw' FROM n WHERE id NOT IN (SELECT id FROM cands)),
{_MATCH_INDEX},
lost AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM cand JOIN hits USING (name))),
best AS (SELECT lost.*, c.name AS manager, c.source, (SELECT list(name ORDER BY place) FROM cand d WHERE d.id = lost.id) AS names FROM lost JOIN cand c ON c.id = lost.id AND c.place = 1 WHERE c.name IS NOT NULL),
g AS (
  SELECT manager, count(*) AS n, min(day) AS first, sum(coalesce({_NUMBER.format('totalofferingamount')}, 0)::DECIMAL(20,2)) AS total, arg_min(cik, (-date_diff('day', DATE '1970-01-01', day), id)) AS cik,
         arg_min(source, (-date_diff('day', DATE '1970-01-01', day), id)) AS source, arg_min(names, (-date_diff('day', DATE '1970-01-01', day), id)) AS names, list(entityname ORDER BY day DESC, id)[1:5] AS sample
  FROM best GROUP BY manager)
SELECT CASE WHEN date_diff('day', first, DATE '{NOW}') > 180 THEN 'critical' WHEN date_diff('day', first, DATE '{NOW}') > 120 THEN 'high' ELSE 'medium' END AS severity, cik AS form_d_cik,
       {_said('graded_registration', 'manager', 'n', 'first', f"date_diff('day', first, DATE '{NOW}')")} AS description, source AS name_source, total::DOUBLE AS total_offering, array_to_string(names, '|') AS candidates, coalesce(array_to_string(sample, '|'), '') AS sample
FROM g""", "notices", "registry")
def de09_candidates(spark, d):
    rows = I.graded(table(spark, d, "notices"), matched(spark, d), table(spark, d, "registry"), NOW)
    said = F.from_json("metadata", "name_source string, total_offering_amount string, all_firm_candidates array<string>, sample_funds array<string>")
    rows = rows.withColumn("m", said).select("severity", "form_d_cik", "description", "m.name_source", F.col("m.total_offering_amount").cast("double").alias("total_offering"), F.array_join("m.all_firm_candidates", "|").alias("candidates"), F.array_join("m.sample_funds", "|").alias("sample"))
    return rows


@query("de12_found_managers", f""", {_MANAGER}, {_MATCHED} SELECT name, count(*) AS n_filings, sum(coalesce({_NUMBER.format('totalofferingamount')}, 0)::DECIMAL(20,2))::DOUBLE AS total_offering FROM entities JOIN notices USING (id)
  WHERE date_diff('day', {_DAY}, DATE '{NOW}') > 60 AND accessionnumber NOT IN (SELECT accessionnumber FROM matched) GROUP BY name ORDER BY total_offering DESC, name LIMIT 200""", "notices")
def de12(spark, d):
    return I.found_managers(table(spark, d, "notices"), matched(spark, d), NOW)


_PLATFORM = f"""sg AS (SELECT id, unnest(list_filter(ss, lambda x: x IS NOT NULL)) AS p, generate_subscripts(list_filter(ss, lambda x: x IS NOT NULL), 1) AS i FROM (SELECT id, {_SIGNALS} AS ss FROM (SELECT id, coalesce(entityname, '') AS name, related_names FROM {{src}}))),
pl AS (SELECT id, arg_min(p, -1000 * n + i) AS platform FROM (SELECT id, p, count(*) AS n, min(i) AS i FROM sg GROUP BY ALL) GROUP BY id)"""
_MANAGED = f"""{_PLATFORM}, cd AS (SELECT s.id, coalesce(entityname, '') AS e, nullif({_MASTER.format("coalesce(entityname, '')")}, '') AS master, related_names, related_roles, platform FROM {{src}} s LEFT JOIN pl ON pl.id = s.id),
ce AS (SELECT *, CASE WHEN master IS NOT NULL THEN regexp_replace(trim(regexp_extract(e, '(?i)^(.*?),?\\s+a\\s+series\\s+of\\s+', 1)), ',\\s*$', '') ELSE {form_sql('e', 'plain')} END AS prefix, list_filter(list_zip({_CUT.format('related_names')}, {_CUT.format('related_roles')}), lambda x: length(x[1]) >= 3 AND (coalesce(trim(regexp_replace(x[2], '[,;]', '', 'g')), '') = '' OR regexp_matches(upper(x[2]), '{M.ROLES}'))) AS ps FROM cd),
cf AS (SELECT *, platform IS NOT NULL AND length(prefix) >= 4 AND NOT contains(lower(platform), lower(prefix[1:6])) AS own FROM ce),
managed AS (SELECT id, CASE WHEN own THEN prefix WHEN platform IS NOT NULL THEN coalesce(ps[1][1], master, e) ELSE coalesce(master, nullif(prefix, ''), e) END AS candidate, CASE WHEN own THEN 'platform_prefix' WHEN platform IS NOT NULL AND len(ps) > 0 THEN 'platform_principal' WHEN platform IS NOT NULL THEN 'platform_fallback_master' WHEN master IS NOT NULL THEN 'series_master' ELSE 'entity_prefix' END AS source, platform FROM cf)"""

SQL["mx08_manager_candidates"] = with_views(f", src AS (SELECT id, name AS entityname, related_names, related_roles FROM names), {_MANAGED.replace('{src}', 'src')} SELECT * FROM managed", "names").replace(") ,", "),", 1)


_TAGS = rf"""tp AS (SELECT manager, trim(unnest(string_split(rn, '|'))) AS p FROM rl), tl AS (SELECT manager, upper(string_split_regex(trim(regexp_replace(p, '(?i)[,.]?\s*({M.ENDINGS})\.?\s*$', '')), '[\s,]+')[-1]) AS s, count(*) OVER (PARTITION BY manager) AS n FROM tp WHERE p <> ''),
fam AS (SELECT manager FROM tl WHERE n <= 4 AND length(s) >= 3 AND NOT regexp_matches(s, '^({M.ENDINGS}|CO)$') GROUP BY manager HAVING count(*) > count(DISTINCT s))"""
_UNREGISTERED = f"""{_MATCHED}, src AS (SELECT *, {_DAY} AS day FROM notices WHERE industrygrouptype = 'Pooled Investment Fund' AND isamendment <> 'true' AND cik IS NOT NULL AND {_DAY} >= DATE '{NOW}' - INTERVAL 60 MONTH AND date_diff('day', {_DAY}, DATE '{NOW}') > 60 AND accessionnumber NOT IN (SELECT accessionnumber FROM matched)),
{_MANAGED.replace('{src}', 'src')}, rw AS (SELECT src.*, candidate AS manager, managed.source, managed.platform FROM src JOIN managed ON managed.id = src.id WHERE candidate <> ''),
rn0 AS (SELECT *, row_number() OVER (PARTITION BY manager ORDER BY day DESC, id) AS n FROM rw),
rl AS (SELECT manager, count(*) AS n, min(day) AS first, max(day) AS last, sum(coalesce({_NUMBER.format('totalofferingamount')}, 0)::DECIMAL(20,2)) AS total, max(CASE WHEN n = 1 THEN cik END) AS cik, max(CASE WHEN n = 1 THEN related_names END) AS rn, max(CASE WHEN n = 1 THEN related_roles END) AS rr, max(CASE WHEN n = 1 THEN stateorcountry END) AS place, max(CASE WHEN n = 1 THEN platform END) AS platform, max(CASE WHEN n = 1 THEN source END) AS source, list(entityname ORDER BY day DESC, id)[1:5] AS sample FROM rn0 GROUP BY manager),
asked AS (SELECT manager AS id, manager AS name, rn AS related_names, rr AS related_roles FROM rl), {_search('asked')},
g1 AS (SELECT id, list_filter(list_transform(string_split(coalesce(related_names, ''), '|'), lambda x: trim(x)), lambda x: length(x) > 3)[1:5] AS ps FROM asked), g2 AS (SELECT id, unnest(ps) AS person FROM g1), g3 AS (SELECT id, {_person('person')} AS w FROM g2),
lag AS (SELECT DISTINCT g3.id FROM g3 JOIN ow ON g3.w[1] = ow.w[1] AND g3.w[-1] = ow.w[-1] AND length(g3.w[1]) >= 2 AND length(g3.w[-1]) >= 2 JOIN ky ON ky.crd = ow.crd), {_TAGS},
un AS (SELECT *, list_filter([CASE WHEN manager IN (SELECT manager FROM fam) THEN 'likely_family_office' END, CASE WHEN NOT list_contains({list(M.HOME)}, upper(trim(place))) AND trim(place) <> '' THEN 'likely_foreign_private_adviser' END], lambda x: x IS NOT NULL) AS tags, date_diff('day', first, DATE '{NOW}') AS days FROM rl WHERE manager NOT IN (SELECT id FROM se) AND manager NOT IN (SELECT id FROM lag))"""


def unregistered(spark, d):
    return I.unregistered(table(spark, d, "notices"), matched(spark, d), *base_tables(spark, d), NOW, months=60)


@query("de01_unregistered_managers", f""", {_UNREGISTERED}
SELECT 'needs_initial_adv_filing' AS discrepancy_type, CASE WHEN len(tags) > 0 THEN 'low' ELSE 'high' END AS severity, NULL::BIGINT AS adviser_crd, cik AS form_d_cik, {_said('needs_initial_adv_filing', 'manager', 'n', 'first', 'days')} AS description,
  to_json(struct_pack(manager_name := manager, fund_count := n, earliest_filing_date := first::VARCHAR, latest_filing_date := last::VARCHAR, days_since_first_filing := days, total_offering_amount := total::DECIMAL(30,2)::VARCHAR, extraction_source := source, platform_name := platform, likely_exemptions := tags, sample_funds := sample))::VARCHAR AS metadata FROM un""", "notices", "registry", "owners")
def de01(spark, d):
    return unregistered(spark, d)


@query("mx14_flag_audit", f""", {_UNREGISTERED}, fl AS (SELECT manager, cik FROM un), ff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY id) AS n FROM notices WHERE cik <> '') WHERE n = 1),
fsrc AS (SELECT manager AS id, entityname, related_names, related_roles, stateorcountry FROM fl LEFT JOIN ff USING (cik)), kl AS (SELECT manager, source FROM klk JOIN fl ON fl.manager = klk.key),
a1 AS (SELECT id, list_filter(list_transform(string_split(coalesce(related_names, ''), '|'), lambda x: trim(x)), lambda x: length(x) > 3)[1:5] AS ps FROM fsrc), a2 AS (SELECT id, unnest(ps) AS person FROM a1), a3 AS (SELECT id, {_person('person')} AS w FROM a2),
al AS (SELECT DISTINCT a3.id FROM a3 JOIN ow ON a3.w[1] = ow.w[1] AND a3.w[-1] = ow.w[-1] AND length(a3.w[1]) >= 2 AND length(a3.w[-1]) >= 2 JOIN ky ON ky.crd = ow.crd),
sg2 AS (SELECT id FROM (SELECT id, {_SIGNALS} AS ss FROM (SELECT id, coalesce(entityname, '') AS name, related_names FROM fsrc)) WHERE len(list_filter(ss, lambda x: x IS NOT NULL)) > 0)
SELECT fl.manager AS manager_name, fl.cik, CASE WHEN coalesce(fl.manager, '') = '' THEN 'INCONCLUSIVE' WHEN f.entityname IS NOT NULL AND f.id IN (SELECT id FROM sg2) THEN 'PLATFORM_FILING' WHEN coalesce(upper(trim(f.stateorcountry)) <> '' AND NOT list_contains({list(M.HOME)}, upper(trim(f.stateorcountry))), false) THEN 'LIKELY_FOREIGN'
  WHEN kl.source IN ('adviser_owners', 'database_related_person') THEN 'LIKELY_FP_PRINCIPAL' WHEN kl.source IS NOT NULL THEN 'LIKELY_FP_NAME' WHEN al.id IS NOT NULL THEN 'LIKELY_FP_PRINCIPAL' ELSE 'LIKELY_TRUE' END AS category
FROM fl JOIN fsrc f ON f.id = fl.manager LEFT JOIN kl ON kl.manager = fl.manager LEFT JOIN al ON al.id = fl.manager""", "notices", "registry", "owners")
def mx14(spark, d):
    flagged = unregistered(spark, d).select(F.get_json_object("metadata", "$.manager_name").alias("manager_name"), F.col("form_d_cik").alias("cik"))
    return I.audited(flagged, table(spark, d, "notices"), *base_tables(spark, d))


def _second_lookup() -> str:
    """The audit looks its own rows up again: the CTEs of a lookup under other names."""
    import re

    text = _lookup("ktries", True)
    for name in ("ky", "bs", "ask", "nd", "h1", "pr", "p1", "p2", "ow", "h3", "q1", "q2", "q3", "q4", "q5", "h4", "al4", "lk"):
        text = re.sub(rf"\b{name}\b(?! :=)", f"k{name}", text)
    return "ktries AS (SELECT f.id AS key, f.id AS name, related_names, related_roles FROM fsrc f), " + text


SQL["mx14_flag_audit"] = SQL["mx14_flag_audit"].replace("kl AS (SELECT", _second_lookup() + ", kl AS (SELECT", 1)

# --- issues over the cross-reference ------------------------------------------------------------------------------

_BASE = with_views("", *_ALL).rstrip() + "," + _XREF


def overdue(t, m):
    return I.overdue(m, t("filings"), DUE + 1)


def violations(t, m):
    return I.venture_violations(t("advisers"), t("funds"), t("filings"), m)


def types(t, m):
    return I.type_mismatches(m, t("funds"), t("filings"))


def missing(t, m):
    funds, filings, advisers = t("funds"), t("filings"), t("advisers")
    by_number = detectors.missing_funds(funds, filings, m, DUE)
    return I.missing_funds(by_number, detectors.named_in_filings(advisers, filings, m, DUE), filings, funds, advisers, m)


def exemptions(t, m):
    return I.exemption_mismatches(m, t("funds"), t("filings"))


def _json(**fields: str) -> str:
    return "to_json(struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + "))::VARCHAR"


_YES = "coalesce({} IN ('Y', 'true'), false)"
_SKIP = "('LLC', 'LP', 'INC', 'CAPITAL', 'PARTNERS', 'MANAGEMENT', 'FUND', 'ADVISORS', 'ADVISERS', 'INVESTMENTS', 'GROUP', 'HOLDINGS', 'THE', 'AND', 'OF')"
_PARTS = {
    "overdue_annual_amendment": f"""o1 AS (SELECT adviser_entity_crd AS crd, min(adviser_name) AS name, max(latest_adv_year) AS latest FROM matches WHERE adviser_entity_crd IS NOT NULL GROUP BY 1 HAVING max(latest_adv_year) < {DUE + 1}),
o2 AS (SELECT DISTINCT adviser_entity_crd AS crd, accessionnumber, cik, year({_DAY}) AS y FROM matches JOIN filings USING (accessionnumber)), o3 AS (SELECT o1.crd, count(*) AS n, list(accessionnumber ORDER BY accessionnumber)[1:5] AS l, arg_min(cik, accessionnumber) AS cik FROM o1 JOIN o2 ON o1.crd = o2.crd AND y > latest GROUP BY o1.crd),
i1 AS (SELECT 'overdue_annual_amendment' AS discrepancy_type, 'high' AS severity, o1.crd::BIGINT AS adviser_crd, cik::VARCHAR AS form_d_cik, {_said('overdue_annual_amendment', 'name', 'latest')} || CASE WHEN coalesce(n, 0) > 0 THEN {_said('filings_since', 'n')} ELSE '' END AS description,
  {_json(adviser_name='name', latest_adv_year='latest', form_d_count_after_adv='coalesce(n, 0)', form_d_filings_after_adv='coalesce(l, CAST([] AS VARCHAR[]))')} AS metadata FROM o1 LEFT JOIN o3 ON o1.crd = o3.crd)""",
    "vc_exemption_violation": f"""v1 AS (SELECT adviser_entity_crd AS crd, fund_id, fund_name, trim(fund_type) AS kind, nullif(list_filter(list_transform(string_split_regex(form_d_file_number, '[;,|]'), lambda x: trim(x)), lambda x: x <> '')[1], '') AS fn, trim(lower(fund_type)) <> '' AND (regexp_matches(lower(fund_type), '{I.NOT_VENTURE}') OR NOT (contains(lower(fund_type), 'venture capital') OR lower(trim(fund_type)) = 'vc')) AS bad FROM funds WHERE adviser_entity_crd IN (SELECT crd FROM advisers WHERE lower(exemption_2b1) IN ('y', 'true'))),
v2 AS (SELECT crd, string_agg(n || ' ' || kind, ', ' ORDER BY n || ' ' || kind) AS b, sum(n)::BIGINT AS n FROM (SELECT crd, kind, count(*) AS n FROM v1 WHERE bad GROUP BY ALL) GROUP BY crd), v3 AS (SELECT crd, count(*) AS total FROM v1 GROUP BY crd),
v4 AS (SELECT crd, arg_min(fund_name, fund_id) AS pn, arg_min(kind, fund_id) AS pk, arg_min(fn, fund_id) AS pf, list(fund_name ORDER BY fund_id)[1:5] AS sample FROM v1 WHERE bad GROUP BY crd), v5 AS (SELECT file_num, arg_max(cik, id)::VARCHAR AS cik FROM filings GROUP BY 1),
v6 AS (SELECT adviser_entity_crd AS crd, arg_min(cik, accessionnumber)::VARCHAR AS fallback FROM matches JOIN filings USING (accessionnumber) GROUP BY 1),
i2 AS (SELECT 'vc_exemption_violation' AS discrepancy_type, 'critical' AS severity, a.crd::BIGINT AS adviser_crd, coalesce(v5.cik, fallback) AS form_d_cik, {_said('vc_exemption_violation', 'adviser_name', 'n', 'b')} AS description,
  {_json(exemption_claimed="'vc_203l1'", non_vc_fund_count='n', total_funds='total', primary_fund_name='pn', primary_fund_type='pk', primary_fund_form_d_file_num='pf', primary_formd_cik='v5.cik', sample_non_vc_funds='sample')} AS metadata FROM advisers a JOIN v2 USING (crd) JOIN v3 USING (crd) JOIN v4 USING (crd) LEFT JOIN v5 ON v5.file_num = pf LEFT JOIN v6 USING (crd))""",
    "fund_type_mismatch": f"""i3 AS (SELECT 'fund_type_mismatch' AS discrepancy_type, 'medium' AS severity, m.adviser_entity_crd::BIGINT AS adviser_crd, cik::VARCHAR AS form_d_cik, {_said('fund_type_mismatch', 'fund_name', 'm.fund_type', 'm.investmentfundtype')} AS description,
  {_json(adv_fund_name='fund_name', formd_entity_name='entityname', adv_fund_type='m.fund_type', formd_fund_type='m.investmentfundtype', formd_accession='m.accessionnumber', formd_filing_date='filing_date', adviser_name='adviser_name')} AS metadata
  FROM matches m JOIN funds USING (fund_id) JOIN filings USING (accessionnumber) WHERE m.fund_type <> '' AND m.investmentfundtype <> '' AND NOT list_has_any(list_filter({_family('m.fund_type')}, lambda x: x IS NOT NULL), list_filter({_family('m.investmentfundtype')}, lambda x: x IS NOT NULL)))""",
    "missing_fund_in_adv": f"""n1 AS (SELECT accessionnumber, min(adviser_entity_crd) AS crd FROM numbers JOIN funds USING (fund_id) JOIN filings ON trim(raw) = file_num WHERE adviser_entity_crd IS NOT NULL AND year({_DAY}) < {DUE} AND accessionnumber NOT IN (SELECT accessionnumber FROM matches) GROUP BY 1),
kw AS (SELECT crd, list_filter(string_split_regex(upper(adviser_name), '\\s+'), lambda w: length(w) > 2 AND w NOT IN {_SKIP})[1:3] AS w FROM advisers), kinds0 AS (SELECT w, min(crd) AS crd FROM kw GROUP BY w), texts AS (SELECT DISTINCT upper(entityname) AS e FROM filings), hit AS (SELECT e, min(crd) AS crd FROM texts JOIN kinds0 ON len(list_filter(w, lambda x: contains(e, x))) >= 2 GROUP BY e),
n2 AS (SELECT accessionnumber, crd FROM filings JOIN hit ON upper(entityname) = e WHERE year({_DAY}) < {DUE} AND accessionnumber NOT IN (SELECT accessionnumber FROM matches)),
n3 AS (SELECT accessionnumber, crd, 'form_d_file_number' AS way FROM n1 UNION ALL SELECT accessionnumber, crd, 'name_matching' FROM n2 WHERE accessionnumber NOT IN (SELECT accessionnumber FROM n1)),
fn AS (SELECT adviser_entity_crd AS crd, trim(raw) AS file_num, arg_min(fund_name, fund_id) AS adv_fund FROM numbers JOIN funds USING (fund_id) GROUP BY ALL),
ly AS (SELECT adviser_entity_crd AS crd, max(latest_adv_year) AS latest FROM matches GROUP BY 1),
i5 AS (SELECT 'missing_fund_in_adv' AS discrepancy_type, 'medium' AS severity, crd::BIGINT AS adviser_crd, cik::VARCHAR AS form_d_cik, CASE way WHEN 'form_d_file_number' THEN {_said('missing_by_number', 'entityname', 'filing_date', 'filings.file_num', 'adv_fund')} ELSE {_said('missing_by_name', 'entityname', 'filing_date', 'latest', 'adviser_name')} END AS description, {_json(detection_strategy='way', fund_name='entityname', form_d_file_number='filings.file_num', formd_accession='accessionnumber')} AS metadata FROM n3 JOIN filings USING (accessionnumber) LEFT JOIN fn USING (crd, file_num) LEFT JOIN ly USING (crd) LEFT JOIN (SELECT crd, adviser_name FROM advisers) USING (crd))""",
    "exemption_mismatch": f"""x1 AS (SELECT m.adviser_entity_crd, fund_name, entityname, accessionnumber, {_YES.format('exclusion_3c1')} AS a1, {_YES.format('exclusion_3c7')} AS a7, coalesce(contains(lower(exemptions), '3c.1') OR contains(lower(exemptions), '3(c)(1)') OR (contains(lower(exemptions), '3c') AND NOT contains(lower(exemptions), '3c.7') AND NOT contains(lower(exemptions), '3(c)(7)')), false) AS f1, coalesce(contains(lower(exemptions), '3c.7') OR contains(lower(exemptions), '3(c)(7)'), false) AS f7 FROM matches m JOIN funds USING (fund_id) JOIN filings USING (accessionnumber)),
i6 AS (SELECT 'exemption_mismatch' AS discrepancy_type, 'high' AS severity, adviser_entity_crd::BIGINT AS adviser_crd, NULL::VARCHAR AS form_d_cik, {_said('exemption_mismatch', 'fund_name', *(f"CASE WHEN {x} THEN 'Y' ELSE 'N' END" for x in ('a1', 'a7', 'f1', 'f7')))} AS description,
  {_json(adv_fund_name='fund_name', formd_entity_name='entityname', adv_3c1='a1', adv_3c7='a7', formd_3c1='f1', formd_3c7='f7', formd_accession='accessionnumber')} AS metadata FROM x1 WHERE a1 <> f1 OR a7 <> f7)""",
}
_NAMES = {"overdue_annual_amendment": ("de02_overdue_issues", "i1", overdue), "vc_exemption_violation": ("de03_venture_issues", "i2", violations), "fund_type_mismatch": ("de04_type_issues", "i3", types), "missing_fund_in_adv": ("de05_missing_issues", "i5", missing), "exemption_mismatch": ("de06_exemption_issues", "i6", exemptions)}
for _kind, (_name, _cte, _make) in _NAMES.items():

    @query(_name)
    def one_kind(spark, d, make=_make):
        return make(lambda name: table(spark, d, name), matches(spark, d))

    SQL[_name] = f"{_BASE}, {_PARTS[_kind]} SELECT * FROM {_cte}"


_BRIEF = ("discrepancy_type", "severity", "adviser_crd", "description")


def five_kinds(spark, d):
    """_BRIEF of the issues of five detectors, each run as a job of its own.

    One plan of all of them reads the derived tables a hundred times, and its stages, metrics and code don't fit in a
    driver; so tables that many read are made once, and a detector's plan is over before the next one's begins.
    """
    made = {name: work.written(table(spark, d, name), name) for name in ("filings", "advisers")}
    t = lambda name: made.get(name) or table(spark, d, name)
    m = work.written(cross_reference(*(t(name) for name in ("funds", "filings", "advisers", "fund_years")), due_year=DUE), "matches")
    return [work.written(make(t, m).select(*_BRIEF), kind) for kind, (_, _, make) in _NAMES.items()]


def every_issue(spark, d):
    """Issues of all six detectors."""
    return I.all_of(unregistered(spark, d).select(*_BRIEF), *five_kinds(spark, d))


_EVERY = with_views("", *_ALL, "notices", "registry", "owners").rstrip() + "," + _XREF + ", " + ", ".join(_PARTS.values())
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rank"
_UNION = " UNION ALL ".join(f"SELECT discrepancy_type, severity, adviser_crd, description FROM {c}" for _, c, _ in _NAMES.values())


@query("de08_five_detectors")
def de08(spark, d):
    return I.all_of(*five_kinds(spark, d))


SQL["de08_five_detectors"] = f"{_EVERY} SELECT *, {_RANK} FROM ({_UNION})"


@query("st03_six_detectors", None)
def st03(spark, d):
    return every_issue(spark, d)


_UN = _UNREGISTERED.replace("matched", "nmatched")
SQL["st03_six_detectors"] = f"""{_EVERY}, {_UN}, iu AS (SELECT 'needs_initial_adv_filing' AS discrepancy_type, CASE WHEN len(tags) > 0 THEN 'low' ELSE 'high' END AS severity, NULL::BIGINT AS adviser_crd, {_said('needs_initial_adv_filing', 'manager', 'n', 'first', 'days')} AS description FROM un)
SELECT *, {_RANK} FROM ({_UNION} UNION ALL SELECT * FROM iu)"""


@query("ag07_issue_summary")
def ag07(spark, d):
    return I.summary(de08(spark, d))


SQL["ag07_issue_summary"] = f"{_EVERY} SELECT discrepancy_type, count(*) AS n, min(description) AS sample FROM ({_UNION}) GROUP BY 1"


@query("ag23_issue_cases")
def ag23(spark, d):
    grave = F.when(F.col("rank") < 2, "grave").otherwise("other")
    return de08(spark, d).groupBy("discrepancy_type", grave.alias("grade")).agg(F.count("*").alias("n"))


SQL["ag23_issue_cases"] = f"{_EVERY} SELECT discrepancy_type, CASE WHEN severity IN ('critical', 'high') THEN 'grave' ELSE 'other' END AS grade, count(*) AS n FROM ({_UNION}) GROUP BY ALL"

# --- the older detectors ------------------------------------------------------------------------------------------

_CONTACT = "adviser_name AS entity_name, regulatory_contact_email AS email, phone_number AS phone, primary_website AS website"


def _flat(rows):
    return rows.select(*(c for c in rows.columns if c != "contact_info"), "contact_info.email", "contact_info.phone", "contact_info.website")


@query("de07_old_unregistered", f""", r AS (SELECT trim({_MASTER.format('entityname')}) AS entity_name, count(*) AS fund_count, min({_DAY}) AS first FROM notices WHERE {_MASTER.format('entityname')} <> '' GROUP BY 1), s AS (SELECT *, abs(date_diff('day', first, DATE '{NOW}')) AS days_since_filing, lower(string_split(entity_name, ' ')[1]) AS w FROM r)
SELECT entity_name, fund_count, days_since_filing, days_since_filing - 60 AS days_overdue FROM s WHERE days_since_filing > 60 AND NOT EXISTS (SELECT 1 FROM registry WHERE contains(lower(coalesce(adviser_name, '')), w) OR contains(lower(coalesce(adviser_entity_legal_name, '')), w))""", "notices", "registry")
def de07a(spark, d):
    return I.old_unregistered(table(spark, d, "notices"), table(spark, d, "registry"), NOW)


@query("de07_old_overdue")
def de07b(spark, d):
    return _flat(I.old_overdue(matches(spark, d), table(spark, d, "registry"), NOW))


SQL["de07_old_overdue"] = with_views("", *_ALL, "registry").rstrip() + "," + _XREF + f" SELECT g.crd, latest_adv_year, fund_count, {_CONTACT} FROM (SELECT adviser_entity_crd AS crd, max(latest_adv_year) AS latest_adv_year, count(*) AS fund_count FROM matches WHERE latest_adv_year < year(DATE '{NOW}') AND adviser_entity_crd IS NOT NULL GROUP BY 1) g LEFT JOIN registry r ON r.crd = g.crd"


@query("de07_old_venture_violations", f"""SELECT g.*, {_CONTACT} FROM (SELECT adviser_entity_crd AS crd, count(*) AS total_funds, count_if(coalesce(regexp_matches(lower(fund_type), '{I.NOT_VENTURE_OLD}'), false))::BIGINT AS non_vc_fund_count FROM vehicles WHERE adviser_entity_crd IN (SELECT crd FROM registry WHERE exemption_2b1 = 'Y') GROUP BY 1) g LEFT JOIN registry r ON r.crd = g.crd WHERE non_vc_fund_count > 0""", "vehicles", "registry")
def de07c(spark, d):
    return _flat(I.old_venture_violations(table(spark, d, "registry"), table(spark, d, "vehicles")))


def scored(spark, d):
    return matches(spark, d).withColumn("match_score", F.when(F.col("method") == "file_number", 1.0).otherwise(F.when(F.col("fund_id") % 2 == 0, 0.95).otherwise(0.8)))


_SCORED = ", sm AS (SELECT *, CASE WHEN method = 'file_number' THEN 1.0 WHEN fund_id % 2 = 0 THEN 0.95 ELSE 0.8 END AS match_score FROM matches)"


@query("de07_old_type_mismatches")
def de07d(spark, d):
    return I.old_type_mismatches(scored(spark, d))


SQL["de07_old_type_mismatches"] = f"{_BASE}{_SCORED} SELECT fund_id, accessionnumber, adviser_entity_crd AS crd, {_standard('investmentfundtype')} AS form_d_type, {_standard('fund_type')} AS form_adv_type FROM sm WHERE match_score >= 0.9 AND {_standard('investmentfundtype')} <> {_standard('fund_type')}"


@query("de07_old_missing", f", {_MATCHED} SELECT accessionnumber, entityname, n.id % 90 AS crd, {_CONTACT} FROM notices n JOIN registry r ON r.crd = n.id % 90 WHERE industrygrouptype = 'Pooled Investment Fund' AND n.id % 3 = 0 AND accessionnumber NOT IN (SELECT accessionnumber FROM matched)", "notices", "registry")
def de07e(spark, d):
    linked = table(spark, d, "notices").withColumn("linked_crd", F.when(F.col("id") % 3 == 0, F.col("id") % 90))
    return _flat(I.old_missing(linked, matched(spark, d), table(spark, d, "registry")))


@query("de07_old_exemption_mismatches")
def de07f(spark, d):
    named = table(spark, d, "filings").withColumn("exemptions", F.replace(F.replace("exemptions", F.lit("3C.1"), F.lit("3(c)(1)")), F.lit("3C.7"), F.lit("3(c)(7)")))
    return I.old_exemption_mismatches(scored(spark, d), table(spark, d, "funds"), named)


_E = "replace(replace(coalesce(exemptions, ''), '3C.1', '3(c)(1)'), '3C.7', '3(c)(7)')"
SQL["de07_old_exemption_mismatches"] = f"""{_BASE}{_SCORED}, e AS (SELECT sm.fund_id, accessionnumber, sm.adviser_entity_crd AS crd, {_YES.format('exclusion_3c1')} AS a1, {_YES.format('exclusion_3c7')} AS a7, contains({_E}, '3(c)(1)') AS f1, contains({_E}, '3(c)(7)') AS f7 FROM sm JOIN funds USING (fund_id) JOIN filings USING (accessionnumber) WHERE match_score >= 0.9)
SELECT fund_id, accessionnumber, crd, CASE WHEN f1 THEN '3(c)(1)' WHEN f7 THEN '3(c)(7)' ELSE 'Unknown' END AS form_d_exemption, CASE WHEN a1 THEN '3(c)(1)' WHEN a7 THEN '3(c)(7)' ELSE 'Unknown' END AS form_adv_exemption FROM e WHERE (f1 AND NOT a1 AND a7) OR (f7 AND NOT a7 AND a1)"""


@query("jn11_ciks_of_advisers")
def jn11(spark, d):
    return I.first_ciks(matches(spark, d), table(spark, d, "filings")).select("crd", F.array_join("ciks", ",").alias("ciks"))


SQL["jn11_ciks_of_advisers"] = f"{_BASE}, c AS (SELECT adviser_entity_crd AS crd, cik::VARCHAR AS cik, min(accessionnumber) AS first FROM matches JOIN filings USING (accessionnumber) WHERE adviser_entity_crd IS NOT NULL GROUP BY ALL) SELECT crd, string_agg(cik, ',' ORDER BY first, cik) AS ciks FROM c GROUP BY crd"
