"""Registered queries of close matches, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import matching as M
from fathom.operators import verdicts as V
from fathom.plans.catalog import query
from fathom.plans.gates import jaro_winkler_sql, weighed_sql, weighted_sql
from fathom.plans.matching import _GATE_WORDS, _LADDER, _TELL, _words_sql, form_sql
from fathom.sources.views import table


def managers(spark, d):
    """Records under their manager's name, with the adviser that they are linked to, else the one of the same name."""
    named = table(spark, d, "registry").filter("adviser_name <> ''").groupBy(F.lower("adviser_name").alias("key")).agg(F.min("crd").alias("same"))
    name = F.coalesce(F.nullif(T.series_master(F.col("series_master_llc")), F.lit("")), "series_master_llc")
    rows = table(spark, d, "records").select("id", name.alias("name"), "linked_crd", F.lower(name).alias("key"))
    return rows.join(named, "key", "left").select("id", "name", F.coalesce("linked_crd", "same").alias("matched"))


def firms(spark, d):
    return table(spark, d, "registry").select("crd", F.array("adviser_name", "adviser_entity_legal_name", "other_business_names").alias("names"))


def judged(spark, d):
    ours = managers(spark, d)
    # managers of one name have the same hits, which are scored once
    names = ours.select(F.col("name").alias("id"), "name").distinct()
    return V.close_matches(ours, V.scored(V.hits(names, firms(spark, d))).withColumnRenamed("id", "name"), "name")


_MASTER = r"regexp_extract(series_master_llc, '(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$', 1)"
_WORDS = lambda c: weighed_sql(f"list_distinct({_words_sql(c)})")
_JUDGED = f"""
n AS (
  SELECT id, coalesce(nullif({_MASTER}, ''), series_master_llc) AS name, linked_crd FROM records),
m AS (
  SELECT id, name, coalesce(linked_crd, (SELECT min(crd) FROM registry WHERE adviser_name <> '' AND lower(adviser_name) = lower(name))) AS matched FROM n),
f AS (
  SELECT DISTINCT crd, found FROM (SELECT crd, unnest([adviser_name, adviser_entity_legal_name, other_business_names]) AS found FROM registry) WHERE found <> ''),
w AS (SELECT DISTINCT crd, unnest({_WORDS('found')}) AS word FROM f),
c AS (SELECT word, count(*) AS often FROM w GROUP BY word),
a AS (SELECT DISTINCT name FROM m WHERE name <> ''),
r AS (
  SELECT name, word FROM (SELECT name, unnest({_WORDS('name')}) AS word FROM a) JOIN c USING (word)
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY often, word) = 1),
j AS (
  SELECT name, crd, found, round({jaro_winkler_sql('name', 'found')}, 9) AS near, round({weighted_sql('name', 'found')}, 6) AS score
  FROM r JOIN w USING (word) JOIN f USING (crd)),
b AS (
  SELECT name, crd, max(near) AS near, max(score) AS score, arg_max(found, (score, found)) AS nearest FROM j GROUP BY name, crd
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY max(near) DESC, crd) <= {V.HITS}),
k AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, crd) AS place, lead(score) OVER (PARTITION BY name ORDER BY score DESC, crd) AS next FROM b),
t AS (
  SELECT id, matched, k.crd AS top_crd, k.nearest AS top_name, k.score AS top_score, k.next AS next_score,
         (SELECT score FROM b WHERE b.name = m.name AND b.crd = m.matched) AS matched_score
  FROM m LEFT JOIN k ON k.name = m.name AND k.place = 1),
judged AS (
  SELECT id, matched, CASE
      WHEN top_crd IS NULL THEN 'NOT_IN_IAPD_AT_ALL' WHEN matched IS NOT NULL AND matched_score IS NULL THEN 'MATCHED_CRD_NOT_IN_IAPD_TOP12' WHEN matched <> top_crd THEN 'WRONG_MATCH'
      WHEN matched IS NOT NULL AND top_score < 0.4 THEN 'WEAK_TOP_MATCH' WHEN matched IS NOT NULL AND round(top_score - next_score, 6) < 0.05 THEN 'AMBIGUOUS_CLOSE_COMPETITOR'
      WHEN matched IS NOT NULL THEN 'VERIFIED' WHEN top_score >= 0.5 THEN 'POSSIBLE_MISSED_REGISTRATION' ELSE 'TRULY_UNREGISTERED' END AS verdict,
    top_crd, top_name, top_score, next_score, matched_score
  FROM t)"""


@query("mx13_close_matches", f", {_JUDGED} SELECT * FROM judged", "records", "registry")
def mx13(spark, d):
    return judged(spark, d)


@query("ag25_verdict_buckets", f", {_JUDGED} SELECT verdict, count(*) AS n FROM judged GROUP BY verdict ORDER BY n DESC, verdict", "records", "registry")
def ag25(spark, d):
    return V.buckets(judged(spark, d))


def funds_by_name(spark, d):
    return table(spark, d, "vehicles").select("fund_id", F.col("fund_name").alias("name"))


def filings_by_name(spark, d):
    return table(spark, d, "notices").select("id", F.col("entityname").alias("name"))


_FORM_A, _FORM_B = form_sql("name", "server"), form_sql("text", "server")


@query("mx06_best_filing", f""",
a AS (SELECT DISTINCT fund_name AS name FROM vehicles WHERE fund_name <> ''),
b AS (SELECT entityname AS text, min(id) AS id FROM notices WHERE entityname IS NOT NULL GROUP BY 1),
k AS (
  SELECT name, left(name, {V.HEAD}) AS head, '%' || array_to_string(list_filter(list_transform(string_split(name, ' ')[1:{V.WORDS}], lambda w: replace(replace(w, '%', '!%'), '_', '!_')), lambda w: w <> ''), '%') || '%' AS words
  FROM a),
c AS (SELECT name, text, id FROM k JOIN b ON contains(lower(text), lower(head)) OR text ILIKE words ESCAPE '!'),
f AS (SELECT *, {_FORM_A} AS x, {_FORM_B} AS y FROM c),
s AS (SELECT *, round(CASE WHEN x = '' AND y = '' THEN 1 ELSE (greatest(length(x), length(y)) - levenshtein(x, y))::DOUBLE / greatest(length(x), length(y)) END, 9) AS score FROM f)
SELECT fund_id, s.id, score FROM vehicles JOIN s ON fund_name = name WHERE score > {V.ALIKE}
QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY score DESC, s.id) = 1""", "vehicles", "notices")
def mx06(spark, d):
    return V.best_filings(funds_by_name(spark, d), filings_by_name(spark, d))


_FITS = "list_has_any(ta, tb) AND ((list_has_all(a, b) AND list_has_all(tb, ta)) OR (list_has_all(b, a) AND list_has_all(ta, tb)))"


@query("mx04_by_legal_name", f""",
names AS (SELECT id, coalesce(nullif({_MASTER}, ''), series_master_llc) AS name FROM records), {_LADDER},
tries AS (SELECT id, v, min(k) AS k FROM (SELECT id, lower(v) AS v, k FROM ladder UNION ALL SELECT id, lower(name), 0 FROM names) GROUP BY ALL),
m AS (SELECT id, v, k, list_distinct({_words_sql('v')}) AS a, {_GATE_WORDS.format('v')} AS ga FROM tries),
n AS (SELECT crd AS key, adviser_name AS found, list_filter([lower(trim(adviser_name)), lower(trim(adviser_entity_legal_name))], lambda x: x <> '') AS l FROM registry),
y AS (SELECT key, found, list_distinct({_GATE_WORDS.format("array_to_string(l, ' ')")}) AS gb, unnest(l) AS own, generate_subscripts(l, 1) AS place FROM n),
z AS (SELECT *, list_distinct({_words_sql('own')}) AS b FROM y),
md AS (SELECT *, {_TELL.format('a')} AS ta FROM m), zd AS (SELECT *, {_TELL.format('b')} AS tb FROM z),
hit AS (
  SELECT id, v, k, key, found, ga, CASE WHEN own = v THEN 0 ELSE 1 END AS how
  FROM md JOIN zd ON own = v OR (list_has_any(ga, gb) AND len(b) >= CASE place WHEN 1 THEN 2 ELSE 3 END AND {_FITS})),
best AS (SELECT *, row_number() OVER (PARTITION BY id, v ORDER BY how, key) AS n FROM hit),
ok AS (SELECT *, list_intersect(ga, {_GATE_WORDS.format('found')}) AS s FROM best WHERE n = 1)
SELECT id, arg_min(key, k) AS key, arg_min(v, k) AS variant FROM ok WHERE len(s) >= 2 OR len(list_filter(s, lambda w: length(w) >= 5)) > 0 GROUP BY id""", "records", "registry")
def mx04(spark, d):
    """Records' managers among advisers under either of their names."""
    advisers = table(spark, d, "registry").select(F.col("crd").alias("key"), F.col("adviser_name").alias("name"), F.col("adviser_entity_legal_name").alias("legal_name"))
    return M.adviser_matches(managers(spark, d).select("id", "name"), advisers).select("id", "key", "variant")
