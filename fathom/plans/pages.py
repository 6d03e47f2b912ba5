"""Registered queries of what raw pages say, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import formats, scalars, web
from fathom.functions import html as H
from fathom.operators import pages as P
from fathom.plans.catalog import query
from fathom.plans.matching import _HOST, _PATH
from fathom.sources.views import table

quoted = lambda s: "'" + s.replace("'", "''") + "'"


def _decoded(text: str) -> str:
    """Named and numbered characters of a text as themselves."""
    number = lambda k: f"regexp_extract(p, '^(?:[xX]([0-9a-fA-F]{{1,6}})|([0-9]{{1,7}}));', {k})"
    code = f"CASE WHEN {number(1)} <> '' THEN ('0x' || {number(1)})::INT WHEN {number(2)} <> '' THEN {number(2)}::INT END"
    one = f"CASE WHEN i = 1 THEN p WHEN {code} BETWEEN 1 AND 1114111 THEN chr({code}) || p[length({number(0)}) + 1:] ELSE '&#' || p END"
    out = f"array_to_string(list_transform(string_split({text}, '&#'), lambda p, i: {one}), '')"
    for name, char in H.ENTITIES:
        out = f"replace({out}, {quoted(name)}, {quoted(char)})"
    return out


def _text(markup: str) -> str:
    plain = f"regexp_replace({markup}, '(?s)<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_decoded(plain)}, '\\s+', ' ', 'g'))"


def _attribute(attributes: str, name: str) -> str:
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = f"regexp_extract({attributes}, {quoted(pattern)}, 1)"
    bare = f"CASE WHEN {raw}[1] IN ('\"', '''') THEN {raw}[2:-2] ELSE {raw} END"
    return f"CASE WHEN {raw} <> '' THEN {_decoded(f'trim({bare})')} END"


_PAGE = f"regexp_replace(coalesce(html, ''), {quoted(H.RAW)}, ' ', 'g')"


@query("ht05_titles", f"""
SELECT page_id, nullif({_text(f"regexp_extract(page, {quoted(H.element_pattern('title'))}, 2)")}, '') AS title,
       nullif({_text(f"regexp_extract(page, {quoted(H.element_pattern('h1'))}, 2)")}, '') AS heading,
       {_attribute(r"regexp_extract(page, '(?is)<html((?:[\s/][^>]*)?)>', 1)", 'lang')} AS lang
FROM (SELECT page_id, {_PAGE} AS page FROM pages)""")
def ht05_titles(spark, d):
    return P.titles(table(spark, d, "pages"))


_BLOCKED = f"list_bool_or(list_transform({list(web.BLOCKED)}, lambda x: contains(lower(url), x)))"
_HOME = f"coalesce(length({_PATH}) < 20 OR regexp_matches({_PATH}, '{web.OWN_PATHS}') OR len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) = 1, false)"
_KIND = f"CASE WHEN regexp_matches(lower(url), '{web.FILE}') THEN 'file' WHEN {_BLOCKED} THEN 'blocked' WHEN regexp_matches(lower(url), '{web.ARTICLE}') THEN 'article' WHEN {_HOME} THEN 'homepage' ELSE 'other' END"
_SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*"
_FOLDER = f"regexp_extract(base, '^({_SCHEME}://[^/?#]+(?:/[^?#]*/|/)?)', 1)"
_LINKS = f"""
a AS (SELECT page_id, url AS base, regexp_extract_all({_PAGE}, {quoted(H.element_pattern('a'))}) AS e FROM firm_pages),
b AS (SELECT page_id, base, unnest(e) AS e, generate_subscripts(e, 1) - 1 AS place FROM a),
c AS (SELECT page_id, base, place, regexp_extract(e, {quoted(H.element_pattern('a'))}, 1) AS attributes, regexp_extract(e, {quoted(H.element_pattern('a'))}, 2) AS inside FROM b),
e AS (SELECT page_id, base, place, {_attribute('attributes', 'href')} AS href, {_text('inside')} AS text FROM c),
links AS (
  SELECT page_id, place, href, text, CASE
      WHEN regexp_matches(href, '^{_SCHEME}:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '^({_SCHEME}:)', 1) || href
      WHEN starts_with(href, '/') THEN regexp_extract(base, '^({_SCHEME}://[^/?#]+)', 1) || href
      WHEN starts_with(href, '#') OR starts_with(href, '?') THEN regexp_replace(base, '[?#].*$', '') || href
      ELSE CASE WHEN ends_with({_FOLDER}, '/') THEN {_FOLDER} ELSE {_FOLDER} || '/' END || href END AS url
  FROM e WHERE href IS NOT NULL)"""


@query("ht03_links", f", {_LINKS} SELECT page_id, place, href, url, text, {_HOST} AS host, {_KIND} AS kind FROM links", "firm_pages")
def ht03(spark, d):
    return P.links(table(spark, d, "firm_pages"))


_NAMES = " || ".join(f"regexp_extract_all(coalesce(html, ''), {quoted(p)}, 1)" for p in scalars.COMPANY_PLACES)


@query("ht04_company_names", f""",
n AS (SELECT page_id, list_filter(list_transform({_NAMES}, lambda x: trim(x)), lambda x: length(x) > 2 AND length(x) < 100 AND NOT regexp_matches(lower(x), 'portfolio|login|contact') AND NOT regexp_full_match(x, '\\d+')) AS l FROM firm_pages),
f AS (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:50] AS l FROM n)
SELECT page_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS name FROM f""", "firm_pages")
def ht04(spark, d):
    return P.company_names(table(spark, d, "firm_pages"))


_FOUND = f"regexp_extract_all(html, {quoted(H.PROFILE)}, 0)"
_NEAR = f"html[greatest(z - {H.AROUND}, 0) + 1 : greatest(z - {H.AROUND}, 0) + least(z, {H.AROUND}) + {H.AROUND}]"


@query("ht01_profiles", f""",
m AS (SELECT page_id, html, {_FOUND} AS f, string_split_regex(html, {quoted(H.PROFILE)}) AS s FROM firm_pages WHERE html IS NOT NULL),
l AS (
  SELECT page_id, html, f[i] AS link, i, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS z
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m)),
u AS (SELECT page_id, i, regexp_replace(regexp_extract(link, {quoted(H.PROFILE)}, 1), '/$', '') AS url, {_NEAR} AS near FROM l),
p AS (
  SELECT page_id, i, url, coalesce(nullif(regexp_extract(near, {quoted(rf'<[^>]*>({H.PERSON})</[^>]*>')}, 1), ''), nullif(regexp_extract(near, {quoted(rf'''alt=["']({H.PERSON})["']''')}, 1), '')) AS name
  FROM u),
q AS (
  SELECT * FROM p WHERE NOT contains(url, '/company/') AND NOT EXISTS (SELECT 1 FROM p o WHERE o.page_id = p.page_id AND o.i < p.i AND NOT contains(o.url, '/company/') AND contains(lower(o.url), lower(string_split(p.url, '/in/')[2])))),
k AS (SELECT page_id, url FROM p WHERE contains(url, '/company/') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) = 1)
SELECT page_id, 'company' AS kind, 0 AS place, url, NULL AS name FROM k
UNION ALL SELECT page_id, 'person', row_number() OVER (PARTITION BY page_id ORDER BY i) - 1, url, name FROM q""", "firm_pages")
def ht01(spark, d):
    return P.profile_links(table(spark, d, "firm_pages"))


_SOCIAL = " OR ".join(f"contains(lower({{0}}), {quoted(s)})" for s in formats.SOCIAL)


@query("ur04_best_sites", f"""
SELECT crd, CASE WHEN primary_website <> '' AND NOT ({_SOCIAL.format('primary_website')}) THEN primary_website
       ELSE coalesce(list_filter(string_split_regex(others, '[,;\\s]+'), lambda u: u <> '' AND NOT ({_SOCIAL.format('u')}))[1], nullif(primary_website, '')) END AS website
FROM (SELECT crd, primary_website, CASE crd % 3 WHEN 0 THEN 'https://x.com/a; ' || 'https://www.' || crd || '.org' WHEN 1 THEN 'https://medium.com/b' END AS others FROM registry)""", "registry")
def ur04(spark, d):
    crd = F.col("crd").cast("string")
    others = F.when(F.col("crd") % 3 == 0, F.concat(F.lit("https://x.com/a; https://www."), crd, F.lit(".org"))).when(F.col("crd") % 3 == 1, "https://medium.com/b")
    return table(spark, d, "registry").select("crd", formats.best_site(F.col("primary_website"), others).alias("website"))


_RESULTS = f"""
f AS (SELECT crd, adviser_name AS name, trim(regexp_replace(lower(adviser_name), ',?\\s*(lp|llc|l\\.p\\.|l\\.l\\.c\\.|ltd|limited|inc)\\s*$', '')) AS short FROM registry WHERE adviser_name IS NOT NULL),
r AS (
  SELECT crd, name, short, unnest(range(1, 4)) AS k,
         unnest([primary_website, 'https://www.crunchbase.com/' || crd, CASE crd % 3 WHEN 0 THEN 'https://other.com/team' WHEN 1 THEN 'https://other.com/deck.pdf' END]) AS url,
         unnest(['Home', 'Profile', 'The ' || string_split(short, ' ')[1] || ' team']) AS title
  FROM f JOIN (SELECT crd, primary_website FROM registry) USING (crd)),
g AS (SELECT *, {_KIND} = 'homepage' AS good, {_HOST} AS host, list_filter(string_split(short, ' '), lambda w: length(w) > 3) AS w FROM r),
h AS (SELECT *, coalesce(good AND len(list_filter(w, lambda x: contains(host, x))) > 0, false) AS one, coalesce(good AND contains(lower(title), string_split(short, ' ')[1]), false) AS two FROM g)"""


@query("ht05_site_choice", f""", {_RESULTS}
SELECT crd, coalesce(string_agg(url, ' ' ORDER BY k) FILTER (one), string_agg(url, ' ' ORDER BY k) FILTER (two), '') AS sites,
       CASE WHEN bool_or(one) THEN 'web_search:domain_match' WHEN bool_or(two) THEN 'web_search:title_match' END AS source
FROM h GROUP BY crd""", "registry")
def ht05_choice(spark, d):
    """Three results a firm: its own site if it has one, a data seller's page, and one that names it in its title."""
    crd, short = F.col("crd").cast("string"), F.trim(F.regexp_replace(F.lower("adviser_name"), r",?\s*(lp|llc|l\.p\.|l\.l\.c\.|ltd|limited|inc)\s*$", ""))
    result = lambda url, title: F.struct(url.alias("url"), title.alias("title"))
    third = F.when(F.col("crd") % 3 == 0, "https://other.com/team").when(F.col("crd") % 3 == 1, "https://other.com/deck.pdf")
    results = F.array(
        result(F.col("primary_website"), F.lit("Home")), result(F.concat(F.lit("https://www.crunchbase.com/"), crd), F.lit("Profile")), result(third, F.concat(F.lit("The "), F.get(F.split(short, " "), F.lit(0)), F.lit(" team"))),
    )
    chosen = table(spark, d, "registry").filter("adviser_name IS NOT NULL").select("crd", scalars.site_choice(results, F.col("adviser_name")).alias("c"))
    return chosen.select("crd", F.array_join(F.transform("c", lambda x: x["value"]), " ").alias("sites"), F.get("c", F.lit(0))["source"].alias("source"))
