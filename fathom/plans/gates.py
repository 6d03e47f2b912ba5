"""SQL for matches by shared words, for weighted similarity and for decisions on pages and persons."""

from __future__ import annotations

from fathom.functions import names as N
from fathom.plans.catalog import _ALL, _DAY, _XREF, BLOCKED, SQL
from fathom.plans.matching import _GATE_WORDS, _MAILS, _MASTER, _PAIRS, _SITE_WORDS, _SITES, _words_sql
from fathom.sources.views import with_views


def jaro_winkler_sql(a: str, b: str) -> str:
    """With a tenth for each equal first character at any similarity; DuckDB's own adds it from .7 on only."""
    jaro = f"jaro_similarity(lower({a}), lower({b}))"
    same = " + ".join(f"(least(length({a}), length({b})) >= {n} AND lower({a})[1:{n}] = lower({b})[1:{n}])::INT" for n in (1, 2, 3, 4))
    return f"({jaro} + ({same}) * 0.1 * (1 - {jaro}))"


def shared_sql(a: str, b: str) -> str:
    return f"list_intersect({_GATE_WORDS.format(a)}, {_GATE_WORDS.format(b)})"


def passes_sql(shared: str) -> str:
    return f"(len({shared}) >= 2 OR len(list_filter({shared}, lambda w: length(w) >= 5)) > 0)"


_ROLLED = f"""
SELECT {_MASTER} AS series_master, count(*) AS n_filings, sum(amount::DECIMAL(18,2))::DOUBLE AS total_amount, min({_DAY}) AS first_filing
FROM {{src}} WHERE isamendment <> 'true' AND {_MASTER} <> '' AND NOT regexp_matches(lower({_MASTER}), '{BLOCKED}') GROUP BY 1"""

SQL["jn19_blocked_match"] = with_views(
    f"""
SELECT series_master, crd AS key, len(shared)::INT AS shared
FROM (SELECT series_master, crd, adviser_name, {shared_sql('series_master', 'adviser_name')} AS shared FROM ({_ROLLED.format(src='filings')}), advisers)
WHERE {passes_sql('shared')}
QUALIFY row_number() OVER (PARTITION BY series_master ORDER BY len(shared) DESC, length(adviser_name), crd) = 1""",
    "filings",
    "advisers",
)

SQL["de01_needs_registration"] = f"""{with_views("", *_ALL).rstrip()},{_XREF},
recent AS (
  SELECT * FROM filings
  WHERE {_DAY} >= DATE '1998-06-30' - INTERVAL 6 MONTH AND date_diff('day', {_DAY}, DATE '1998-06-30') > 60
    AND accessionnumber NOT IN (SELECT accessionnumber FROM matches)),
rolled AS ({_ROLLED.format(src='recent')})
SELECT *, 'high' AS severity FROM rolled
WHERE NOT EXISTS (SELECT 1 FROM advisers WHERE {passes_sql(shared_sql('series_master', 'adviser_name'))})"""


def weighed_sql(words: str) -> str:
    return f"list_filter({words}, lambda w: NOT list_contains({list(N.WEIGHED_COMMON)}, w))"


def weighted_sql(a: str, b: str) -> str:
    """Weighted similarity of two names."""
    wa, wb = f"list_distinct({_words_sql(a)})", f"list_distinct({_words_sql(b)})"
    ta, tb = weighed_sql(wa), weighed_sql(wb)
    part = lambda x, y: f"coalesce(len(list_intersect({x}, {y})) / nullif(least(len({x}), len({y})), 0), 0)"
    ratio = f"least(length({a}), length({b})) / greatest(length({a}), length({b}))"
    return f"""CASE WHEN len({wa}) = 0 OR len({wb}) = 0 THEN 0.0
      ELSE 0.5 * {part(ta, tb)} + 0.2 * {part(wa, wb)} + 0.2 * {jaro_winkler_sql(a, b)} + 0.1 * {ratio} END"""


SQL["si04_weighted"] = with_views("", "names").rstrip() + f", {_PAIRS} SELECT id, a, b, round({weighted_sql('a', 'b')}, 6) AS score FROM pairs"

_STAFF = N.PLATFORM_STAFF.replace("'", "''")
SQL["mx03_gate"] = with_views("", "names").rstrip() + f""", {_PAIRS},
judged AS (
  SELECT p.id, b, {shared_sql('a', 'b')} AS s,
         len(list_filter(string_split(coalesce(related_names, ''), '|'), lambda p: length(trim(p)) > 2 AND NOT regexp_matches(p, '{_STAFF}'))) AS persons
  FROM pairs p JOIN names USING (id)),
counted AS (SELECT *, len(s) AS n, s[1] AS token, len(s) = 1 AND length(s[1]) >= 5 AS long FROM judged)
SELECT id, b, n >= 2 OR long AS passes, n = 1 AND NOT long AND persons > 0 AS downgrade,
       CASE WHEN n >= 2 THEN 'shares_' || n || '_distinctive_tokens'
            WHEN long THEN 'single_long_distinctive:' || token
            WHEN n = 1 AND persons > 0 THEN 'acronym_' || token || '_weak_corroboration_' || persons || '_persons'
            WHEN n = 1 THEN 'acronym_' || token || '_no_corroboration'
            ELSE 'zero_shared_distinctive_tokens' END AS reason
FROM counted"""

_SLUG = r"coalesce(lower(regexp_extract(value, '(?i)linkedin\.com/company/([^/?#]+)', 1)), '')"
_PAGES = f"""
p1 AS (
  SELECT e.id, value, place, {_SLUG} AS slug, {_SITE_WORDS} AS words, coalesce(anchor = 'website_links_to_linkedin', false) AS linked, coalesce(s.status = 'verified', false) AS sure
  FROM (SELECT * FROM evidence WHERE type = 'linkedin_company_url') e LEFT JOIN firms f ON e.id = f.id LEFT JOIN (SELECT id, status FROM sited) s ON e.id = s.id),
p2 AS (SELECT *, slug <> '' AND len(list_filter(words, lambda w: contains(slug, w))) > 0 AS named FROM p1),
p3 AS (
  SELECT *, CASE WHEN linked THEN 0 WHEN sure AND named THEN 1 ELSE 2 END AS r,
         CASE WHEN linked AND sure THEN ['verified', 'found_on_verified_website'] WHEN linked THEN ['candidate', 'website_links_to_linkedin_but_website_not_verified']
              WHEN sure AND named THEN ['candidate', 'slug_token_match_with_verified_website'] WHEN slug <> '' AND (named OR len(words) = 0) THEN ['candidate', 'search_result_candidate'] END AS v
  FROM p2),
paged AS (
  SELECT id, coalesce(arg_min(v[1], r * 100000000 + place) FILTER (v IS NOT NULL), 'rejected') AS status, arg_min(value, r * 100000000 + place) FILTER (v IS NOT NULL) AS value,
         coalesce(arg_min(v[2], r * 100000000 + place) FILTER (v IS NOT NULL), 'slug_no_distinctive_token') AS reason
  FROM p3 GROUP BY id)"""
_DECIDED = with_views("", "evidence", "firms").rstrip() + f", {_SITES},{_PAGES}"
SQL["ru02_company_pages"] = f"{_DECIDED} SELECT * FROM paged"

_TEAM = f"""
t1 AS (
  SELECT id, value, source, anchor, title FROM evidence
  WHERE type = 'team_member' AND value <> '' AND NOT regexp_matches(value, '(?i)\\b(LLC|LP|Inc|Corp|Ltd|Fund|Trust|Foundation)\\b') AND NOT regexp_matches(value, '{_STAFF}')
  QUALIFY row_number() OVER (PARTITION BY id, lower(trim(value)) ORDER BY place) = 1),
t2 AS (
  SELECT t1.id, t1.value, coalesce(source, '') AS source, coalesce(anchor, '') AS anchor, {_SITE_WORDS} AS words, lower(coalesce(title, '')) AS title,
         coalesce(s.status, '') AS site, coalesce(p.status, '') AS page
  FROM t1 LEFT JOIN firms f ON t1.id = f.id LEFT JOIN sited s ON t1.id = s.id LEFT JOIN paged p ON t1.id = p.id),
t3 AS (SELECT *, site = 'verified' OR page = 'verified' AS sure, len(list_filter(words, lambda w: contains(title, w))) > 0 AS says, anchor = 'found_on_candidate_website' AS here FROM t2),
teamed AS (
  SELECT id, value, CASE
      WHEN here AND site = 'verified' THEN ['verified', 'on_verified_website'] WHEN here AND site = 'candidate' THEN ['candidate', 'on_candidate_website_only'] WHEN here THEN ['rejected', 'website_not_verified']
      WHEN contains(source, 'linkedin_search') AND sure AND says THEN ['candidate', 'linkedin_search_with_anchor'] WHEN contains(source, 'linkedin_search') THEN ['rejected', 'unanchored_linkedin_search_no_firm_match']
      WHEN starts_with(source, 'external_db:') THEN ['candidate', 'external_db_contact'] WHEN sure THEN ['candidate', 'unanchored_with_context'] ELSE ['rejected', 'no_anchor_available'] END AS v
  FROM t3)"""
SQL["ru03_team"] = f"{_DECIDED},{_TEAM} SELECT id, v[1] AS status, value, v[2] AS reason FROM teamed"

SQL["pj13_public_view"] = f"""{_DECIDED}, {_MAILS},
shown AS (
  SELECT f.id, s.value AS website, p.value AS linkedin, m.value AS email
  FROM firms f LEFT JOIN (FROM sited WHERE status = 'verified') s ON f.id = s.id LEFT JOIN (FROM paged WHERE status = 'verified') p ON f.id = p.id LEFT JOIN (FROM mailed WHERE status = 'verified') m ON f.id = m.id)
SELECT id, website, linkedin, CASE WHEN website IS NOT NULL OR linkedin IS NOT NULL THEN email END AS email, website IS NULL AND linkedin IS NULL AS suppressed FROM shown"""
