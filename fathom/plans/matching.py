"""Registered queries of names, addresses of pages, matching and decisions, and the SQL each is held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.functions import web
from fathom.operators import core, decisions, detectors
from fathom.operators import matching as M
from fathom.plans.catalog import _ALL, _DAY, _XREF, BLOCKED, DUE, SQL, matches, query
from fathom.sources.views import table, with_views

_KEYS = {"sf02": "server", "sf03": "registration", "sf04": "fund", "sf05": "investor", "sf06": "manager", "sf07": "display", "sf08": "base", "sf09": "master", "sf10": "plain", "sf14": "entity", "sf15": "stripped"}
_EMPTY = "CAST([] AS VARCHAR[])"


def form_sql(c: str, form: str) -> str:
    case, steps = N.FORMS[form]
    quoted = lambda s: s.replace("'", "''").replace("$1", r"\1")
    return "trim(" + reduce(lambda x, s: f"regexp_replace({x}, '{quoted(s[0])}', '{quoted(s[1])}', 'g')", steps, f"{case}({c})" if case else c) + ")"


for _id, _form in _KEYS.items():

    @query(f"{_id}_form_{_form}", f"SELECT id, {form_sql('name', _form)} AS form FROM names", "names")
    def form(spark, d, name=_form):
        return table(spark, d, "names").select("id", N.normal(F.col("name"), name).alias("form"))


_SERIES = r"""coalesce(nullif(trim(regexp_extract(name, '(?i)[,\s]+a\s+series\s+of\s+(.+?)$', 1)), ''), nullif(trim(regexp_extract(name, '(?i)\s+-\s+series\s+of\s+(.+?)$', 1)), ''), CASE WHEN regexp_matches(regexp_extract(name, '(?i)^(.+?)\s+-\s+Series\s+[A-Za-z0-9]+$', 1), '(?i)partners|capital|management') THEN trim(regexp_extract(name, '(?i)^(.+?)\s+-\s+Series\s+[A-Za-z0-9]+$', 1)) END)"""
_ACTUAL = r"CASE WHEN length(trim(regexp_extract(name, '(?i)^(.+?),?\s+a\s+series\s+of\s+', 1))) > 5 AND NOT regexp_matches(trim(regexp_extract(name, '(?i)^(.+?),?\s+a\s+series\s+of\s+', 1)), '(?i)^Fund\s+[IVX\d]+$') THEN trim(regexp_extract(name, '(?i)^(.+?),?\s+a\s+series\s+of\s+', 1)) ELSE name END"


@query("sf11_parts_of_names", f"SELECT id, {_ACTUAL} AS fund, {_SERIES} AS manager, CASE WHEN trim(upper(name)) NOT IN ('N/A', '') AND upper({form_sql('name', 'party')}) NOT IN ('N/A', '') THEN {form_sql('name', 'party')} END AS party FROM names", "names")
def sf11(spark, d):
    name = F.col("name")
    return table(spark, d, "names").select("id", N.actual_fund(name).alias("fund"), N.series_manager(name).alias("manager"), N.party(name).alias("party"))


_LADDER = f"""a AS (SELECT id, name, {form_sql('name', 'stripped')} AS p, {form_sql('name', 'master')} AS m FROM names),
b AS (SELECT *, trim(regexp_replace(p, '(?i)\\s+({'|'.join(N.TAILS)})\\s*$', '')) AS cut, list_filter(regexp_split_to_array(p, '\\s+'), lambda w: length(w) >= 2) AS w FROM a),
c AS (SELECT id, name, unnest([p, trim(m), CASE WHEN cut <> p THEN cut END, CASE WHEN cut <> p THEN {form_sql('cut', 'stripped')} END, CASE WHEN len(w) >= 3 THEN w[1] || ' ' || w[2] END, CASE WHEN len(w) >= 2 AND NOT list_contains({list(N.GENERIC)}, lower(w[1])) THEN w[1] END]) AS v, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS k FROM b),
ladder AS (SELECT id, name, v, min(k) AS k FROM c WHERE length(v) >= 3 GROUP BY ALL)"""


@query("sf16_name_variants", f", {_LADDER} SELECT id, string_agg(v, '|' ORDER BY k) AS variants FROM ladder GROUP BY id", "names")
def sf16(spark, d):
    return N.with_variants(table(spark, d, "names").select("id", "name"), "name", extra="master").select("id", F.array_join("variants", "|").alias("variants"))


@query("sf20_exemption_labels", f"SELECT id, {form_sql('exemptions', 'exemptions')} AS labels FROM filings", "filings")
def sf20(spark, d):
    return table(spark, d, "filings").select("id", N.normal(F.col("exemptions"), "exemptions").alias("labels"))


def _words_sql(c: str, least: int = 2) -> str:
    return f"list_transform(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: length(w) >= {least}), lambda w: CASE WHEN length(w) >= 4 THEN regexp_replace(w, 's$', '') ELSE w END)"


_STOP = list({w for c in N.COMMON for w in (c, c[:-1] if len(c) >= 4 and c.endswith("s") else c)})


@query("tk02_telling_words", f"SELECT id, array_to_string(list_sort(list_distinct(list_filter({_words_sql('name')}, lambda w: NOT list_contains({_STOP}, w)))), ' ') AS words FROM names", "names")
def tk02(spark, d):
    return table(spark, d, "names").select("id", F.array_join(F.array_sort(N.telling(N.words_of(F.col("name")))), " ").alias("words"))


@query("tk08_keywords", "SELECT crd, array_to_string(list_filter(string_split_regex(upper(adviser_name), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('LLC', 'LP', 'INC', 'CAPITAL', 'PARTNERS', 'MANAGEMENT', 'FUND', 'ADVISORS', 'ADVISERS', 'INVESTMENTS', 'GROUP', 'HOLDINGS', 'THE', 'AND', 'OF'))[1:3], ' ') AS words FROM advisers", "advisers")
def tk08(spark, d):
    return table(spark, d, "advisers").select("crd", F.array_join(N.keywords(F.col("adviser_name")), " ").alias("words"))


_PAIRS = "pairs AS (SELECT x.id, x.name AS a, y.name AS b FROM names x JOIN names y ON y.id = x.id + 14 OR y.id = x.id + 1)"


def name_pairs(spark, d):
    """Every name with the names 14 and 1 ids further on."""
    rows = table(spark, d, "names").select("id", F.col("name").alias("b"))
    ours = rows.withColumnRenamed("b", "a").select("id", "a", F.explode(F.array(F.col("id") + 14, F.col("id") + 1)).alias("other"))
    return ours.join(rows.select(F.col("id").alias("other"), "b"), "other").select("id", "a", "b")


def each_pair(pairs, score):
    """pairs with score(a, b); names repeat, so each two of them are compared once."""
    once = pairs.select("a", "b").distinct().repartition(2 * max(pairs.sparkSession.sparkContext.defaultParallelism, 16))
    once = once.select(F.struct("a", "b").alias("both"), score(F.col("a"), F.col("b")).alias("score"))
    return pairs.withColumn("both", F.struct("a", "b")).join(once, "both").select("id", "a", "b", "score")


@query("si06_positional", f""", {_PAIRS}, s AS (SELECT id, a, b, greatest(length(a), length(b)) AS n, least(length(a), length(b)) AS m FROM pairs)
SELECT id, a, b, round(CASE WHEN m::DOUBLE / n < 0.9 THEN 0 ELSE len(list_filter(range(1, m + 1), lambda i: a[i] = b[i]))::DOUBLE / n END, 6) AS similarity FROM s""", "names")
def si06(spark, d):
    return name_pairs(spark, d).withColumn("similarity", F.round(N.positional_similarity(F.col("a"), F.col("b")), 6))


_REG = form_sql("{}", "registration")
_TIER = f"""t AS (SELECT id, a, b, {_REG.replace('({})', '(a)')} AS na, {_REG.replace('({})', '(b)')} AS nb FROM pairs),
u AS (SELECT *, list_filter(string_split(na, ' '), lambda w: length(w) > 1) AS wa, list_filter(string_split(nb, ' '), lambda w: length(w) > 1) AS wb FROM t),
v AS (SELECT *, list_filter(wa, lambda w: NOT list_contains({list(N.TIER_GENERIC)}, w)) AS ta, list_filter(wb, lambda w: NOT list_contains({list(N.TIER_GENERIC)}, w)) AS tb FROM u)"""


@query("si05_tiers", f""", {_PAIRS}, {_TIER}
SELECT id, a, b, round(CASE WHEN na = '' OR nb = '' THEN 0 WHEN na = nb THEN 1 WHEN contains(na, nb) OR contains(nb, na) THEN 0.9 WHEN len(wa) = 0 OR len(wb) = 0 THEN 0
  WHEN len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) IN (len(ta), len(tb)) THEN 0.95 WHEN len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) > 0 AND len(list_intersect(ta, tb))::DOUBLE / greatest(len(ta), len(tb)) >= 0.5 THEN 0.85
  WHEN len(wa) >= 2 AND len(wb) >= 2 AND wa[1:2] = wb[1:2] THEN 0.85 ELSE len(list_intersect(wa, wb))::DOUBLE / greatest(len(wa), len(wb)) END, 6) AS score FROM v""", "names")
def si05(spark, d):
    return each_pair(name_pairs(spark, d), lambda a, b: F.round(N.tiered_similarity(a, b), 6).cast("double"))


@query("si04_weighted")
def si04(spark, d):
    return each_pair(name_pairs(spark, d), lambda a, b: F.round(N.weighted_similarity(a, b), 6))


_HOST = r"coalesce(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', ''), '')"
_PATH = rf"CASE WHEN {_HOST} <> '' THEN coalesce(nullif(regexp_extract(lower(url), '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') END"


@query("fl28_kinds_of_addresses", f"""SELECT id, coalesce(regexp_matches(url, '{web.BAD}'), false) AS bad, coalesce(list_bool_or(list_transform({list(web.BLOCKED)}, lambda x: contains(lower(url), x))), true) AS blocked,
  coalesce(regexp_matches(lower(url), '{web.ARTICLE}'), false) AS article, coalesce(regexp_matches(lower(url), '{web.FILE}'), true) AS file, coalesce(length({_PATH}) < 20 OR regexp_matches({_PATH}, '{web.OWN_PATHS}') OR len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) = 1, false) AS home,
  coalesce(len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) > 3 OR len(list_filter(string_split({_PATH}, '/'), lambda s: length(s) > 50)) > 0, false) AS deep FROM sites""", "sites")
def fl28(spark, d):
    url = F.col("url")
    return table(spark, d, "sites").select("id", web.is_bad(url).alias("bad"), web.is_blocked(url).alias("blocked"), web.is_article(url).alias("article"), web.is_file(url).alias("file"), web.is_homepage(url).alias("home"), web.is_deep(url).alias("deep"))


@query("fl34_article_pages", """SELECT page_id, coalesce(regexp_matches(html[1:4096], '(?i)og:type["'']?\\s*content=["'']article["'']|content=["'']article["'']\\s+property=["'']og:type["'']'), false) AS article FROM pages""")
def fl34(spark, d):
    return table(spark, d, "pages").select("page_id", web.is_article_page(F.col("html")).alias("article"))


_BOX = " ".join(f"WHEN contains(string_split(e, '@')[1], '{m}') THEN {i}" for i, m in enumerate(web.MAILBOXES))


@query("ht02_page_addresses", f"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, 'example', 'firm'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')) AS e, generate_subscripts(regexp_extract_all(replace(text, 'example', 'firm'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), 1) AS i FROM documents),
b AS (SELECT doc_id, lower(e) AS e, min(i) AS i FROM a WHERE NOT regexp_matches(lower(e), '{web.NOISE}') GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE {_BOX} ELSE 6 END, i) AS n FROM b)
SELECT doc_id, string_agg(e, ' ' ORDER BY n) AS mails FROM c WHERE n <= 5 GROUP BY doc_id""")
def ht02(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(web.addresses(F.replace("text", F.lit("example"), F.lit("firm"))), " ").alias("mails")).filter("mails <> ''")


_SIGNALS = "list_concat(" + ", ".join(f"[CASE WHEN regexp_matches({c}, '(?i){p}') THEN '{n}' END]" for n, (e, r) in M.PLATFORMS.items() for c, ps in (("name", e), ("coalesce(related_names, '''')".replace("''''", "''"), r)) for p in ps) + ")"


@query("mx07_platforms", f""", s AS (SELECT id, list_filter({_SIGNALS}, lambda x: x IS NOT NULL) AS found FROM names),
k AS (SELECT id, unnest(found) AS p, generate_subscripts(found, 1) AS i FROM s), g AS (SELECT id, p, count(*) AS n, min(i) AS i FROM k GROUP BY ALL)
SELECT id, arg_min(p, -1000 * n + i) AS platform, sum(n)::BIGINT AS n_signals FROM g GROUP BY id""", "names")
def mx07(spark, d):
    found = M.signals(F.col("name"), F.coalesce("related_names", F.lit("")))
    return table(spark, d, "names").select("id", M.commonest(found).alias("platform"), F.size(found).cast("long").alias("n_signals")).filter("n_signals > 0")


@query("mx08_manager_candidates")
def mx08(spark, d):
    return M.manager_candidates(table(spark, d, "names").withColumnRenamed("name", "entityname"))


_LAST = rf"upper(string_split_regex(trim(regexp_replace(p, '(?i)[,.]?\s*({M.ENDINGS})\.?\s*$', '')), '[\s,]+')[-1])"


@query("mx09_exemption_tags", rf""", ps AS (SELECT id, trim(unnest(string_split(related_names, '|'))) AS p FROM names), l AS (SELECT id, {_LAST} AS s, count(*) OVER (PARTITION BY id) AS n FROM ps WHERE p <> ''),
fam AS (SELECT id FROM l WHERE n <= 4 AND length(s) >= 3 AND NOT regexp_matches(s, '^({M.ENDINGS}|CO)$') GROUP BY id HAVING count(*) > count(DISTINCT s))
SELECT id, concat_ws(',', CASE WHEN id IN (SELECT id FROM fam) THEN 'likely_family_office' END, CASE WHEN NOT list_contains({M.HOME}, upper(trim(place))) AND trim(place) <> '' THEN 'likely_foreign_private_adviser' END) AS tags FROM names""", "names")
def mx09(spark, d):
    return table(spark, d, "names").select("id", F.array_join(M.exemption_tags(F.col("place"), F.col("related_names")), ",").alias("tags"))


def managers(spark, d):
    return table(spark, d, "names").select("id", "name")


def advisers_by_name(spark, d):
    return table(spark, d, "advisers").select(F.col("crd").alias("key"), F.col("adviser_name").alias("name"))


_GATE_WORDS = f"list_distinct(list_transform(list_filter(string_split_regex(lower({{}}), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({list(T.STOPWORDS)}, w) AND NOT regexp_matches(w, '^[ivx]+$')), lambda w: CASE WHEN length(w) >= 6 THEN regexp_replace(w, 's$', '') ELSE w END))"
_TELL = f"list_filter({{}}, lambda w: NOT list_contains({_STOP}, w))"


@query("mx05_adviser_matches", f""", {_LADDER}, tries AS (SELECT id, v, min(k) AS k FROM (SELECT id, lower(v) AS v, k FROM ladder UNION ALL SELECT id, lower(name), 0 FROM names) GROUP BY ALL),
m AS (SELECT id, v, k, list_distinct({_words_sql('v')}) AS a, {_GATE_WORDS.format('v')} AS ga FROM tries), y AS (SELECT crd AS key, adviser_name AS found, list_distinct({_words_sql('adviser_name')}) AS b, {_GATE_WORDS.format('adviser_name')} AS gb FROM advisers),
md AS (SELECT *, {_TELL.format('a')} AS ta FROM m), yd AS (SELECT *, {_TELL.format('b')} AS tb FROM y),
hit AS (SELECT id, v, k, key, ga, gb, CASE WHEN lower(found) = v THEN 0 ELSE 1 END AS how FROM md JOIN yd ON lower(found) = v OR (list_has_any(ga, gb) AND len(b) >= 2 AND list_has_any(ta, tb) AND ((list_has_all(a, b) AND list_has_all(tb, ta)) OR (list_has_all(b, a) AND list_has_all(ta, tb))))),
best AS (SELECT *, row_number() OVER (PARTITION BY id, v ORDER BY how, key) AS n FROM hit),
ok AS (SELECT *, list_intersect(ga, gb) AS s FROM best WHERE n = 1)
SELECT id, arg_min(key, k) AS key, arg_min(v, k) AS variant FROM ok WHERE len(s) >= 2 OR len(list_filter(s, lambda w: length(w) >= 5)) > 0 GROUP BY id""", "names", "advisers")
def mx05(spark, d):
    return M.adviser_matches(managers(spark, d), advisers_by_name(spark, d)).select("id", "key", "variant")


@query("mx03_gate")
def mx03(spark, d):
    rows = name_pairs(spark, d).join(table(spark, d, "names").select("id", "related_names"), "id")
    return rows.select("id", "b", N.gate_result(F.col("a"), F.col("b"), F.col("related_names")).alias("g")).select("id", "b", "g.*")


_BASE = with_views("", *_ALL).rstrip() + "," + _XREF


@query("de05_named_in_filings")
def de05_names(spark, d):
    return detectors.named_in_filings(table(spark, d, "advisers"), table(spark, d, "filings"), matches(spark, d), DUE)


SQL["de05_named_in_filings"] = f"""{_BASE}, kw AS (SELECT crd, list_filter(string_split_regex(upper(adviser_name), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('LLC', 'LP', 'INC', 'CAPITAL', 'PARTNERS', 'MANAGEMENT', 'FUND', 'ADVISORS', 'ADVISERS', 'INVESTMENTS', 'GROUP', 'HOLDINGS', 'THE', 'AND', 'OF'))[1:3] AS w FROM advisers),
kinds AS (SELECT w, min(crd) AS crd FROM kw GROUP BY w), texts AS (SELECT DISTINCT upper(entityname) AS e FROM filings), hit AS (SELECT e, min(crd) AS crd FROM texts JOIN kinds ON len(list_filter(w, lambda x: contains(e, x))) >= 2 GROUP BY e)
SELECT accessionnumber, crd, 'medium' AS severity FROM filings JOIN hit ON upper(entityname) = e WHERE year({_DAY}) < {DUE} AND accessionnumber NOT IN (SELECT accessionnumber FROM matches)"""


@query("de09_graded_registration")
def de09(spark, d):
    return detectors.graded_registration(table(spark, d, "filings"), matches(spark, d), BLOCKED, "1998-06-30")


_MASTER = r"regexp_extract(entityname, '(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$', 1)"
SQL["de09_graded_registration"] = f"""{_BASE}, r AS (SELECT {_MASTER} AS series_master, count(*) AS n_filings, sum(amount::DECIMAL(18,2))::DOUBLE AS total_amount, min({_DAY}) AS first_filing FROM filings
  WHERE isamendment <> 'true' AND {_MASTER} <> '' AND NOT regexp_matches(lower({_MASTER}), '{BLOCKED}') AND accessionnumber NOT IN (SELECT accessionnumber FROM matches) GROUP BY 1)
SELECT *, date_diff('day', first_filing, DATE '1998-06-30') AS days, CASE WHEN date_diff('day', first_filing, DATE '1998-06-30') > 180 THEN 'critical' WHEN date_diff('day', first_filing, DATE '1998-06-30') > 120 THEN 'high' ELSE 'medium' END AS severity FROM r"""


@query("jn24_outer_merge", """SELECT coalesce(a.crd, f.crd) AS crd, adviser_name, n, a.crd IS NOT NULL AS listed FROM (SELECT crd, adviser_name FROM advisers) a FULL JOIN (SELECT adviser_entity_crd AS crd, count(*) AS n FROM funds GROUP BY 1) f ON a.crd = f.crd""", "advisers", "funds")
def jn24(spark, d):
    left = table(spark, d, "advisers").select("crd", "adviser_name", F.lit(True).alias("listed"))
    counts = table(spark, d, "funds").groupBy(F.col("adviser_entity_crd").alias("crd")).agg(F.count("*").alias("n"))
    return left.join(counts, "crd", "full_outer").select("crd", "adviser_name", "n", F.coalesce("listed", F.lit(False)).alias("listed"))


def found(spark, d):
    """Decisions of sites, pages, mails and team over the evidence."""
    e, f = table(spark, d, "evidence"), table(spark, d, "firms")
    sites = decisions.websites(e, f)
    pages = decisions.company_pages(e, f, sites)
    return f, sites, pages, decisions.emails(e), decisions.team(e, f, sites, pages)


_SITE_WORDS = f"list_filter(string_split_regex(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 4 AND NOT list_contains({list(N.SITE_GENERIC)}, w))"
_SITES = f"""e1 AS (SELECT e.*, f.crd, coalesce(regexp_replace(lower(regexp_extract(value, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', ''), '') AS host, coalesce(regexp_replace(lower(regexp_extract(website, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', ''), '') AS own, {_SITE_WORDS} AS words,
  CASE strength WHEN 'strong' THEN 0 WHEN 'medium' THEN 1 WHEN 'weak' THEN 2 ELSE 3 END AS r FROM evidence e LEFT JOIN firms f ON e.id = f.id WHERE type = 'website_url'),
e2 AS (SELECT *, CASE WHEN host <> '' AND starts_with(anchor, 'sec_adv_crd:') THEN 'anchored_by:' || anchor WHEN host <> '' AND host = own THEN 'anchored_by:sec_adv_crd:' || coalesce(crd::VARCHAR, 'unknown') END AS sure, host <> '' AND len(list_filter(words, lambda w: contains(host, w))) > 0 AS maybe FROM e1),
e3 AS (SELECT id, arg_min(CASE WHEN sure IS NULL THEN 'candidate' ELSE 'verified' END, r * 100000000 + place) AS status, arg_min(value, r * 100000000 + place) AS value, arg_min(coalesce(sure, 'distinctive_token_in_domain_no_anchor'), r * 100000000 + place) AS reason FROM e2 WHERE sure IS NOT NULL OR maybe GROUP BY id),
sited AS (SELECT DISTINCT e1.id, coalesce(status, 'rejected') AS status, e3.value AS value, coalesce(reason, 'no_distinctive_token_match') AS reason FROM e1 LEFT JOIN e3 ON e1.id = e3.id)"""


@query("ru01_websites", f", {_SITES} SELECT * FROM sited", "evidence", "firms")
def ru01(spark, d):
    return found(spark, d)[1]


@query("ru02_company_pages")
def ru02(spark, d):
    return found(spark, d)[2]


@query("ru03_team")
def ru03(spark, d):
    return found(spark, d)[4]


_MAILS = """m1 AS (SELECT id, arg_min(struct_pack(v := value, a := anchor), (CASE WHEN anchor <> '' THEN 0 ELSE 100000000 END) + place) AS x FROM evidence WHERE type = 'primary_contact_email' GROUP BY id),
mailed AS (SELECT id, CASE WHEN x.a <> '' THEN 'verified' ELSE 'candidate' END AS status, x.v AS value, CASE WHEN x.a <> '' THEN 'anchored_by:' || x.a ELSE 'unanchored_email_candidate' END AS reason FROM m1)"""


@query("ru04_emails", f", {_MAILS} SELECT * FROM mailed", "evidence")
def ru04(spark, d):
    return found(spark, d)[3]


@query("ru05_statuses", f""", {_SITES}, {_MAILS}, al AS (SELECT id, status, 1 AS f FROM sited UNION ALL SELECT id, status, 2 FROM mailed), g AS (SELECT id, count_if(status = 'verified') AS s, count_if(status = 'candidate') AS c, count(DISTINCT CASE WHEN status = 'verified' THEN f END) AS n FROM al GROUP BY id)
SELECT firms.id, CASE WHEN s > 0 AND c = 0 THEN 'verified' WHEN s > 0 THEN 'partial' WHEN c > 0 THEN 'candidates_only' ELSE 'no_data' END AS status, coalesce(n, 0) / 2 AS confidence FROM firms LEFT JOIN g ON firms.id = g.id""", "evidence", "firms")
def ru05(spark, d):
    f, sites, _, mails, _ = found(spark, d)
    return decisions.statuses(f, website_url=sites, primary_contact_email=mails)


@query("ru07_site_conflicts", """, h AS (SELECT id, regexp_replace(lower(regexp_extract(value, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n FROM evidence WHERE type = 'website_url' GROUP BY ALL)
SELECT id, count(*) AS n_hosts, count(*) > 1 AS conflict, max(n) > 1 AS agreed FROM h WHERE host <> '' GROUP BY id""", "evidence")
def ru07(spark, d):
    return decisions.site_conflicts(table(spark, d, "evidence"))


@query("pj13_public_view")
def pj13(spark, d):
    return decisions.public_view(*found(spark, d)[:4])
