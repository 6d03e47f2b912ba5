"""Column functions that read and write single values of records: types, stages, scores, sites, lists of search results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import formats
from fathom.functions import text as T
from fathom.functions import web

#: Rule -> kind, the first that holds wins; by source of the words.
FILED = (("venture capital", "Venture Capital"), ("private equity", "Private Equity"), ("hedge", "Hedge Fund"), ("real estate", "Real Estate"), ("liquidity|credit", "Credit"), ("securitized|other private fund", "Other Private Fund"))
LISTED = (("vc|venture", "VC"), ("pe|private equity", "PE"), ("real estate|property", "Real Estate"), ("hedge", "Hedge Fund"), ("credit|debt", "Credit"))
BASIC = (("venture|vc|seed|startup|early.stage", "Venture Capital"), ("private equity|buyout|lbo|leveraged", "Private Equity"), ("hedge fund|long.short|trading|market neutral", "Hedge Fund"), ("real estate|property|reit|multifamily", "Real Estate"))
FIRST = (("venture capital|vc fund|seed|series a|pre-seed|early[- ]stage startup", "VC"), ("private equity|buyout|acquisition|growth equity", "PE"), ("real estate|property|reit|multifamily|commercial real estate", "Real Estate"), ("hedge fund|long.short|trading|market neutral", "Hedge Fund"), ("credit fund|lending|debt fund|mezzanine", "Credit"), ("charitable trust|steward ownership|non[- ]?profit", "Charitable Trust"))
OPERATING, INVESTING = "we build|our product|our customers|our platform|we develop", "portfolio|investments|we invest|capital"
#: Words of stages of investment, from the earliest.
STAGES = (("pre[- ]?seed", "Pre-seed"), (r"\bseed\b", "Seed"), ("series a", "Series A"), ("series b", "Series B"), ("growth", "Growth"), ("late[- ]?stage", "Late-stage"))
#: Pages of a network that are nobody's.
NO_HANDLE = ("search", "hashtag", "i", "intent", "share", "home")
#: Words that don't tell sites apart.
SITE_COMMON = ("capital", "ventures", "venture", "partners", "partner", "fund", "funds", "management", "mgmt", "advisors", "advisers", "group", "holdings", "invest", "investment", "investments", "private", "equity", "asset", "global")


def by_rules(text: Column, rules: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    low, out = F.lower(text), F.when(F.lit(False), F.lit(""))
    for pattern, kind in rules:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise(otherwise)


def filed_type(text: Column) -> Column:
    return by_rules(text, FILED, F.lit("Unknown"))


def listed_type(text: Column) -> Column:
    """Others stay as written; Unknown for none."""
    return F.when(F.coalesce(text, F.lit("")) == "", "Unknown").otherwise(by_rules(text, LISTED, text))


def basic_type(text: Column) -> Column:
    return by_rules(text, BASIC, F.lit("Unknown"))


def first_type(text: Column) -> Column:
    """What operates and doesn't invest is no fund."""
    low = F.lower(text)
    return F.when(low.rlike(OPERATING) & ~low.rlike(INVESTING), "Operating Company").otherwise(by_rules(text, FIRST, F.lit("Unknown")))


def stage(text: Column) -> Column:
    """The earliest stage that a text names, to the latest; null for none."""
    found = F.array_compact(F.array(*(F.when(F.lower(text).rlike(p), s) for p, s in STAGES)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, F.concat_ws(" to ", F.get(found, F.lit(0)), F.element_at(found, -1)))


def first_confidence(site: Column, page: Column, kind: Column, stage_: Column, n_sources: Column) -> Column:
    """Four tenths for an own site, two for a page and for a type, one for a stage and for two sources; in tenths exactly."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    own = there(site) & ~F.coalesce(site.rlike("crunchbase|linkedin"), F.lit(False))
    parts = ((own, 4), (there(page), 2), (there(kind) & (kind != "Unknown"), 2), (there(stage_), 1), (F.coalesce(n_sources >= 2, F.lit(False)), 1))
    total = F.lit(0)
    for test, n in parts:
        total = total + F.when(test, n).otherwise(0)
    return total / 10


def first_status(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "auto_enriched").when(confidence >= 0.5, "needs_manual_review").otherwise("no_data_found")


def publishable(confidence: Column, kind: Column, site: Column, least: float = 0.7) -> Column:
    """Sure enough, of a known type that invests, with a site that is no directory's."""
    return F.coalesce((confidence >= least) & (kind != "") & ~kind.isin("Unknown", "Operating Company") & (site != "") & ~site.contains("crunchbase"), F.lit(False))


def effective(total: Column, *years: Column) -> Column:
    """The total, or the first of the years that isn't zero; null for none."""
    return F.coalesce(*(F.nullif(c, F.lit(0.0)) for c in (total, *years)))


def compact(value: Column) -> Column:
    """A number with B, M or K and one decimal."""
    out = F.when(value.isNull(), "N/A")
    for unit, form in ((1e9, "%.1fB"), (1e6, "%.1fM"), (1e3, "%.1fK")):
        out = out.when(value >= unit, F.format_string(form, formats.tenths(value / unit)))
    return out.otherwise(F.format_string("%.0f", F.rint(value)))


def slug_sites(page: Column) -> Column:
    """Sites that a company's page may belong to, by its name there; an empty list for short names and numbers."""
    slug = F.regexp_replace(formats.company_slug(page), "[^a-z0-9-]", "")
    return F.when((F.length(slug) >= 4) & ~slug.rlike("^[0-9-]+$"), F.array(F.concat(F.lit("https://www."), slug, F.lit(".com")), F.concat(F.lit("https://"), slug, F.lit(".com")))).otherwise(F.array().cast("array<string>"))


def handle(url: Column) -> Column:
    """@name in the address of a person's or firm's page; null for pages that are nobody's."""
    name = F.regexp_extract(url, r"(?:twitter\.com|x\.com)/([a-zA-Z0-9_]+)(?:/|$|\?)", 1)
    return F.when((name != "") & ~F.lower(name).isin(*NO_HANDLE), F.concat(F.lit("@"), name))


def first_object(text: Column) -> Column:
    """The first brace to the last, if that is JSON."""
    raw = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(raw).isNotNull(), raw)


def plain(html: Column) -> Column:
    """Text of a piece of a page."""
    out = F.regexp_replace(html, "<[^>]+>", "")
    for mark, char in (("&amp;", "&"), ("&#x27;", "'"), ("&quot;", '"')):
        out = F.replace(out, F.lit(mark), F.lit(char))
    return F.trim(out)


def result_links(html: Column) -> Column:
    """Results of a page of results: url, title, description, each with the first snippet before the next result."""
    parts = F.split(html, r'<a(?=[^>]+class="result__a")')
    blocks = F.slice(parts, F.lit(2), F.size(parts) - 1)
    link = r'(?s)^[^>]+class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>'

    def one(block: Column) -> Column:
        url = F.regexp_extract(block, link, 1)
        target = F.regexp_extract(url, r'uddg=([^&"]+)', 1)
        said = F.regexp_extract(block, r'(?s)class="result__snippet"[^>]*>(.*?)</a>', 1)
        return F.struct(F.when(target != "", F.coalesce(F.try_url_decode(target), target)).otherwise(url).alias("url"), plain(F.regexp_extract(block, link, 2)).alias("title"), plain(said).alias("description"))

    return F.filter(F.transform(blocks, one), lambda r: r["url"] != "")


#: Where names of companies stand in a page.
COMPANY_PLACES = ((r"""(?i)<a[^>]*href=["'][^"']*?(?:\.com|\.io|\.ai|\.co)[^"']*?["'][^>]*>([^<]+)</a>"""), r'(?i)"name"\s*:\s*"([^"]+)"', r"""(?is)<div[^>]*class=["'][^"']*(?:company|portfolio|investment)[^"']*["'][^>]*>.*?<h[0-9][^>]*>([^<]+)</h[0-9]>""")


def portfolio_names(html: Column, most: int = 50) -> Column:
    """Distinct names of companies in a page of a portfolio, in order; numbers, and names of parts of a site, go."""
    found = F.flatten(F.array(*(F.regexp_extract_all(html, F.lit(p), 1) for p in COMPANY_PLACES)))
    named = F.filter(F.transform(found, lambda n: F.trim(n)), lambda n: (F.length(n) > 2) & (F.length(n) < 100) & ~F.lower(n).rlike("portfolio|login|contact") & ~n.rlike(r"^\d+$"))
    return F.slice(F.array_distinct(named), 1, most)


def site_choice(results: Column, name: Column) -> Column:
    """Which of a list of results (url, title) are a firm's own site: domains with a word of its name among the first five; else titles with its first word among the first eight.

    A third look, for domains with a telling word among the first three, can't find what the first didn't: those are
    words of the name as well.
    """
    short = F.trim(F.regexp_replace(F.lower(name), r",?\s*(lp|llc|l\.p\.|l\.l\.c\.|ltd|limited|inc)\s*$", ""))
    words = F.filter(F.split(short, " "), lambda w: F.length(w) > 3)
    good = lambda r: ~web.is_blocked(r["url"]) & ~web.is_file(r["url"]) & ~web.is_article(r["url"]) & web.is_homepage(r["url"])
    tell = lambda rows, source, strength: F.transform(rows, lambda r: F.struct(r["url"].alias("value"), F.lit(source).alias("source"), F.lit(strength).alias("strength")))
    one = F.filter(F.slice(results, 1, 5), lambda r: F.coalesce(good(r) & F.exists(words, lambda w: T.hostname(r["url"]).contains(w)), F.lit(False)))
    two = F.filter(F.slice(results, 1, 8), lambda r: F.coalesce(good(r) & F.lower(r["title"]).contains(F.get(F.split(short, " "), F.lit(0))), F.lit(False)))
    return F.when(F.size(one) > 0, tell(one, "web_search:domain_match", "medium")).otherwise(tell(two, "web_search:title_match", "weak"))
