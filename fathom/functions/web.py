"""Tests on addresses of pages, and what pages link to.  A null address is no match, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import text as T

#: Addresses that aren't a firm's site.
BAD = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|csv)$|/files/|/documents/|/uploads/|/download/|/attachments/|/news/\d{4}/|/article/\d+|^https?://(www\.)?(linkedin|twitter|x|facebook)\.com"
#: Hosts of data sellers, networks and press.
BLOCKED = ("crunchbase.com", "pitchbook.com", "bloomberg.com", "tracxn.com", "cbinsights.com", "signal.nfx.com", "dealroom.co", "harmonic.ai", "inc42.com", "f6s.com", "fundz.net", "venture-radar.com", "contactout.com", "rocketreach.co", "zoominfo.com", "apollo.io", "lusha.com", "signalhire.com", "hunter.io", "linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "tiktok.com", "reddit.com", "medium.com", "substack.com", "wordpress.com", "blogger.com", "formds.com", "sec.gov", "aum13f.com", "whalewisdom.com", "venture.angellist.com", "republic.com", "wefunder.com", "seedinvest.com", "techcrunch.com", "forbes.com", "wsj.com", "businessinsider.com", "prnewswire.com", "businesswire.com", "venturebeat.com", "bestpitchdeck.com", "alts.co", "wikipedia.org")
#: Paths and hosts of articles.
ARTICLE = r"/news/|/articles?/|/blog/|/posts?/|/press/|/press-release|/insights/|/stories/|/202[0-6]/|/pulse/|^[a-z]+://(news|blog|press|insights)\."
#: Endings of files.
FILE = r"\.(pdf|docx?|xlsx?|pptx?|txt|csv|zip|png|jpe?g|gif)$"
#: Beginnings of paths that firms use.
OWN_PATHS = r"^/(about|team|contact|portfolio|investments|home|our-firm|our-team|people|leadership|partners|ventures)"
#: Parts of mail addresses that page builders leave behind.
NOISE = r"example\.com|domain\.com|sentry\.io|cloudflare|wixpress|squarespace|\.js$|\.css$|\.png|\.jpg"
#: Names of shared mailboxes, the best first.
MAILBOXES = ("info", "contact", "hello", "invest", "ir", "team")


def _said(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def is_bad(url: Column) -> Column:
    return _said(url.rlike(BAD))


def is_blocked(url: Column) -> Column:
    """A null is blocked."""
    return F.coalesce(F.lower(url).rlike("|".join(d.replace(".", r"\.") for d in BLOCKED)), F.lit(True))


def is_article(url: Column) -> Column:
    return _said(F.lower(url).rlike(ARTICLE))


def is_file(url: Column) -> Column:
    """A null is a file."""
    return F.coalesce(F.lower(url).rlike(FILE), F.lit(True))


def path(url: Column) -> Column:
    """Lower-case path without query and fragment; / if there is none; null for what isn't an address."""
    return F.when(T.hostname(url) != "", F.coalesce(F.nullif(F.regexp_extract(F.lower(url), r"^[a-z]+://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/")))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def is_homepage(url: Column) -> Column:
    """A path under 20 characters, of one part, or one that firms use."""
    return _said((F.length(path(url)) < 20) | path(url).rlike(OWN_PATHS) | (F.size(segments(url)) == 1))


def is_deep(url: Column) -> Column:
    """Over three parts, or one of over 50 characters."""
    return _said((F.size(segments(url)) > 3) | F.exists(segments(url), lambda s: F.length(s) > 50))


def is_article_page(html: Column) -> Column:
    """og:type says article within the first 4096 characters."""
    return _said(F.substring(html, 1, 4096).rlike(r"""(?i)og:type["']?\s*content=["']article["']|content=["']article["']\s+property=["']og:type["']"""))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts; two addresses without a host aren't one site."""
    return _said((T.hostname(a) == T.hostname(b)) & (T.hostname(a) != ""))


def addresses(html: Column) -> Column:
    """Up to five mail addresses, each once, shared mailboxes first and in the page's order; an empty list for a null."""
    found = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), 0), F.lower)
    kept = F.array_distinct(F.filter(found, lambda e: ~e.rlike(NOISE)))

    def rank(e: Column) -> Column:
        box = F.substring_index(e, "@", 1)
        out = F.lit(len(MAILBOXES))
        for i, name in reversed(list(enumerate(MAILBOXES))):
            out = F.when(box.contains(name), i).otherwise(out)
        return out

    ranked = F.array_sort(F.transform(kept, lambda e, i: F.struct(rank(e).alias("rank"), i.alias("i"), e.alias("e"))))
    return F.slice(F.transform(ranked, lambda x: x["e"]), 1, 5)


def profiles(html: Column, kind: str = "company") -> Column:
    """Distinct addresses of company (or in) profiles that the page links to, without a last slash."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"""(?i)href=["']?(https?://(?:www\.)?linkedin\.com/{kind}/[a-zA-Z0-9_-]+)"""), 1)
    return F.array_distinct(found)


def titled_person(title: Column) -> Column:
    """name, title and company of 'Name - Title - Company'; nulls for missing parts."""
    parts = F.split(title, " - ")
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    return F.struct(at(0).alias("name"), at(1).alias("title"), at(2).alias("company"))


def is_current_profile(firm: Column, title: Column) -> Column:
    """The title of a profile says that its person works at the firm now."""
    firm, title = F.lower(firm), F.lower(title)
    generic = ("ventures", "capital", "partners", "fund", "investment", "management", "holdings", "group", "equity", "global", "advisors")
    former = title.rlike(r"\b(ex|former|past|formerly|previously|prior|retired|alumni|alumnus|alumna)\b")
    outside = title.rlike(r"\b(advisor|advisory|board member|board observer)\b") & ~title.rlike(r"\b(managing|founder|principal|partner|director|officer)\b")
    words = F.filter(F.split(firm, " "), lambda w: F.length(w) > 2)
    pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    own = F.filter(words, lambda w: ~w.isin(*generic))
    one = (F.size(own) == 1) & F.array_contains(F.split(title, r"[^a-z0-9_]+"), F.try_element_at(own, F.lit(1)))
    every = (F.size(own) == 0) & (F.size(words) >= 2) & F.forall(words, lambda w: title.contains(w))
    return _said(~former & ~outside & (title.contains(firm) | F.exists(pairs, lambda p: title.contains(p)) | one | every))
