"""Elements, attributes and text of raw pages, in their order, as column functions.

An element goes from its tag to the next closing tag of its name; other elements may stand inside it.  What comments,
scripts and styles hold is no element and no text.  Broken markup gives what can be read of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named characters; the one that marks them comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
RAW = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles; an empty text for a null."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), RAW, " ")


def decoded(text: Column) -> Column:
    """Text with named characters and numbered ones (&#39; and &#x27;) as themselves; numbers of no character stay."""
    parts = F.split(text, "&#")

    def one(part: Column, place: Column) -> Column:
        number = F.regexp_extract(part, r"^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));", 0)
        code = F.when(F.lower(number).startswith("x"), F.conv(F.regexp_extract(number, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(number, r"(\d+)", 1)).try_cast("int")
        good = (number != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(place == 0, part).when(good, F.concat(char, F.substring(part, F.length(number) + 1, F.length(part)))).otherwise(F.concat(F.lit("&#"), part))

    out = F.array_join(F.transform(parts, one), "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def text_of(markup: Column) -> Column:
    """What a reader sees of a piece of a page, white space folded."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(markup, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def element_pattern(tag: str) -> str:
    """Attributes and inner markup of an element."""
    return rf"(?is)<{tag}((?:[\s/][^>]*)?)>(.*?)</{tag}\s*>"


def elements(page: Column, tag: str) -> Column:
    """Elements of a visible page: attributes (as they stand in the tag) and inner markup."""
    pattern = element_pattern(tag)
    return F.transform(F.regexp_extract_all(page, F.lit(pattern), 0), lambda e: F.struct(F.regexp_extract(e, pattern, 1).alias("attributes"), F.regexp_extract(e, pattern, 2).alias("inner")))


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute, quoted or not; null if it isn't there."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = F.nullif(F.regexp_extract(attributes, pattern, 1), F.lit(""))
    return decoded(F.trim(F.when(raw.rlike(r"""^["']"""), F.substring(raw, 2, F.length(raw) - 2)).otherwise(raw)))


def first_text(page: Column, tag: str) -> Column:
    """The text of the first element; null if there is none."""
    return F.nullif(text_of(F.regexp_extract(page, element_pattern(tag), 2)), F.lit(""))


def absolute(base: Column, href: Column) -> Column:
    """An address relative to a page's as a whole one."""
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    plain = F.regexp_replace(base, "[?#].*$", "")
    out = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
    return out.when(F.startswith(href, F.lit("/")), F.concat(site, href)).when(F.startswith(href, F.lit("#")) | F.startswith(href, F.lit("?")), F.concat(plain, href)).otherwise(F.concat(folder, href))


#: A person's name between two tags, or in a picture's description; how far from a link it may stand.
PERSON = r"[A-Z][a-z]+ [A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
AROUND = 300
PROFILE = r"""(?i)href=["']?(https?://(?:www\.)?linkedin\.com/(?:in|company)/[a-zA-Z0-9_-]+/?)[^"'\s>]*"""


def profiles(html: Column) -> Column:
    """company: the first company profile that a raw page links to; persons: profiles of persons (url, name) in order, each user once, with the name that stands near the link."""
    page = F.coalesce(html, F.lit(""))
    found, parts = F.regexp_extract_all(page, F.lit(PROFILE), 0), F.split(page, PROFILE)
    before = lambda list_, i: F.aggregate(F.slice(list_, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))

    def link(whole: Column, i: Column) -> Column:
        at = before(parts, i + 1) + before(found, i)
        near = F.substring(page, F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND)) + AROUND)
        url = F.regexp_replace(F.regexp_extract(whole, PROFILE, 1), "/$", "")
        named, described = F.regexp_extract(near, rf"<[^>]*>({PERSON})</[^>]*>", 1), F.regexp_extract(near, rf"""alt=["']({PERSON})["']""", 1)
        return F.struct(url.alias("url"), F.coalesce(F.nullif(named, F.lit("")), F.nullif(described, F.lit(""))).alias("name"))

    links = F.transform(found, link)
    is_firm = lambda x: F.contains(x["url"], F.lit("/company/"))
    firms, people = F.filter(links, is_firm), F.filter(links, lambda x: ~is_firm(x))
    user = lambda x: F.lower(F.get(F.split(x["url"], "/in/"), F.lit(1)))
    none = F.array().cast("array<struct<url: string, name: string>>")
    once = F.aggregate(people, none, lambda kept, x: F.when(F.exists(kept, lambda k: F.contains(F.lower(k["url"]), user(x))), kept).otherwise(F.concat(kept, F.array(x))))
    return F.struct(F.get(firms, F.lit(0))["url"].alias("company"), once.alias("persons"))
