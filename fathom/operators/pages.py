"""What raw pages say: titles, links, companies and profiles, in the order of the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import html as H
from fathom.functions import scalars, web
from fathom.functions import text as T


def titles(pages: DataFrame) -> DataFrame:
    """page_id, title, heading and lang of each page; nulls for what it lacks."""
    rows = pages.select("page_id", H.visible(F.col("html")).alias("page"))
    lang = H.attribute(F.regexp_extract("page", r"(?is)<html((?:[\s/][^>]*)?)>", 1), "lang")
    return rows.select("page_id", H.first_text(F.col("page"), "title").alias("title"), H.first_text(F.col("page"), "h1").alias("heading"), lang.alias("lang"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, place (from 0), href, url (whole), text, host and kind (file, article, blocked, homepage, other) of each link of pages (page_id, url, html)."""
    rows = pages.select("page_id", F.col("url").alias("base"), H.elements(H.visible(F.col("html")), "a").alias("found"))
    each = rows.select("page_id", "base", F.posexplode("found").alias("place", "e"))
    each = each.select("page_id", "base", "place", H.attribute(F.col("e.attributes"), "href").alias("href"), H.text_of(F.col("e.inner")).alias("text")).filter("href IS NOT NULL")
    whole = each.withColumn("url", H.absolute(F.col("base"), F.col("href")))
    url = F.col("url")
    kind = F.when(web.is_file(url), "file").when(web.is_blocked(url), "blocked").when(web.is_article(url), "article").when(web.is_homepage(url), "homepage").otherwise("other")
    return whole.select("page_id", "place", "href", "url", "text", T.hostname(url).alias("host"), kind.alias("kind"))


def company_names(pages: DataFrame) -> DataFrame:
    """page_id, place and name of each company that a page of a portfolio names, fifty at most."""
    return pages.select("page_id", F.posexplode(scalars.portfolio_names(F.coalesce("html", F.lit("")))).alias("place", "name"))


def profile_links(pages: DataFrame) -> DataFrame:
    """page_id, kind (company, person), place, url and name of each profile that a page links to: its first company, and its persons."""
    found = pages.select("page_id", H.profiles(F.col("html")).alias("p"))
    firm = found.filter("p.company IS NOT NULL").select("page_id", F.lit("company").alias("kind"), F.lit(0).alias("place"), F.col("p.company").alias("url"), F.lit(None).cast("string").alias("name"))
    people = found.select("page_id", F.posexplode("p.persons").alias("place", "x")).select("page_id", F.lit("person").alias("kind"), "place", "x.url", "x.name")
    return firm.unionByName(people)
