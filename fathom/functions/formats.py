"""Column functions that write values for people, and that sort fund types, sites and persons.  Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import text as T

#: Kinds of funds by what their names contain.
FAMILIES = {"pe": ("private equity", "privateequity", "pe fund"), "vc": ("venture capital", "venturecapital", "venture", "vc fund"), "hedge": ("hedge fund", "hedgefund"), "re": ("real estate", "realestate", "re fund")}
#: Sites that are nobody's own.
SOCIAL = ("linkedin.com", "twitter.com", "facebook.com", "instagram.com", "reddit.com", "youtube.com", "tiktok.com", "medium.com", "substack.com", "x.com")
#: What a found field adds to the confidence in a record.
WEIGHTS = {"website_url": 0.35, "linkedin_company_url": 0.20, "primary_contact_email": 0.15, "twitter_handle": 0.10, "team": 0.10, "fund_type": 0.10}


def tenths(x: Column) -> Column:
    """x, but where it reads as halfway between two tenths the one that its exact binary value is nearer to, the even one if it is halfway: what C's %.1f prints, and not Java's.

    20 x is summed as 16 x + 4 x with what the sum leaves over, so the comparison is exact.
    """
    twice = F.round(x * 20)
    reads = (twice / 20 == x) & (F.abs(F.pmod(twice, F.lit(2.0))) == 1)
    total = x * 16 + x * 4
    over = (total - twice) + (x * 4 - (total - x * 16))
    low = (twice - 1) / 2
    nearest = F.when(over > 0, low + 1).when(over < 0, low).otherwise(F.rint(twice / 2))
    return F.when((F.abs(x) < 1e12) & reads, nearest / 10).otherwise(x)


def currency(value: Column) -> Column:
    """$ with T, B, M or K; N/A for none and zero; Indefinite stays."""
    text = value.cast("string")
    n = T.amount(text)
    out = F.when(F.lower(text) == "indefinite", "Indefinite").when(n.isNull() | (n == 0), "N/A")
    for unit, form in [(1e12, "$%.1fT"), (1e9, "$%.1fB"), (1e6, "$%.1fM")]:
        out = out.when(n >= unit, F.format_string(form, tenths(n / unit)))
    return out.when(n >= 1e3, F.format_string("$%.0fK", F.rint(n / 1e3))).otherwise(F.format_string("$%.0f", F.rint(n)))


def full_currency(value: Column) -> Column:
    """$ and whole dollars with commas; N/A for none; Indefinite stays."""
    text = value.cast("string")
    n = F.round(T.amount(text))
    dollars = F.concat(F.when(n < 0, "-$").otherwise("$"), F.format_number(F.abs(n), 0))
    return F.when(F.lower(text) == "indefinite", "Indefinite").when(n.isNull(), "N/A").otherwise(dollars)


def signed_percent(value: Column) -> Column:
    """One decimal and a sign; null for null and NaN."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.format_string("%+.1f%%", tenths(value)))


def phone(text: Column) -> Column:
    """Digits in groups, by how many there are; too few stay as written."""
    digits = F.regexp_replace(text, "[^0-9+]", "")
    n = F.length(digits)
    part = lambda pattern, form: F.regexp_replace(digits, pattern, form)
    out = F.when(n < 7, text).when(n == 10, part(r"^(.{3})(.{3})(.{4})$", "($1) $2-$3"))
    out = out.when((n == 11) & digits.startswith("1"), part(r"^1(.{3})(.{3})(.{4})$", "+1 ($1) $2-$3"))
    return out.when(n > 10, part(r"^(.+)(.{3})(.{3})(.{4})$", "+$1 $2 $3 $4")).otherwise(text)


def families(kind: Column) -> Column:
    """The families that a fund type names; an empty list if none."""
    low = F.lower(kind)
    named = [F.when((low == code) | F.coalesce(low.rlike("|".join(words)), F.lit(False)), code) for code, words in FAMILIES.items()]
    return F.array_compact(F.array(*named))


def same_kind(a: Column, b: Column, equal_is_same: bool = True) -> Column:
    """Both name a family in common, or (with equal_is_same) are the same text."""
    shared = F.arrays_overlap(families(a), families(b))
    return shared | (F.lower(F.trim(a)) == F.lower(F.trim(b))) if equal_is_same else shared


def standard_type(kind: Column) -> Column:
    """One name for each kind of fund; the first rule that holds wins, others stay as written."""
    low = F.lower(kind)
    rules = (("venture", "Venture Capital"), ("private equity|buyout", "Private Equity"), ("hedge", "Hedge Fund"), ("real estate", "Real Estate"), ("securitized", "Securitized Asset"), ("other", "Other"))
    out = F.when(F.lit(False), kind)
    for pattern, name in rules:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise(F.nullif(kind, F.lit("")))


def best_site(primary: Column, others: Column) -> Column:
    """The primary site unless it is a social one; then the first other that isn't, else the primary."""
    social = lambda url: F.lower(url).rlike("|".join(s.replace(".", r"\.") for s in SOCIAL))
    own = F.when((primary != "") & ~social(primary), primary)
    rest = F.filter(F.split(others, r"[,;\s]+"), lambda u: (u != "") & ~social(u))
    return F.coalesce(own, F.try_element_at(rest, F.lit(1)), F.nullif(primary, F.lit("")))


def with_scheme(url: Column) -> Column:
    """https:// before an address without a scheme."""
    plain = F.nullif(F.trim(url), F.lit(""))
    return F.when(plain.rlike("(?i)^https?://"), plain).otherwise(F.concat(F.lit("https://"), plain))


def company_slug(url: Column) -> Column:
    """The company's name in the address of its page; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?i)linkedin\.com/company/([^/?#]+)", 1)), F.lit(""))


def person(name: Column) -> Column:
    """first and last of 'FIRST M. LAST' or 'LAST, FIRST M.', upper case, initials and NMN apart; empty texts if none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[^\w\s,'-]", " "), r"\s+", " "))
    halves = F.split(plain, r"\s*,\s*")
    given = F.filter(F.split(F.when(plain.contains(","), F.get(halves, F.lit(1))).otherwise(plain), " "), lambda w: (F.length(w) > 1) & (w != "NMN"))
    last = F.when(plain.contains(",") & (F.length(F.get(halves, F.lit(0))) > 1), F.array(F.get(halves, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    words = F.concat(given, last)
    at = lambda i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    return F.struct(at(1).alias("first"), at(-1).alias("last"))


def same_person(a: Column, b: Column) -> Column:
    p, q = person(a), person(b)
    return (p["first"] != "") & (p["first"] == q["first"]) & (p["last"] == q["last"])


def confidence(**found: Column) -> Column:
    """Sum of the WEIGHTS of the fields found (name=boolean column), in hundredths exactly, 1 at most."""
    total = F.lit(0)
    for name, there in found.items():
        total = total + F.when(there, F.lit(round(100 * WEIGHTS[name]))).otherwise(0)
    return F.least(total, F.lit(100)) / 100


def status_of(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "auto_enriched").when(confidence >= 0.4, "needs_manual_review").otherwise("no_data_found")
