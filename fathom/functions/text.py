"""Column functions on names, codes, dates, amounts and URLs.  Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal endings of a name.
SUFFIXES = ("LLC", "L L C", "LP", "L P", "INC", "LTD", "CO", "CORP", "CORPORATION", "COMPANY", "LIMITED")
#: Words that don't tell names apart.
STOPWORDS = ("the", "of", "and", "a", "an", "fund", "funds", "capital", "ventures", "venture", "partners", "partner", "holdings", "group", "management", "mgmt", "advisors", "advisers", "gp", "lp", "llc", "llp", "inc", "ltd", "corp", "corporation", "co", "series", "master", "feeder")
SERIES = r"(?i),?\s+a\s+series\s+of\s+(.+?)\s*,?\s*$"


def normalised_name(name: Column) -> Column:
    """Upper case, no punctuation, no legal ending however often repeated."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), r"[,.'\"()/-]", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(plain, f"( ({'|'.join(SUFFIXES)}))+$", ""))


def series_master(name: Column) -> Column:
    """The manager in '..., a series of X'; null if there is none."""
    return F.nullif(F.regexp_extract(name, SERIES, 1), F.lit(""))


def slug(name: Column) -> Column:
    """Lower case words joined by hyphens, 80 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 80)


def listed(text: Column) -> Column:
    """Parts of a list delimited by | , or ; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[;,|]"), lambda x: F.trim(x)), lambda x: x != "")


def mixed_date(text: Column) -> Column:
    """A date written as yyyy-MM-dd or d-MMM-yyyy; null for others."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "d-MMM-yyyy"))


def loose_date(text: Column) -> Column:
    """The first d-MMM-yyyy anywhere in a text, else the date that it is as a whole: ISO with or without a time, month/day/year, or a month's name first; null for others."""
    inside = F.try_to_date(F.regexp_extract(text, r"(?i)(\d{1,2}-(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-\d{4})", 1), "d-MMM-yyyy")
    iso = F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$", 1), "yyyy-MM-dd")
    return F.coalesce(inside, iso, F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "MMM d, yyyy"), F.try_to_date(text, "MMMM d, yyyy"))


def filing_date(text: Column) -> Column:
    """mixed_date; missing and unreadable ones are the first day of 1970."""
    return F.coalesce(mixed_date(text), F.lit("1970-01-01").cast("date"))


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd of a date in either form; null for none, an empty text and a hyphen; others stay as written."""
    return F.when(~text.isin("", "-"), F.coalesce(F.date_format(mixed_date(text), "yyyy-MM-dd"), text))


def shown_date(text: Column) -> Column:
    """MM/dd/yyyy of a date in either form, a hyphen for none; others stay as written."""
    return F.when(text.isNull() | text.isin("", "-"), "-").otherwise(F.coalesce(F.date_format(mixed_date(text), "MM/dd/yyyy"), text))


def written_date(text: Column) -> Column:
    """'Jan 5, 2024' of a date in either form, N/A for none; others stay as written."""
    return F.when(text.isNull() | (text == ""), "N/A").otherwise(F.coalesce(F.date_format(mixed_date(text), "MMM d, yyyy"), text))


def year_in(text: Column) -> Column:
    """The first year of the 20th or 21st century that a text names."""
    return F.regexp_extract(text, r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int")


def leading_number(text: Column) -> Column:
    """The number that a text begins with, as written; null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d*\.?\d+)", 1).try_cast("double")


def dollars(text: Column) -> Column:
    """The whole dollars of a text; null for none."""
    return F.regexp_extract(F.regexp_replace(text, "[$,\\s]", ""), r"^([+-]?\d+)", 1).try_cast("long")


def is_yes(flag: Column) -> Column:
    """Y, true, t and 1 in any case; a null is no yes."""
    return F.coalesce(F.lower(F.trim(flag)).isin("y", "true", "t", "1"), F.lit(False))


def claims_3c7(codes: Column) -> Column:
    low = F.lower(codes)
    return F.coalesce(low.contains("3c.7") | low.contains("3(c)(7)"), F.lit(False))


def claims_3c1(codes: Column) -> Column:
    """A bare 3C counts as 3(c)(1) unless 3(c)(7) is named."""
    low = F.lower(codes)
    return F.coalesce(low.contains("3c.1") | low.contains("3(c)(1)") | (low.contains("3c") & ~claims_3c7(codes)), F.lit(False))


def distinctive_tokens(name: Column) -> Column:
    """Words of three characters or more that aren't stopwords or roman numbers; a final s goes from six on."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS) & ~w.rlike("^[ivx]+$"))
    return F.array_distinct(F.transform(words, lambda w: F.when(F.length(w) >= 6, F.regexp_replace(w, "s$", "")).otherwise(w)))


def gate(a: Column, b: Column) -> Column:
    """Two token lists name the same firm: two shared tokens, or one of five characters or more."""
    shared = F.array_intersect(a, b)
    return (F.size(shared) >= 2) | F.exists(shared, lambda w: F.length(w) >= 5)


def hostname(url: Column) -> Column:
    """Lower case host without www.; empty if the url has none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", ""), F.lit(""))


def amount(text: Column) -> Column:
    """The number at the start of a text, dollar signs and commas apart; null if there is none."""
    return F.regexp_extract(F.regexp_replace(text, "[$,]", ""), r"^\s*([+-]?\d*\.?\d+)", 1).try_cast("double")


def retry_date(last: Column, attempts: Column) -> Column:
    """Next try 7, 14, 30, 60 and 90 days on; null after five."""
    return F.date_add(last, F.try_element_at(F.array(*map(F.lit, (7, 14, 30, 60, 90))), attempts + 1))


def boolean_search(text: Column, query: str) -> Column:
    """Terms (any order, all needed), "phrases" and -excluded terms; a + before a term is allowed."""
    import re

    test = F.lit(True)
    for sign, phrase, word in re.findall(r'([+-]?)(?:"([^"]+)"|(\S+))', query):
        found = F.coalesce(F.lower(text).contains((phrase or word).lower()), F.lit(False))
        test = test & (~found if sign == "-" else found)
    return test
