"""Normal forms of names, shorter variants, tokens and how far two names agree.  Null in, null out, unless said otherwise.

Several normal forms exist because each kind of match was made with its own; they aren't interchangeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import similar
from fathom.functions import text as T

_LEGAL = r"(?i),?\s*(LP|LLC|L\.P\.|L\.L\.C\.|Ltd|Limited|Inc|Incorporated)"
_NUMBER = [(r"(?i)\s+(Fund\s+)?[IVX]+$", ""), (r"(?i)\s+Fund\s+\d+$", "")]
_STRIP = [(r"(?i)\s*,?\s*(LP|LLC|L\.P\.|L\.L\.C\.|LTD|LIMITED|INC|CORP|INCORPORATED)\.?\s*$", ""), (r"(?i)\s+(Fund\s+)?(I{1,3}|IV|V|VI{0,3}|IX|X|\d+)\s*$", "")]

#: Normal form -> case, then what is replaced by what, in this order.
FORMS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "server": ("upper", [(p, " ") for p in (", LLC", " LLC", ", LP", " LP", ", L.P.", " L.P.", ", L.L.C.", " L.L.C.", " INC", " INC.", ", INC", ", INC.", " FUND", " A SERIES OF", ", A SERIES OF")] + [(r"\s+", " ")]),
    "registration": ("upper", [(r"[.,\-'\"]", " "), (r"\s+", " "), (r"\b(LLC|L\.?L\.?C\.?|LP|L\.?P\.?|LTD|LIMITED|INC|INCORPORATED|CORP|CORPORATION)\b", "")]),
    "fund": ("upper", [(r"\s+", " "), (r"[,.]", ""), (r"\bLLC\b", ""), (r"\bINC\b", ""), (r"\s+I\s+", " 1 "), (r"\s+II\s+", " 2 "), (r"\s+III\s+", " 3 "), (r"\s+IV\s+", " 4 ")]),
    "investor": ("lower", [(r"[^a-z0-9\s]", " "), (r"\b(llc|llp|lllp|lp|ltd|inc|corp|corporation|company|co|gp|limited|partnership|pllc|plc|sa|ag|gmbh|bv|nv)\b", " "), (r"\b(i{1,3}|iv|v|vi{0,3}|ix|x|xi{0,3})\b$", " "), (r"\s+", " ")]),
    "manager": ("lower", [(r",?\s*(lp|llc|l\.p\.|l\.l\.c\.|ltd|limited|inc|incorporated)\.?$", ""), (r"\s+", " ")]),
    "display": ("lower", [(r"[,.'\"\-()]", " "), (r"\s+", " ")]),
    "base": ("", [(r"(?i)\s+(GP|General Partner|Manager|Management|Advisors?|Advisers?|Master)\s*,?\s*(LLC|LP|L\.?P\.?)?$", ""), (r"(?i)\s*,?\s*(LLC|L\.?L\.?C\.?|LP|L\.?P\.?|LTD|LIMITED|INC|INCORPORATED)\.?$", ""), (r"(?i)\s+(Fund|Capital|Ventures?|Partners?|Holdings?|Group)\s+(I{1,3}|IV|V|VI|VII|VIII|IX|X|\d+)$", "")]),
    "master": ("", [(_LEGAL + "$", ""), (r"(?i)^.*?,?\s+a\s+series\s+of\s+(.+?)$", "$1"), *_NUMBER]),
    "plain": ("", [(_LEGAL + "$", ""), *_NUMBER]),
    "entity": ("", [*_NUMBER, (r"\s+\d+$", ""), (r"(?i)\s*-?\s*(Series|Class|Tranche)\s+[A-Za-z0-9-]+$", ""), (_LEGAL + "$", "")]),
    "stripped": ("", _STRIP),
    "party": ("", [(r"(?i)^N/A\s+", ""), (r"(?i)^LLC\s+", ""), (r"(?i)^Ltd\.?\s+", ""), (r"(?i)^Limited\s+", ""), (r"(?i)^L\.L\.C\.?\s+", ""), (r"(?i)^L\.P\.?\s+", ""), (r"(?i)^Inc\.?\s+", ""), (r"[,\s]+$", "")]),
    "exemptions": ("", [(r"(?i)\b0?6B\b", "506(b)"), (r"(?i)\b0?6C\b", "506(c)"), (r"(?i)\b(3C\.7|3\.C\.7|3c7|3C\.1|3\.C\.1|3c1|3C)\b", ""), (r",\s*,", ","), (r"^[,\s]+|[,\s]+$", ""), (r"\s+,", ","), (r",\s+", ", ")]),
}

#: Last words that name a strategy.
TAILS = ("Opportunity", "Opportunities", "Growth", "Income", "Aggressive", "Balanced", "Conservative", "Diversified", "Sustainable", "Impact", "ESG", "Global", "International", "Emerging", "Technology", "Healthcare", "Climate", "Select", "Premium", "Enhanced", "Plus", "Pro", "Elite", "Alpha", "Beta", "Master", "Feeder", "Onshore", "Offshore")
#: First words that don't stand for a firm.
GENERIC = ("fund", "funds", "capital", "ventures", "venture", "partners", "partner", "management", "advisors", "advisers", "group", "holdings", "the")
#: Words that don't tell advisers apart.
COMMON = ("the", "of", "and", "co", "llc", "lp", "llp", "ltd", "inc", "corp", "company", "fund", "funds", "capital", "ventures", "venture", "partners", "partner", "partnership", "partnerships", "holdings", "holding", "group", "management", "mgmt", "advisors", "advisers", "gp", "master", "feeder", "series", "spv", "spvs", "investment", "investments", "first", "new", "global", "international")
#: Words that don't count for weighted_similarity; unlike elsewhere, their stems do.
WEIGHED_COMMON = ("the", "of", "and", "co", "llc", "lp", "llp", "ltd", "inc", "corp", "corporation", "company", "fund", "funds", "capital", "ventures", "venture", "partners", "partner", "holdings", "group", "management", "mgmt", "advisors", "advisers", "gp", "master", "feeder", "series", "spv", "spvs", "first", "new", "global", "international", "holding")
#: Words that don't tell domains apart.
SITE_GENERIC = ("capital", "ventures", "venture", "partners", "partner", "fund", "funds", "management", "advisors", "advisers", "group", "holdings", "investment", "investments", "private", "equity", "asset", "global", "international")
#: Endings and words of company names.
COMPANY = r"(?i)\b(LLC|L.L.C.|LP|L.P.|LTD|LIMITED|INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|PARTNERS|PARTNERSHIP|HOLDINGS|GROUP|FUND|MANAGEMENT|CAPITAL|ADVISORS|ADVISERS|VENTURES|INVESTMENTS|EQUITY|ASSET|SECURITIES)\b\.?$|MANAGEMENT|CAPITAL|PARTNERS|ADVISORS|VENTURES|INVESTMENTS"
#: Related persons that stand for a platform.
PLATFORM_STAFF = r"(?i)\b(angellist|sydecar|carta|allocations|belltower|forge|assure|fund\s+gp|cgf2021)\b"


def normal(name: Column, form: str) -> Column:
    """The name in one of FORMS, trimmed."""
    case, steps = FORMS[form]
    start = {"upper": F.upper, "lower": F.lower, "": lambda c: c}[case](name)
    return F.trim(reduce(lambda c, step: F.regexp_replace(c, *step), steps, start))


def party(name: Column) -> Column:
    """A related party without what precedes its name; null for none and N/A."""
    plain = normal(name, "party")
    return F.when(~F.upper(F.trim(name)).isin("N/A", "") & ~F.upper(plain).isin("N/A", ""), plain)


def actual_fund(name: Column) -> Column:
    """The part before 'a series of' if it says more than a number, else the whole name."""
    part = F.trim(F.regexp_extract(name, r"(?i)^(.+?),?\s+a\s+series\s+of\s+", 1))
    return F.when((F.length(part) > 5) & ~part.rlike(r"(?i)^Fund\s+[IVX\d]+$"), part).otherwise(name)


def is_company(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike(COMPANY), F.lit(False))


def series_manager(name: Column) -> Column:
    """The manager in '..., a series of X', '... - series of X' or 'X - Series 7' (if X is a company); null if there is none."""
    found = lambda pattern: F.nullif(F.trim(F.regexp_extract(name, pattern, 1)), F.lit(""))
    before = found(r"(?i)^(.+?)\s+-\s+Series\s+[A-Za-z0-9]+$")
    return F.coalesce(found(r"(?i)[,\s]+a\s+series\s+of\s+(.+?)$"), found(r"(?i)\s+-\s+series\s+of\s+(.+?)$"), F.when(is_company(before), before))


def slug_id(slug: Column) -> Column:
    """The number a slug begins with; the slug itself if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(slug, r"^(\d+)-", 1), F.lit("")), slug)


def with_variants(rows: DataFrame, name: str, to: str = "variants", extra: str | None = None) -> DataFrame:
    """rows with ever shorter forms of a name, each of three characters or more and once; its form ``extra`` comes second.

    Each step is a column of its own, so that none is computed again inside the next.
    """
    c = F.col
    steps = {
        "_plain": normal(c(name), "stripped"),
        "_less": F.trim(F.regexp_replace("_plain", rf"(?i)\s+({'|'.join(TAILS)})\s*$", "")),
        "_cut": F.when((c("_less") != c("_plain")) & (F.length("_less") >= 3), c("_less")),
        "_again": normal(c("_cut"), "stripped"),
        "_words": F.filter(F.split("_plain", r"\s+"), lambda w: F.length(w) >= 2),
        "_extra": F.trim(normal(c(name), extra)) if extra else F.lit(None).cast("string"),
        "_two": F.when(F.size("_words") >= 3, F.array_join(F.slice("_words", 1, 2), " ")),
        "_first": F.try_element_at("_words", F.lit(1)),
        "_one": F.when((F.size("_words") >= 2) & ~F.lower("_first").isin(*GENERIC), c("_first")),
        "_listed": F.array("_plain", "_extra", "_cut", "_again", "_two", "_one"),
        to: F.array_distinct(F.filter("_listed", lambda v: F.length(v) >= 3)),
    }
    out = rows
    for step, value in steps.items():
        out = out.withColumn(step, value)
    return out.drop(*(step for step in steps if step != to))


def words_of(name: Column, least: int = 2, stem_from: int = 4) -> Column:
    """Distinct lower-case words of least characters or more; a final s goes from stem_from on."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_distinct(F.transform(words, lambda w: F.when(F.length(w) >= stem_from, F.regexp_replace(w, "s$", "")).otherwise(w)))


def telling(words: Column, common: tuple[str, ...] = COMMON) -> Column:
    """The words that aren't common, whether stemmed or not."""
    stems = {w[:-1] if len(w) >= 4 and w.endswith("s") else w for w in common}
    return F.filter(words, lambda w: ~w.isin(*sorted({*common, *stems})))


def site_words(name: Column) -> Column:
    """Words of a firm that its domain may hold: four characters or more, none generic; an empty list for a null."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*SITE_GENERIC))


def keywords(name: Column) -> Column:
    """The first three words of an adviser that tell it apart, upper case."""
    skip = ("LLC", "LP", "INC", "CAPITAL", "PARTNERS", "MANAGEMENT", "FUND", "ADVISORS", "ADVISERS", "INVESTMENTS", "GROUP", "HOLDINGS", "THE", "AND", "OF")
    return F.slice(F.filter(F.split(F.upper(name), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*skip)), 1, 3)


def within(a: Column, b: Column) -> Column:
    """Every element of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def same_adviser(a: Column, b: Column, legal: bool = False) -> Column:
    """Word lists name one adviser: one holds the other, with no telling word left over; b needs two words (three if it is a legal name)."""
    ta, tb = telling(a), telling(b)
    fits = (within(b, a) & within(ta, tb)) | (within(a, b) & within(tb, ta))
    return (F.size(b) >= (3 if legal else 2)) & (F.size(F.array_intersect(ta, tb)) >= 1) & fits


def gate_result(name: Column, found: Column, related: Column) -> Column:
    """Struct of passes, downgrade and reason: two shared distinctive tokens or a long one pass; a short one is only downgraded where persons stand behind it."""
    shared = F.array_intersect(T.distinctive_tokens(name), T.distinctive_tokens(found))
    n, token = F.size(shared), F.try_element_at(shared, F.lit(1))
    persons = F.size(F.filter(F.split(F.coalesce(related, F.lit("")), r"\|"), lambda p: (F.length(F.trim(p)) > 2) & ~p.rlike(PLATFORM_STAFF)))
    passes = (n >= 2) | ((n == 1) & (F.length(token) >= 5))
    weak = (n == 1) & (F.length(token) < 5) & (persons > 0)
    reason = F.when(n >= 2, F.format_string("shares_%d_distinctive_tokens", n)).when(passes, F.concat(F.lit("single_long_distinctive:"), token))
    reason = reason.when(weak, F.format_string("acronym_%s_weak_corroboration_%d_persons", token, persons)).when(n == 1, F.format_string("acronym_%s_no_corroboration", token))
    return F.struct(passes.alias("passes"), weak.alias("downgrade"), reason.otherwise("zero_shared_distinctive_tokens").alias("reason"))


def weighed(words: Column) -> Column:
    """The words that count for weighted_similarity."""
    return F.filter(words, lambda w: ~w.isin(*WEIGHED_COMMON))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Half shared telling words, a fifth shared words, a fifth Jaro-Winkler, a tenth length; 0 without words."""
    wa, wb = words_of(a), words_of(b)
    ta, tb = weighed(wa), weighed(wb)
    part = lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(0.5 * part(ta, tb) + 0.2 * part(wa, wb) + 0.2 * similar.jaro_winkler(a, b) + 0.1 * ratio)


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of places with the same character; 0 where the lengths differ by more than a tenth."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), shorter), lambda i: a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))))
    return F.when((shorter == 0) | (shorter / longer < 0.9), 0.0).otherwise(same / longer)


#: Words that don't tell firms apart in tiered_similarity.
TIER_GENERIC = ("FUND", "FUNDS", "MANAGEMENT", "CAPITAL", "PARTNERS", "PARTNER", "INVESTMENTS", "INVESTMENT", "ADVISORS", "ADVISERS", "VENTURES", "HOLDINGS", "GROUP", "COMPANY", "CO", "THE", "OF", "AND", "GP", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def tiered_similarity(a: Column, b: Column) -> Column:
    """1 if equal in form registration, .9 if one holds the other, .95 and .85 by telling words, .85 by the first two words, else the share of equal words."""
    na, nb = normal(a, "registration"), normal(b, "registration")
    listed = lambda n: F.filter(F.split(n, " "), lambda w: F.length(w) > 1)
    wa, wb = listed(na), listed(nb)
    ta, tb = (F.filter(w, lambda x: ~x.isin(*TIER_GENERIC)) for w in (wa, wb))
    hit, longest = F.size(F.array_intersect(ta, tb)), F.greatest(F.size(ta), F.size(tb))
    both = (F.size(ta) > 0) & (F.size(tb) > 0)
    out = F.when((na == "") | (nb == ""), 0.0).when(na == nb, 1.0).when(na.contains(nb) | nb.contains(na), 0.9).when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0)
    out = out.when(both & ((hit == F.size(ta)) | (hit == F.size(tb))), 0.95).when(both & (hit >= 1) & (hit / longest >= 0.5), 0.85)
    out = out.when((F.size(wa) >= 2) & (F.size(wb) >= 2) & (F.slice(wa, 1, 2) == F.slice(wb, 1, 2)), 0.85)
    return out.otherwise(F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb)))
