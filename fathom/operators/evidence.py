"""From what sources say about a manager to the record that is shown, with where each value comes from.

Evidence is a log that only grows: who (id), what (type, value), source, field, strength, anchor, title, place, when it
was captured, and whether the source takes it back.  The present is folded from the log: of each source's statements of
one value the last one counts, whenever it arrived.  Decisions follow from the present, and the record from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators import decisions as D
from fathom.operators.registry import NOISY

#: Sources in the order in which their evidence is looked at.
ORDER = ("register", "reference", "search", "website", "people")
COLUMNS = ("id", "type", "value", "source", "field", "strength", "anchor", "title", "captured_at", "withdrawn", "place")
FIELDS = ("website_url", "linkedin_company_url", "primary_contact_email", "team_members")
#: Why a record isn't shown.
NO_ANCHOR = "no_company_anchor"
_FAR = 1_000_000


def stated(rows: DataFrame, kind: str, value: Column, source: Column, field: str, strength: str, captured: Column, order: str, place: Column | int = 0, anchor: Column | None = None, title: Column | None = None, withdrawn: Column | None = None) -> DataFrame:
    """A piece of the log: what each of rows (id) says of one kind.  Rows without a value say nothing."""
    none = F.lit(None).cast("string")
    place = (F.lit(place) if isinstance(place, int) else place) + ORDER.index(order) * _FAR
    made = (
        F.col("id"), F.lit(kind), value, source, F.lit(field), F.lit(strength), none if anchor is None else anchor, none if title is None else title, captured.cast("timestamp"), F.lit(False) if withdrawn is None else withdrawn, place.cast("long"),
    )
    return rows.select(*(c.alias(n) for c, n in zip(made, COLUMNS))).filter("value <> ''")


def log(*pieces: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, pieces)


def from_register(rows: DataFrame, captured: Column) -> DataFrame:
    """What the register says of rows (id, crd, primary_website, cco_email, phone_number) with a crd: all of it anchored there."""
    known = rows.filter("crd IS NOT NULL")
    crd = F.col("crd").cast("string")
    site = F.when(~F.lower("primary_website").rlike("|".join(h.replace(".", r"\.") for h in NOISY)), F.col("primary_website"))
    say = lambda kind, value, field, place: stated(known, kind, value, F.concat(F.lit("sec_adv:crd:"), crd), field, "strong", captured, "register", place, anchor=F.concat(F.lit(D.REGISTER), crd))
    return log(say("website_url", site, "primary_website", 0), say("primary_contact_email", F.lower("cco_email"), "cco_email", 1), say("phone_number", F.col("phone_number"), "phone_number", 2))


def from_reference(rows: DataFrame, captured: Column) -> DataFrame:
    """What a reference of investors says of rows (id, list, website_url, linkedin_url, primary_contact_email, contact_name): no anchor, so it needs another source."""
    source = F.concat(F.lit(D.LISTED), F.coalesce("list", F.lit("unknown")))
    kinds = (("website_url", "website_url", "medium"), ("linkedin_company_url", "linkedin_url", "medium"), ("primary_contact_email", "primary_contact_email", "medium"), ("team_member", "contact_name", "weak"))
    return log(*(stated(rows, kind, F.col(field), source, field, strength, captured, "reference", i) for i, (kind, field, strength) in enumerate(kinds) if field in rows.columns))


def present(evidence: DataFrame, as_of: str | None = None) -> DataFrame:
    """The evidence that stands: the last statement of each source on each value captured up to as_of, unless it takes the value back.

    The order of arrival doesn't count.  Of statements of one time one that takes back is the last; values that differ
    in case are different.  captured_at is that of the first statement since the value was last taken back.
    """
    told = evidence if as_of is None else evidence.filter(F.col("captured_at") <= F.lit(as_of).cast("timestamp"))
    key = ["id", "type", "value", "source"]
    backs = told.filter("withdrawn").groupBy(*key).agg(F.max("captured_at").alias("back"))
    stands = told.filter("NOT withdrawn").join(backs, key, "left").filter(F.col("back").isNull() | (F.col("captured_at") > F.col("back")))
    said = ("field", "strength", "anchor", "title", "place")
    kept = stands.groupBy(*key).agg(F.max_by(F.struct(*said), F.struct("captured_at", "place")).alias("last"), F.min("captured_at").alias("captured_at"))
    return kept.select(*key, *(F.col(f"last.{c}").alias(c) for c in said), "captured_at")


def decide(evidence: DataFrame, firms: DataFrame) -> dict[str, DataFrame]:
    """The decisions by field on the present evidence on firms (id, name, website, crd)."""
    sites = D.websites(evidence, firms)
    pages = D.company_pages(evidence, firms, sites)
    return dict(zip(FIELDS, (sites, pages, D.emails(evidence), D.team(evidence, firms, sites, pages))))


def legacy_status(site: Column, page: Column, useful: Column) -> Column:
    """The status of older lists, from the two company fields and whether anything is verified or a candidate."""
    sure = (site == "verified") | (page == "verified")
    return F.when(F.coalesce(sure, F.lit(False)), "auto_enriched").when(useful, "candidates_only").otherwise("no_data_found")


def records(evidence: DataFrame, firms: DataFrame) -> DataFrame:
    """What is known of firms and how sure it is: a row each with status, legacy_status, confidence, the decisions as JSON, anchors, and the values that may be shown.

    A firm whose site and page are both unverified shows nothing.  evidence is the present one.
    """
    made = decide(evidence, firms)
    first = evidence.groupBy("id", "type", "value").agg(F.min_by(F.struct("source", "field", "anchor", "title", F.date_format("captured_at", "yyyy-MM-dd").alias("captured_at")), "place").alias("from"))

    def field(name: str) -> DataFrame:
        kind = "team_member" if name == "team_members" else name
        why = first.filter(F.col("type") == kind).select("id", "value", "from")
        return made[name].join(why, ["id", "value"], "left").select("id", F.struct("status", "value", "reason", "from.source", "from.field", "from.captured_at", "from.title").alias(name))

    one = [field(name) for name in FIELDS[:3]]
    people = field("team_members").groupBy("id").agg(F.sort_array(F.collect_list("team_members")).alias("team_members"))
    rows = reduce(lambda a, b: a.join(b, "id", "left"), [firms.select("id", "crd"), *one, people])
    people = F.coalesce("team_members", F.array().cast(people.schema["team_members"].dataType))
    status = lambda name: F.col(f"{name}.status")
    every = F.concat(F.array(*map(status, FIELDS[:3])), F.transform(people, lambda t: t["status"]))
    useful = F.filter(every, lambda s: s.isin("verified", "candidate"))
    sure = F.filter(people, lambda t: t["status"] == "verified")
    overall = F.when(F.size(useful) == 0, "no_data").when(F.forall(useful, lambda s: s == "verified"), "verified").when(F.array_contains(useful, "verified"), "partial").otherwise("candidates_only")
    verified = [F.coalesce(status(name) == "verified", F.lit(False)) for name in FIELDS[:3]]
    n = sum((v.cast("int") for v in verified), F.lit(0)) + (F.size(sure) > 0).cast("int")
    registered = F.col("crd").isNotNull() | (verified[0] & F.coalesce(F.startswith("website_url.reason", F.lit(f"anchored_by:{D.REGISTER}")), F.lit(False)))
    anchors = F.array_compact(F.array(F.when(registered, "sec_adv_crd"), F.when(verified[1], "linkedin_self")))
    told = F.to_json(F.struct(*FIELDS[:3], F.when(F.size(people) > 0, people).alias("team_members")))
    shown = verified[0] | verified[1]
    value = lambda i: F.when(shown & verified[i], F.col(f"{FIELDS[i]}.value"))
    return rows.select(
        "id", overall.alias("status"), legacy_status(status(FIELDS[0]), status(FIELDS[1]), F.size(useful) > 0).alias("legacy_status"), (n / len(FIELDS)).alias("confidence"),
        F.array_join(anchors, ",").alias("anchors"), value(0).alias("website"), value(1).alias("linkedin"), value(2).alias("email"),
        F.when(shown, F.array_join(F.transform(sure, lambda t: F.concat_ws(" - ", t["value"], t["title"])), "; ")).alias("team"),
        F.when(shown & verified[0], F.concat_ws(" ", "website_url.source", "website_url.captured_at")).alias("website_from"),
        (~shown).alias("suppressed"), F.when(~shown, NO_ANCHOR).alias("suppressed_reason"), told.alias("field_evidence"),
    )
