"""Decisions on what was found about a firm: evidence rows in, one decision for each firm and field out.

Evidence: id, type, value, source, strength, anchor, place (its order).  Firms: id, name, website, crd.  A decision has
status (verified, candidate, rejected), value and reason; a firm without evidence has none, or no_data in statuses().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import formats
from fathom.functions import names as N
from fathom.functions import text as T
from fathom.functions import web

#: Beginnings of anchors and sources, and reasons, as records hold them.
REGISTER, LISTED = "sec_adv_crd:", "external_db:"
NO_SITE, NO_PAGE = "no_distinctive_token_match", "slug_no_distinctive_token"
SEARCHED, UNSEARCHED, CONTACT = "linkedin_search_with_anchor", "unanchored_linkedin_search_no_firm_match", "external_db_contact"
#: What isn't a person's name.
NOT_A_PERSON = r"(?i)\b(LLC|LP|Inc|Corp|Ltd|Fund|Trust|Foundation)\b"


def _first(rows: DataFrame, verdict: Column, rejected: str, *order: str) -> DataFrame:
    """Each id's first row with a verdict, else a rejection for the reason given."""
    judged = rows.withColumn("_v", verdict)
    by = F.struct(*order)
    hit = F.min_by(F.struct("_v.status", "value", "_v.reason"), F.when(F.col("_v").isNotNull(), by))
    out = judged.groupBy("id").agg(hit.alias("d"))
    return out.select("id", F.coalesce("d.status", F.lit("rejected")).alias("status"), F.col("d.value").alias("value"), F.coalesce("d.reason", F.lit(rejected)).alias("reason"))


def _said(status: str, reason: Column | str) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _named(words: Column, place: Column) -> Column:
    return F.exists(words, lambda w: place.contains(w))


def websites(evidence: DataFrame, firms: DataFrame) -> DataFrame:
    """The strongest evidence that a register anchors is verified; a domain with a word of the firm's name is a candidate."""
    rows = evidence.filter("type = 'website_url'").join(firms.select("id", "name", "website", F.col("crd").cast("string").alias("crd")), "id", "left")
    host = T.hostname(F.col("value"))
    anchored = F.coalesce(F.col("anchor").startswith(REGISTER), F.lit(False))
    anchor = F.when(anchored, F.col("anchor")).otherwise(F.concat(F.lit(REGISTER), F.coalesce("crd", F.lit("unknown"))))
    verdict = F.when((F.coalesce(host, F.lit("")) != "") & (anchored | web.same_site(F.col("website"), F.col("value"))), _said("verified", F.concat(F.lit("anchored_by:"), anchor)))
    verdict = verdict.when((host != "") & _named(N.site_words(F.col("name")), host), _said("candidate", "distinctive_token_in_domain_no_anchor"))
    rank = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "medium", 1).when(F.col("strength") == "weak", 2).otherwise(3)
    return _first(rows.withColumn("_rank", rank), verdict, NO_SITE, "_rank", "place")


def company_pages(evidence: DataFrame, firms: DataFrame, sites: DataFrame) -> DataFrame:
    """A page that the verified site links to is verified; others are candidates if their name holds a word of the firm's."""
    rows = evidence.filter("type = 'linkedin_company_url'").join(firms.select("id", "name"), "id", "left").join(sites.select("id", (F.col("status") == "verified").alias("sure")), "id", "left")
    words, slug = N.site_words(F.col("name")), formats.company_slug(F.col("value"))
    linked, sure = F.coalesce(F.col("anchor") == "website_links_to_linkedin", F.lit(False)), F.coalesce("sure", F.lit(False))
    named = (slug != "") & _named(words, slug)
    verdict = F.when(linked & sure, _said("verified", "found_on_verified_website")).when(linked, _said("candidate", "website_links_to_linkedin_but_website_not_verified"))
    verdict = verdict.when(sure & named, _said("candidate", "slug_token_match_with_verified_website")).when((slug != "") & (named | (F.size(words) == 0)), _said("candidate", "search_result_candidate"))
    return _first(rows.withColumn("_rank", F.when(linked, 0).when(sure & named, 1).otherwise(2)), verdict, NO_PAGE, "_rank", "place")


def emails(evidence: DataFrame) -> DataFrame:
    """The first anchored address is verified, else the first is a candidate."""
    rows = evidence.filter("type = 'primary_contact_email'")
    there = F.coalesce(F.col("anchor") != "", F.lit(False))
    verdict = F.when(there, _said("verified", F.concat(F.lit("anchored_by:"), F.col("anchor")))).otherwise(_said("candidate", "unanchored_email_candidate"))
    return _first(rows.withColumn("_rank", F.when(there, 0).otherwise(1)), verdict, NO_SITE, "_rank", "place")


def team(evidence: DataFrame, firms: DataFrame, sites: DataFrame, pages: DataFrame) -> DataFrame:
    """A decision for each person (value is the name; title may be null) by the first evidence of that name; platform staff and companies go."""
    rows = evidence.filter("type = 'team_member' AND value <> ''").filter(~F.col("value").rlike(NOT_A_PERSON) & ~F.col("value").rlike(N.PLATFORM_STAFF))
    rows = rows.withColumn("person", F.lower(F.trim("value"))).groupBy("id", "person").agg(F.min_by(F.struct("value", "source", "anchor", "title"), "place").alias("e")).select("id", "e.*")
    rows = rows.join(firms.select("id", "name"), "id", "left").join(sites.select("id", F.col("status").alias("site")), "id", "left").join(pages.select("id", F.col("status").alias("page")), "id", "left")
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    sure = is_("site", "verified") | is_("page", "verified")
    says = F.coalesce(_named(N.site_words(F.col("name")), F.lower("title")), F.lit(False))
    on_site, searched = is_("anchor", "found_on_candidate_website"), F.coalesce(F.col("source").contains("linkedin_search"), F.lit(False))
    listed = F.coalesce(F.col("source").startswith(LISTED), F.lit(False))
    verdict = F.when(on_site & is_("site", "verified"), _said("verified", "on_verified_website")).when(on_site & is_("site", "candidate"), _said("candidate", "on_candidate_website_only")).when(on_site, _said("rejected", "website_not_verified"))
    verdict = verdict.when(searched & sure & says, _said("candidate", SEARCHED)).when(searched, _said("rejected", UNSEARCHED))
    verdict = verdict.when(listed, _said("candidate", CONTACT)).when(sure, _said("candidate", "unanchored_with_context")).otherwise(_said("rejected", "no_anchor_available"))
    return rows.select("id", "value", verdict.alias("_v")).select("id", "_v.status", "value", "_v.reason")


def statuses(firms: DataFrame, **fields: DataFrame) -> DataFrame:
    """id, status (verified, partial, candidates_only, no_data) and confidence (share of the fields with something verified)."""
    rows = None
    for name, decisions in fields.items():
        part = decisions.select("id", F.lit(name).alias("field"), "status")
        rows = part if rows is None else rows.unionByName(part)
    sure, maybe = F.col("status") == "verified", F.col("status") == "candidate"
    found = rows.groupBy("id").agg(F.count_if(sure).alias("sure"), F.count_if(maybe).alias("maybe"), F.count_distinct(F.when(sure, F.col("field"))).alias("n"))
    status = F.when((F.col("sure") > 0) & (F.col("maybe") == 0), "verified").when(F.col("sure") > 0, "partial").when(F.col("maybe") > 0, "candidates_only").otherwise("no_data")
    return firms.select("id").join(found, "id", "left").select("id", status.alias("status"), (F.coalesce("n", F.lit(0)) / len(fields)).alias("confidence"))


def site_conflicts(evidence: DataFrame) -> DataFrame:
    """id, n_hosts, conflict (more than one host) and agreed (one host named by two rows)."""
    hosts = evidence.filter("type = 'website_url'").select("id", T.hostname(F.col("value")).alias("host")).filter("host <> ''").groupBy("id", "host").agg(F.count("*").alias("n"))
    return hosts.groupBy("id").agg(F.count("*").alias("n_hosts"), (F.count("*") > 1).alias("conflict"), (F.max("n") > 1).alias("agreed"))


def public_view(firms: DataFrame, sites: DataFrame, pages: DataFrame, mails: DataFrame) -> DataFrame:
    """What may be shown: verified values only, and nothing of firms whose site and page are both unverified."""
    sure = lambda d, name: d.filter("status = 'verified'").select("id", F.col("value").alias(name))
    rows = firms.select("id").join(sure(sites, "website"), "id", "left").join(sure(pages, "linkedin"), "id", "left").join(sure(mails, "email"), "id", "left")
    hidden = F.col("website").isNull() & F.col("linkedin").isNull()
    return rows.select("id", "website", "linkedin", F.when(~hidden, F.col("email")).alias("email"), hidden.alias("suppressed"))
