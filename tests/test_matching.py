"""Matching and decisions that have no SQL, on small fixtures."""

from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import web
from fathom.operators import decisions, matching
from fathom.plans.catalog import QUERIES
from fathom.plans.matching import name_pairs

DATA = "/root/testdata/sf0.001"


def test_every_name_is_paired(spark):
    n = spark.read.parquet(f"{DATA}/orders.parquet").count()
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()}
    pairs = {(i, j) for i in ids for j in (i + 14, i + 1) if j in ids}
    assert len({i for i, _ in pairs}) > 0.9 * n
    for rows in (name_pairs(spark, DATA), QUERIES["si04_weighted"](spark, DATA), QUERIES["mx03_gate"](spark, DATA)):
        assert sorted(r.id for r in rows.select("id").collect()) == sorted(i for i, _ in pairs)


def test_gate_and_profiles(spark):
    rows = [("TMS Angels", "TMS Capital", None), ("TMS Angels", "TMS Capital", "Ann Lee"), ("TMS Angels", "TMS Capital", "Sydecar LLC"), ("Locus Ventures", "Locus Capital", None), ("Alpha One", "Beta Two", None), (None, "Beta", None)]
    got = spark.createDataFrame(rows, "a string, b string, r string").select(N.gate_result(F.col("a"), F.col("b"), F.col("r")).alias("g")).collect()
    assert [(g.g.passes, g.g.downgrade) for g in got[:5]] == [(False, False), (False, True), (False, False), (True, False), (False, False)]
    assert [g.g.reason for g in got[:4]] == ["acronym_tms_no_corroboration", "acronym_tms_weak_corroboration_1_persons", "acronym_tms_no_corroboration", "single_long_distinctive:locus"]
    titles = [("Alpine Ventures", "Ann - Partner at Alpine Ventures", True), ("Alpine Ventures", "former partner, Alpine Ventures", False), ("Alpine Ventures", "Board member, Alpine Ventures", False), ("Alpine Ventures", "GP at Alpine", True), ("Capital Group", "group of capital", True), ("Capital Group", "x", False), (None, "x", False)]
    got = spark.createDataFrame(titles, "f string, t string, want boolean").select("want", web.is_current_profile(F.col("f"), F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_candidates(spark):
    rows = [(1, "Deep Sea 1, a series of Roll Up Vehicles LP", "Ann Lee", "Director"), (2, "AL, a series of Roll Up Vehicles LP", "Ann Lee | Bo Orr", "Shareholder | Promoter"), (3, "X Fund, a series of Locus LLC", None, None), (4, "Alpine Fund II LP", None, None), (5, None, None, None)]
    got = {r.id: (r.candidate, r.source, r.platform) for r in matching.manager_candidates(spark.createDataFrame(rows, "id int, entityname string, related_names string, related_roles string")).collect()}
    assert got == {1: ("Deep Sea 1", "platform_prefix", "AngelList"), 2: ("Bo Orr", "platform_principal", "AngelList"), 3: ("Locus LLC", "series_master", None), 4: ("Alpine", "entity_prefix", None), 5: ("", "entity_prefix", None)}


def test_decisions(spark):
    firms = spark.createDataFrame([(1, "Alpine Capital", "https://alpine.com", 7), (2, "Borealis Fund", None, None)], "id int, name string, website string, crd int")
    rows = [(1, "website_url", "http://www.alpine.com/x", "site", "weak", None, None, 1), (1, "linkedin_company_url", "https://linkedin.com/company/other", "site", None, "website_links_to_linkedin", None, 2), (1, "team_member", "Ann Lee", "site", None, "found_on_candidate_website", None, 3), (1, "team_member", "ann lee ", "external_db:x", None, None, None, 4),
            (2, "website_url", "https://borealis.io", "site", "strong", None, None, 1), (2, "linkedin_company_url", "https://linkedin.com/company/other", "site", None, None, None, 2), (2, "team_member", "Bob Dow", "linkedin_search", None, None, "Partner at Borealis", 3), (2, "team_member", "Trust LLC", "site", None, None, None, 4)]
    evidence = spark.createDataFrame(rows, "id int, type string, value string, source string, strength string, anchor string, title string, place int")
    sites = decisions.websites(evidence, firms)
    pages = decisions.company_pages(evidence, firms, sites)
    status = lambda d: {(r.id, r.value): r.status for r in d.collect()}
    assert status(sites) == {(1, "http://www.alpine.com/x"): "verified", (2, "https://borealis.io"): "candidate"}
    assert status(pages) == {(1, "https://linkedin.com/company/other"): "verified", (2, None): "rejected"}
    assert status(decisions.team(evidence, firms, sites, pages)) == {(1, "Ann Lee"): "verified", (2, "Bob Dow"): "rejected"}
    reasons = lambda d: {r.id: r.reason for r in d.collect()}
    assert reasons(sites) == {1: "anchored_by:sec_adv_crd:7", 2: "distinctive_token_in_domain_no_anchor"}
    assert reasons(pages) == {1: "found_on_verified_website", 2: "slug_no_distinctive_token"}
    assert reasons(decisions.team(evidence, firms, sites, pages)) == {1: "on_verified_website", 2: "unanchored_linkedin_search_no_firm_match"}
    view = {r.id: (r.website, r.suppressed) for r in decisions.public_view(firms, sites, pages, decisions.emails(evidence)).collect()}
    assert view == {1: ("http://www.alpine.com/x", False), 2: (None, True)}


def test_a_name_of_many_managers_is_looked_up_once(spark, monkeypatch):
    asked = []
    inner = N.with_variants
    monkeypatch.setattr(matching.N, "with_variants", lambda rows, *a, **k: (asked.append(rows.count()), inner(rows, *a, **k))[1])
    managers = spark.createDataFrame([(i, "Locus Alpine LLC") for i in range(400)] + [(400, None), (401, "Other")], "id int, name string")
    advisers = spark.createDataFrame([(9, "Locus Alpine"), (7, "Alpine Locus Inc"), (8, "Locus Alpine LLC")], "key int, name string")
    got = {(r.id, r.key) for r in matching.adviser_matches(managers, advisers).collect()}
    assert got == {(i, 8) for i in range(400)} and asked == [2]
