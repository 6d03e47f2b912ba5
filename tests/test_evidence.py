"""Evidence folded into the present and into records: late, repeated and withdrawn statements, in any order of arrival."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import evidence as E

SCHEMA = "id int, type string, value string, source string, field string, strength string, anchor string, title string, captured_at timestamp, withdrawn boolean, place long"
FIRMS = "id int, name string, website string, crd int"


def said(id_, kind, value, source, day, back=False, anchor=None, title=None, strength="medium", place=0):
    return (id_, kind, value, source, kind, strength, anchor, title, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), back, place)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_the_last_statement_counts(spark):
    rows = [
        said(1, "website_url", "a", "s", 1), said(1, "website_url", "a", "s", 5, True),  # taken back
        said(2, "website_url", "a", "s", 1), said(2, "website_url", "a", "s", 5, True), said(2, "website_url", "a", "s", 9, strength="weak"),  # said again
        said(3, "website_url", "a", "s", 7), said(3, "website_url", "a", "s", 5, True), said(3, "website_url", "a", "s", 2),  # an older one arrives late
        said(4, "website_url", "a", "s", 5), said(4, "website_url", "a", "s", 5, True),  # at one time: taken back
        said(5, "website_url", "a", "s", 1), said(5, "website_url", "a", "t", 2, True),  # by another source: stays
        said(6, "website_url", "a", "s", 3), said(6, "website_url", "a", "s", 3), said(6, "website_url", "a", "s", 4, anchor="x"),  # repeated
        said(7, "website_url", "a", "s", 40),
    ]
    want = {2: ("weak", None, 10), 3: ("medium", None, 8), 5: ("medium", None, 2), 6: ("medium", "x", 4)}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = E.present(table(spark, rows), "2024-01-31").collect()
        assert {r.id: (r.strength, r.anchor, r.captured_at.day) for r in got} == want and len(got) == 4
    assert 7 in {r.id for r in E.present(table(spark, rows)).collect()}
    assert E.present(table(spark, [])).collect() == []


@pytest.fixture(scope="module")
def log():
    return [
        said(1, "website_url", "https://alpine.com", "sec_adv:crd:7", 1, anchor="sec_adv_crd:7", strength="strong"),
        said(1, "linkedin_company_url", "https://linkedin.com/company/alpine", "website_html", 2, anchor="website_links_to_linkedin"),
        said(1, "primary_contact_email", "x@alpine.com", "external_db:l", 2),
        said(1, "team_member", "Ann Lee", "website_html", 3, anchor="found_on_candidate_website", title="Partner", place=1),
        said(1, "team_member", "Bob Dow", "website_html", 3, anchor="found_on_candidate_website", place=2),
        said(1, "team_member", "Carta Desk", "website_html", 3, anchor="found_on_candidate_website", place=3),
        said(2, "website_url", "https://www.borealis.vc", "brave_search", 1, strength="weak"),
        said(2, "primary_contact_email", "y@borealis.vc", "website_html", 1, anchor="found_on_candidate_website"),
        said(3, "website_url", "https://elsewhere.com", "brave_search", 1),
        said(5, "primary_contact_email", "z@z.com", "website_html", 1, anchor="found_on_candidate_website"),
    ]


@pytest.fixture(scope="module")
def firms(spark):
    return spark.createDataFrame([(1, "Alpine Capital", None, 7), (2, "Borealis Fund", None, None), (3, "Delta Fund", None, None), (4, None, None, None), (5, "Echo Ventures", None, 9)], FIRMS)


def test_records(spark, log, firms):
    got = {r.id: r for r in E.records(E.present(table(spark, log)), firms).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    r = got[1]
    assert (r.status, r.legacy_status, r.confidence, r.anchors, r.website, r.linkedin, r.email, r.team) == ("partial", "auto_enriched", 0.75, "sec_adv_crd,linkedin_self", "https://alpine.com", "https://linkedin.com/company/alpine", None, "Ann Lee - Partner; Bob Dow")
    assert r.website_from == "sec_adv:crd:7 2024-01-02" and not r.suppressed
    told = json.loads(r.field_evidence)
    assert told["website_url"]["reason"] == "anchored_by:sec_adv_crd:7" and told["primary_contact_email"]["status"] == "candidate" and [t["value"] for t in told["team_members"]] == ["Ann Lee", "Bob Dow"]
    assert (got[2].status, got[2].legacy_status, got[2].confidence, got[2].email, got[2].suppressed_reason) == ("partial", "candidates_only", 0.25, None, "no_company_anchor")
    assert (got[3].status, got[3].legacy_status, got[3].confidence) == ("no_data", "no_data_found", 0.0)
    assert (got[4].status, got[4].legacy_status, got[4].suppressed) == ("no_data", "no_data_found", True)
    assert (got[5].status, got[5].anchors) == ("verified", "sec_adv_crd")


def test_withdrawn_evidence_changes_the_record(spark, log, firms):
    later = [*log, said(1, "website_url", "https://alpine.com", "sec_adv:crd:7", 30, True, anchor="sec_adv_crd:7")]
    before, after = (({r.id: r for r in E.records(E.present(table(spark, later), day), firms).collect()}[1]) for day in ("2024-01-20", None))
    assert (before.website, before.status, before.team) == ("https://alpine.com", "partial", "Ann Lee - Partner; Bob Dow")
    # without the site neither its page nor its people are sure
    assert (after.website, after.linkedin, after.team, after.status, after.anchors, after.suppressed) == (None, None, None, "candidates_only", "sec_adv_crd", True)


def test_sources(spark):
    rows = spark.createDataFrame([(1, 7, "https://Instagram.com/x", "A@B.com", ""), (2, 8, "https://a.com", None, "5"), (3, None, "https://b.com", "c@d.e", "6")], "id int, crd int, primary_website string, cco_email string, phone_number string")
    got = {(r.id, r.type, r.value, r.anchor) for r in E.from_register(rows, F.lit("2024-01-01")).collect()}
    assert got == {(1, "primary_contact_email", "a@b.com", "sec_adv_crd:7"), (2, "website_url", "https://a.com", "sec_adv_crd:8"), (2, "phone_number", "5", "sec_adv_crd:8")}
    listed = spark.createDataFrame([(1, "openvc", "https://a.com", "", "Kim"), (2, None, None, "https://linkedin.com/company/x", None)], "id int, list string, website_url string, linkedin_url string, contact_name string")
    got = {(r.id, r.type, r.source, r.strength, r.anchor) for r in E.from_reference(listed, F.lit("2024-01-01")).collect()}
    assert got == {(1, "website_url", "external_db:openvc", "medium", None), (1, "team_member", "external_db:openvc", "weak", None), (2, "linkedin_company_url", "external_db:unknown", "medium", None)}
