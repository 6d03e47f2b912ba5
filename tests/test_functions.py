import datetime

import pytest
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import core


def one(spark, f, *values):
    kinds = {str: "string", int: "int", type(None): "string", datetime.date: "date"}
    row = spark.createDataFrame([values], ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values)))
    return row.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize("f, given, want", [
    (T.normalised_name, "Acme Partners, L.P.", "ACME PARTNERS"), (T.normalised_name, "Income LP LLC", "INCOME"), (T.normalised_name, None, None),
    (T.series_master, "Fund VI, a series of Acme Capital LLC", "Acme Capital LLC"), (T.series_master, "Acme", None),
    (T.slug, "A & B, Fund!", "a-b-fund"), (T.listed, " 021-1; ,021-2|", ["021-1", "021-2"]),
    (T.mixed_date, "31-OCT-2024", datetime.date(2024, 10, 31)), (T.mixed_date, "2024-10-31", datetime.date(2024, 10, 31)), (T.mixed_date, "5-Jun-2025", datetime.date(2025, 6, 5)), (T.mixed_date, "junk", None),
    (T.is_yes, "Y", True), (T.is_yes, "true", True), (T.is_yes, "N", False), (T.is_yes, None, False),
    (T.claims_3c1, "3C", True), (T.claims_3c1, "3C.7", False), (T.claims_3c7, "3(c)(7)", True), (T.claims_3c1, "06B", False), (T.claims_3c1, "3C.1, 3C.7", True),
    (T.hostname, "HTTPS://www.Example.com/x", "example.com"), (T.hostname, "nothing", ""), (T.amount, "$1,200.5", 1200.5), (T.amount, "12abc", 12.0), (T.amount, "x", None),
    (T.distinctive_tokens, "The Locus Ventures II, LP", ["locus"]),
])
def test_functions(spark, f, given, want):
    assert one(spark, f, given) == want


@pytest.mark.parametrize("a, b, want", [("HASH3 LLC", "Hash3 Capital Opportunity", True), ("TYPE ONE MANAGEMENT LLC", "Type One LP", True), ("TMS Capital Management Ltd", "TMS Angels Opportunity Fund, LP", False), ("LOCUS CAPITAL, INC.", "Locus Ventures II, LP", True), ("BASE CASE MANAGEMENT, LLC", "Base Case Capital Venture Funds", True)])
def test_gate(spark, a, b, want):
    assert one(spark, lambda x, y: T.gate(T.distinctive_tokens(x), T.distinctive_tokens(y)), a, b) is want


@pytest.mark.parametrize("n, days", [(0, 7), (1, 14), (2, 30), (3, 60), (4, 90), (5, None)])
def test_retry(spark, n, days):
    day = datetime.date(2024, 1, 1)
    assert one(spark, T.retry_date, day, n) == (day + datetime.timedelta(days) if days else None)


def test_cross_reference(spark):
    funds = spark.createDataFrame([(1, "A Fund LP", 7, "Hedge Fund", "021-9; 021-1"), (2, "Beta LLC", 8, "Private Equity Fund", ""), (3, "None", 8, "x", None)], "fund_id long, fund_name string, adviser_entity_crd long, fund_type string, form_d_file_number string")
    filings = spark.createDataFrame([(1, "a1", "021-1", "x", "Hedge Fund"), (2, "a2", "021-1", "x", "Venture Capital Fund"), (3, "a3", "021-3", "BETA, L.P.", "Venture Capital Fund")], "id long, accessionnumber string, file_num string, entityname string, investmentfundtype string")
    advisers = spark.createDataFrame([(7, "Seven")], "crd long, adviser_name string")
    years = spark.createDataFrame([(1, 2022, 5.0), (1, 2024, 0.0)], "fund_id long, year int, gav double")
    got = {r["fund_id"]: r for r in core.cross_reference(funds, filings, advisers, years, 2024).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["accessionnumber"], got[1]["method"], got[1]["issues"], got[1]["overdue_adv_flag"]) == ("a2", "file_number", "hedge fund mismatch", True)
    assert (got[2]["accessionnumber"], got[2]["method"], got[2]["issues"], got[2]["overdue_adv_flag"], got[2]["adviser_name"]) == ("a3", "name", "fund type PE vs VC", None, None)


def test_growth(spark):
    values = spark.createDataFrame([(1, 2025, 120.0), (1, 2024, 100.0), (1, 2023, 0.0), (1, 2020, 60.0)], "id long, year int, value double")
    assert core.growth(values, "id").first().asDict() == {"id": 1, "latest_year": 2025, "growth_1y": 20.0, "growth_2y": None, "growth_5y": 100.0}


def test_boolean_search(spark):
    rows = spark.createDataFrame([("alpha beta gamma",), ("beta alpha",), (None,)], "t string")
    assert [r.t for r in rows.filter(T.boolean_search(F.col("t"), 'alpha +"beta gamma" -delta')).collect()] == ["alpha beta gamma"]
