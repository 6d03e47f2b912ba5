"""Files of records with broken lines, and sketches against exact counts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import sketches
from fathom.sources import imports


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())
    return f"file://{tmp_path}/{name}"


def test_first_list(spark, tmp_path):
    text = '﻿Investor,Web,HQ,Countries,Stage,Thesis,Type,Min,Max\r\n'
    text += 'Alpine Ventures LLC, alpine.vc ,"Town, CA","US, ,DE",Seed,"Says ""no"",\r\nalways",VC,"$50,000",1m\r\n'
    text += ',,,,,,,,\r\n\r\n'  # no line at all
    text += ' ,x.com,,,,,,,\r\n'  # no name
    text += 'LLC,x.com,,,,,,,\r\n'  # nothing left of the name
    text += 'Short,x.com\r\nLong,1,2,3,4,5,6,7,8,9\r\n'
    text += 'Boreal,http://b.com,,,,,,-5,\r\n'
    good, bad = imports.import_list(spark, put(tmp_path, "a.csv", text), "openvc")
    rows = {r.investor_name: r for r in good.collect()}
    assert set(rows) == {"Alpine Ventures LLC", "Boreal"}
    r = rows["Alpine Ventures LLC"]
    assert (r.website_url, r.hq_location, r.countries_of_investment, r.investment_thesis, r.check_size_min_usd, r.check_size_max_usd, r.normalized_name) == ("https://alpine.vc", "Town, CA", ["US", "DE"], 'Says "no",\nalways', 50_000, 1, "alpine ventures")
    assert (rows["Boreal"].website_url, rows["Boreal"].check_size_min_usd, rows["Boreal"].countries_of_investment) == ("http://b.com", -5, None)
    assert sorted((r.reason, r.line.split(",")[0]) for r in bad.collect()) == [("malformed", "Long"), ("malformed", "Short"), ("no_form", "LLC"), ("no_name", "")]


def test_second_list(spark, tmp_path):
    line = ["Delta Fund", "Angel", "delta.com", "a,b", "", "Kim", " KIM@Delta.com ", "", "Town", "twitter.com/d", "", "", "7 firms", "", "text", "in 1998", "", ""]
    text = ",".join(f'"{x}"' for x in line) + "\n" + ",".join(["Echo"] + [""] * 11 + ["none"] + [""] * 5) + "\nBad,line\n"
    good, bad = imports.import_list(spark, put(tmp_path, "b.csv", text), "ramp")
    rows = {r.investor_name: r for r in good.collect()}
    assert (rows["Delta Fund"].primary_contact_email, rows["Delta Fund"].portfolio_count, rows["Delta Fund"].founded_year, rows["Delta Fund"].linkedin_url) == ("kim@delta.com", 7, 1998, None)
    assert rows["Echo"].portfolio_count is None and [r.reason for r in bad.collect()] == ["malformed"]


def test_header_names_fields(spark, tmp_path):
    text = "Display_Name,note,MANAGER_KEY\nAlpine,x,k1\n,y,k2\n"
    good, bad = imports.import_list(spark, put(tmp_path, "c.csv", text), "platforms")
    r = good.first()
    assert (r.manager_key, r.display_name, r.num_platforms) == ("k1", "Alpine", None) and bad.first().reason == "no_name"
    renamed = imports.fields(spark, put(tmp_path, "d.csv", "Firm,note\nAlpine,x\n"), ("display_name",), aliases={"display_name": ("Name", "firm")})
    assert renamed.first().display_name == "Alpine"
    with pytest.raises(ValueError, match="header"):
        imports.fields(spark, put(tmp_path, "e.csv", "a,b\n1,2\n"), ("display_name",), aliases={})


def test_all_lines_come_back(spark, tmp_path):
    rng = random.Random(2)
    lines = [",".join(rng.choice(["x", "", "LLC"]) for _ in range(rng.choice([1, 9, 9, 9, 12]))) for _ in range(200)]
    lines = [x for x in lines if x]
    good, bad = imports.import_list(spark, put(tmp_path, "f.csv", "h\n" + "\n".join(lines) + "\n"), "openvc")
    empty = sum(set(x) == {","} and x.count(",") == 8 for x in lines)
    assert good.count() + bad.count() + empty == len(lines)


def test_sketches_add_up(spark):
    rng = random.Random(6)
    rows = [(datetime.datetime(2024, 1, 1 + rng.randrange(20), 12), rng.choice("ab"), rng.randrange(30_000), rng.random() * 100) for _ in range(40_000)]
    events = spark.createDataFrame([*rows, (None, "a", 1, 1.0), (rows[0][0], "b", 2, None)], "ts timestamp, kind string, who long, value double")
    stored = sketches.daily(events, "ts", "kind", "who", "value")
    assert stored.count() == 40
    # by kind, by week and all: from the same stored days
    for by, key in ((F.col("kind"), lambda r: r[1]), (F.weekofyear("day"), lambda r: r[0].isocalendar().week), (F.lit(0), lambda r: 0)):
        for r in sketches.estimated(sketches.rolled(stored, by.alias("k")), 0.1, 0.5, 0.99).collect():
            mine = [x for x in rows if key(x) == r.k]
            values, whos = sorted(x[3] for x in mine), len({x[2] for x in mine})
            assert r.n == len(mine) and abs(r.different - whos) <= 4 * 1.04 / 2**7 * whos
            for share in (0.1, 0.5, 0.99):
                low, high = (values[min(len(values) - 1, max(0, int((share + e) * len(values))))] for e in (-sketches.RANK_ERROR, sketches.RANK_ERROR))
                assert low <= r[f"q{round(100 * share)}"] <= high
    assert sketches.rolled(stored.limit(0), F.col("kind")).count() == 0
