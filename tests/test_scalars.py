"""Functions on pages of results, portfolios and titles, and files in and out, on small fixtures."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import scalars as V
from fathom.functions import web
from fathom.operators import listings as L
from fathom.sources import files


def test_result_links(spark):
    html = '<a rel="n" class="result__a" href="//r?uddg=https%3A%2F%2Fa.com%2Fx&amp;r=1">A &amp; <b>B</b></a> <a class="result__snippet" href="#">first <b>said</b></a><a class="result__a" href="https://b.org">B</a>'
    got = spark.createDataFrame([(html,)], "h string").select(V.result_links(F.col("h")).alias("r")).first().r
    assert [(x.url, x.title, x.description) for x in got] == [("https://a.com/x", "A & B", "first said"), ("https://b.org", "B", "")]


def test_portfolio_names(spark):
    html = '<a href="https://acme.com">Acme</a><a href="https://x.io">Our Portfolio</a><script>{"name": "Beta Co"}</script><div class="company-card"><p>x</p><h3>Gamma</h3></div><a href="https://y.com">12</a>'
    assert spark.createDataFrame([(html,)], "h string").select(V.portfolio_names(F.col("h")).alias("n")).first().n == ["Acme", "Beta Co", "Gamma"]


def test_site_choice(spark):
    rows = [("Alpine Capital LLC", [("https://linkedin.com/company/alpine", "Alpine"), ("https://www.alpine.com", "Home"), ("https://other.com", "x")]), ("Borealis LP", [("https://fund.example", "Borealis the firm"), ("https://zzz.com", "no")])]
    got = spark.createDataFrame(rows, "name string, r array<struct<url: string, title: string>>").select(V.site_choice(F.col("r"), F.col("name")).alias("c")).collect()
    assert [[(x.value, x.strength) for x in r.c] for r in got] == [[("https://www.alpine.com", "medium")], [("https://fund.example", "weak")]]


def test_one_row_or_an_error(spark):
    rows = spark.range(3)
    assert L.exactly_one(rows.filter("id = 1")).first().id == 1
    for bad in (rows, rows.limit(0)):
        try:
            L.exactly_one(bad)
        except LookupError:
            continue
        raise AssertionError("no error")


def test_files_round_trip(spark, tmp_path):
    schema = "id int, text string"
    rows = spark.createDataFrame([(1, 'a "quoted", b'), (2, "two\\nlines".replace("\\\\n", "\\n")), (3, None)], schema)
    files.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), schema).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "x.json").write_text('[{"id": 1, "text": "a"}, {"id": 2}]')
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "x.json"), schema).collect())) == [(1, "a"), (2, None)]
    files.replace_parts(spark.createDataFrame([(1, "a"), (2, "b")], schema), str(tmp_path / "parts"), "text")
    files.replace_parts(spark.createDataFrame([(9, "b")], schema), str(tmp_path / "parts"), "text")
    assert sorted((r.id, r.text) for r in spark.read.parquet(str(tmp_path / "parts")).collect()) == [(1, "a"), (9, "b")]
    known = T.StructType([T.StructField("text", T.StringType()), T.StructField("more", T.LongType())])
    assert files.aligned(rows, known).columns == ["text", "more"]
    assert files.markdown_rows(rows.filter("id = 1")).first().value == '| 1 | a "quoted", b |'
