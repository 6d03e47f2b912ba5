"""Registered queries of versions of tables, imported files and stored sketches, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import sketches as K
from fathom.plans.catalog import query
from fathom.plans.matching import form_sql
from fathom.sources import files, imports, snapshots, work
from fathom.sources.views import table

_COLUMNS = "id, discrepancy_type, severity, status"


def _steps(**steps):
    """Tables one after the other, with the name of their step."""
    out = None
    for name, df in steps.items():
        part = df.withColumn("step", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("sk01_full_refresh", f"""
SELECT 'old' AS step, {_COLUMNS} FROM findings WHERE status = 'active'
UNION ALL SELECT 'new', id, discrepancy_type, severity, 'checked' FROM findings WHERE id % 2 = 0
UNION ALL SELECT 'after_failure', id, discrepancy_type, severity, 'checked' FROM findings WHERE id % 2 = 0
UNION ALL SELECT 'restored', {_COLUMNS} FROM findings WHERE status = 'active'""", "findings")
def sk01(spark, d):
    """A table is replaced, a broken write changes nothing, the first version is made the newest again."""
    root, rows = work.folder(spark, "findings"), table(spark, d, "findings").select(*_COLUMNS.split(", "))
    snapshots.publish(rows.filter("status = 'active'"), root, "first")
    first = snapshots.read(spark, root)
    snapshots.publish(rows.filter("id % 2 = 0").withColumn("status", F.lit("checked")), root, "second")
    second = snapshots.read(spark, root)
    broken = rows.withColumn("status", F.when(F.col("id") < 0, F.col("status")).otherwise(F.raise_error(F.lit("broken on purpose"))))
    try:
        snapshots.publish(broken, root, "third")
    except Exception as error:
        if "broken on purpose" not in str(error):
            raise
    third = snapshots.read(spark, root, verify=True)
    snapshots.restore(spark, root, 1)
    return _steps(old=first, new=second, after_failure=third, restored=snapshots.read(spark, root))


@query("sk02_parts_replaced", f"""
SELECT {_COLUMNS} FROM findings WHERE discrepancy_type <> 'fund_type_mismatch'
UNION ALL SELECT id, discrepancy_type, 'low', status FROM findings WHERE discrepancy_type = 'fund_type_mismatch' AND id % 2 = 0""", "findings")
def sk02(spark, d):
    """Of one type of issues fewer are found anew; the others stay."""
    root, rows = work.folder(spark, "findings"), table(spark, d, "findings").select(*_COLUMNS.split(", "))
    snapshots.publish(rows, root, parts="discrepancy_type")
    again = rows.filter("discrepancy_type = 'fund_type_mismatch' AND id % 2 = 0").withColumn("severity", F.lit("low"))
    snapshots.publish(again, root, parts="discrepancy_type")
    return snapshots.read(spark, root, verify=True)


@query("sk15_backup", "SELECT '2024-06-30' AS taken_at, 'below_bar' AS reason, count(*) AS count, 'id,series_master_llc,website_url' AS columns FROM records WHERE confidence_score < 0.7", "records")
def sk15(spark, d):
    rows = table(spark, d, "records").filter("confidence_score < 0.7").select("id", "series_master_llc", "website_url")
    return snapshots.backup(rows, work.folder(spark, "backup"), "below_bar", "2024-06-30")


def openvc_files(spark, d):
    """A list as its publisher writes it: quotes, commas and line breaks in fields; each ninth line lacks fields or has too many, some have no name."""
    rows = table(spark, d, "investors_a").withColumn("k", F.pmod(F.xxhash64("investor_name"), F.lit(9)))
    said = F.concat(F.lit('Says "hi",\n'), "investor_name")
    good = rows.select(
        F.when(F.col("check_min") == "100k", F.lit("LLC")).otherwise(F.col("investor_name")).alias("Investor Name"), F.regexp_replace("website_url", "^https://", "").alias("Website"), F.lit(" Town ").alias("HQ"), F.col("sectors").alias("Countries"), F.col("founded").alias("Stage"),
        said.alias("Thesis"), F.lit("VC").alias("Type"), F.col("check_min").alias("Min"), F.lit("$1,500,000").alias("Max"),
    )
    place = work.folder(spark, "openvc")
    files.write_csv(good, f"{place}/good")
    files.write_csv(rows.filter("founded = 'soon'").select("investor_name", F.lit("x").alias("website")), f"{place}/short")
    files.write_csv(rows.filter("founded IS NULL").select("investor_name", *(F.lit(str(i)).alias(f"c{i}") for i in range(10))), f"{place}/long")
    files.write_csv(good.limit(0).union(good.filter(F.col("Min") == "$50,000").withColumn("Investor Name", F.lit(" "))), f"{place}/nameless")
    return [f"{place}/{x}" for x in ("good", "nameless", "short", "long")]


_INVESTOR = form_sql("investor_name", "investor")
_DOLLARS = r"try_cast(nullif(regexp_extract(regexp_replace({}, '[$,\s]', '', 'g'), '^([+-]?\d+)', 1), '') AS BIGINT)"
_PARTS = "nullif(array_to_string(list_filter(list_transform(string_split({}, ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '')"


@query("sc13_list_records", f"""
SELECT investor_name, {_INVESTOR} AS normalized_name, website_url, 'Town' AS hq_location, {_PARTS.format('sectors')} AS countries, founded AS investment_stage,
       'Says "hi",' || chr(10) || investor_name AS investment_thesis, {_DOLLARS.format('check_min')} AS check_size_min_usd, 1500000::BIGINT AS check_size_max_usd
FROM investors_a WHERE check_min IS DISTINCT FROM '100k'""", "investors_a")
def sc13(spark, d):
    good, _ = imports.import_list(spark, openvc_files(spark, d)[:1], "openvc")
    return good.select("investor_name", "normalized_name", "website_url", "hq_location", F.array_join("countries_of_investment", "|").alias("countries"), "investment_stage", "investment_thesis", "check_size_min_usd", "check_size_max_usd")


@query("sc13_list_rejects", """
SELECT 'malformed' AS reason, count(*) AS n FROM investors_a WHERE founded = 'soon' OR founded IS NULL
UNION ALL SELECT 'no_name', count(*) FROM investors_a WHERE check_min = '$50,000'
UNION ALL SELECT 'no_form', count(*) FROM investors_a WHERE check_min = '100k'""", "investors_a")
def sc13_rejects(spark, d):
    """Lines that are no records, by reason; with the records they are all lines."""
    _, bad = imports.import_list(spark, openvc_files(spark, d), "openvc")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("sc14_second_list", f"""
SELECT investor_name, {_INVESTOR} AS normalized_name, website_url, 'Fund' AS investor_type, 'a|b' AS sectors, lower(primary_contact_email) AS primary_contact_email,
       'https://twitter.com/x' AS twitter_url, CASE WHEN primary_contact_email IS NOT NULL THEN 12 END AS portfolio_count, 1998 AS founded_year
FROM investors_b WHERE {_INVESTOR} <> ''""", "investors_b")
def sc14(spark, d):
    """A list without a header, of eighteen fields by place."""
    empty, text = F.lit("").alias, F.lit
    count = F.when(F.col("primary_contact_email").isNotNull(), "12 firms").otherwise("0")
    rows = table(spark, d, "investors_b").select(
        "investor_name", text("Fund").alias("b"), F.regexp_replace("website_url", "^https://", " ").alias("c"), text("a, ,b").alias("d"), empty("e"), empty("f"), F.upper("primary_contact_email").alias("g"), text("P, Q").alias("h"), empty("i"),
        text("twitter.com/x").alias("j"), empty("k"), empty("l"), count.alias("m"), empty("n"), text('so "they"\nsay').alias("o"), text("since 1998, or 2001").alias("p"), empty("q"), empty("r"),
    )
    place = work.folder(spark, "ramp")
    rows.write.csv(place, quote='"', escape='"')
    good, _ = imports.import_list(spark, place, "ramp")
    return good.select("investor_name", "normalized_name", "website_url", "investor_type", F.array_join("investment_sectors", "|").alias("sectors"), "primary_contact_email", "twitter_url", "portfolio_count", "founded_year")


@query("sc11_platform_file", """
SELECT manager_key, display_name, num_platforms, platforms_used, sample_entities, ia_firm_name, team_members, num_filings FROM platform_managers WHERE display_name <> ''""", "platform_managers")
def sc11(spark, d):
    """A file whose header names its fields in another order, with a field more; rows without a name go."""
    names = [c for c in reversed(imports.PLATFORM_MANAGERS)]
    rows = table(spark, d, "platform_managers").select(*(F.col(c).alias(c.upper()) for c in names[:4]), F.lit("?").alias("note"), *names[4:])
    place = work.folder(spark, "platforms")
    files.write_csv(rows, place)
    good, _ = imports.import_list(spark, place, "platforms")
    return good


_SHARES = (0.5, 0.9)


@query("ag09_estimated_counts", """
WITH m AS (
  SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users, quantile_disc(value, 0.48) AS low, quantile_disc(value, 0.52) AS high, quantile_disc(value, 0.88) AS low9, quantile_disc(value, 0.92) AS high9
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1)
SELECT kind, n, users, true AS users_near, true AS median_near, true AS top_near FROM m""")
def ag09(spark, d):
    """Estimates of all days from their stored sketches, beside exact counts: within 4 standard errors, and 2 % of the ranks."""
    events = table(spark, d, "events")
    stored = work.written(K.daily(events, "ts", "event_type", "user_id", "value"), "sketches")
    guess = K.estimated(K.rolled(stored, F.col("kind")), *_SHARES)
    exact = events.filter("ts IS NOT NULL AND value IS NOT NULL").groupBy(F.col("event_type").alias("kind")).agg(
        F.count_distinct("user_id").alias("users"), *(F.percentile("value", s + e).alias(f"p{i}{j}") for i, s in enumerate(_SHARES) for j, e in enumerate((-K.RANK_ERROR, K.RANK_ERROR)))
    )
    both = guess.join(exact, "kind")
    near = F.abs(F.col("different") - F.col("users")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 2 ** (K.PRECISION / 2) * F.col("users"))
    inside = lambda q, i: (F.col(q) >= F.floor(F.col(f"p{i}0") * 100) / 100) & (F.col(q) <= F.ceil(F.col(f"p{i}1") * 100) / 100)
    return both.select("kind", "n", "users", near.alias("users_near"), inside("q50", 0).alias("median_near"), inside("q90", 1).alias("top_near"))
