"""Registered queries of functions on single values, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import formats
from fathom.functions import names as N
from fathom.functions import scalars as V
from fathom.functions import text as T
from fathom.functions import web
from fathom.plans.catalog import query
from fathom.plans.issues import _person
from fathom.plans.lists import _DAY, _DAY0, _iso
from fathom.sources.views import table

NOW = "2001-04-20"


@query("dt03_dates_of_filings", f"""SELECT id, {_DAY0} AS or_epoch, {_iso('filing_date')} AS iso, CASE WHEN filing_date IS NULL THEN '-' ELSE coalesce(strftime({_DAY}, '%m/%d/%Y'), filing_date) END AS shown, CASE WHEN filing_date IS NULL THEN 'N/A' ELSE coalesce(strftime({_DAY}, '%b %-d, %Y'), filing_date) END AS written,
  abs(date_diff('day', {_DAY}, DATE '{NOW}')) AS days_between, {_DAY} >= DATE '{NOW}' - INTERVAL 6 MONTH AS within_half_year, month(DATE '{NOW}') >= 4 AS after_april, month(DATE '{NOW}') > 4 OR (month(DATE '{NOW}') = 4 AND day(DATE '{NOW}') >= 15) AS after_deadline FROM notices""", "notices")
def dt03(spark, d):
    day, now, raw = T.mixed_date(F.col("filing_date")), F.lit(NOW).cast("date"), F.col("filing_date")
    return table(spark, d, "notices").select(
        "id", T.filing_date(raw).alias("or_epoch"), T.iso_date(raw).alias("iso"), T.shown_date(raw).alias("shown"), T.written_date(raw).alias("written"), F.abs(F.date_diff(now, day)).cast("long").alias("days_between"),
        (day >= F.add_months(now, -6)).alias("within_half_year"), (F.month(now) >= 4).alias("after_april"), ((F.month(now) > 4) | ((F.month(now) == 4) & (F.dayofmonth(now) >= 15))).alias("after_deadline"),
    )


@query("dt10_ages_of_timestamps", "SELECT id, date_diff('day', try_cast(next_retry_at AS TIMESTAMPTZ)::TIMESTAMP::DATE, DATE '2024-12-31') AS age FROM records", "records")
def dt10(spark, d):
    return table(spark, d, "records").select("id", F.date_diff(F.lit("2024-12-31").cast("date"), F.to_date(F.try_to_timestamp("next_retry_at"))).cast("long").alias("age"))


@query("dt12_years_and_dollars", r"SELECT investor_name, try_cast(nullif(regexp_extract(founded, '\b(19\d{2}|20\d{2})\b', 1), '') AS INT) AS founded, try_cast(nullif(regexp_extract(regexp_replace(check_min, '[$,\s]', '', 'g'), '^([+-]?\d+)', 1), '') AS BIGINT) AS check_min, array_to_string(list_filter(list_transform(string_split_regex(sectors, '[,;|]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS sectors FROM investors_a", "investors_a")
def dt12(spark, d):
    return table(spark, d, "investors_a").select("investor_name", T.year_in(F.col("founded")).alias("founded"), T.dollars(F.col("check_min")).alias("check_min"), F.array_join(T.listed(F.col("sectors")), "/").alias("sectors"))


_TENTHS = "((coalesce(website_url <> '', false) AND NOT coalesce(regexp_matches(website_url, 'crunchbase|linkedin'), false))::INT * 4 + coalesce(linkedin_company_url <> '', false)::INT * 2 + coalesce(fund_type <> '' AND fund_type <> 'Unknown', false)::INT * 2 + coalesce(investment_stage <> '', false)::INT + coalesce(retry_count >= 2, false)::INT) / 10.0::DOUBLE"


@query("ma06_first_confidence", f"SELECT id, confidence, CASE WHEN confidence >= 0.7 THEN 'auto_enriched' WHEN confidence >= 0.5 THEN 'needs_manual_review' ELSE 'no_data_found' END AS status, coalesce(confidence >= 0.7 AND fund_type <> '' AND fund_type NOT IN ('Unknown', 'Operating Company') AND website_url <> '' AND NOT contains(website_url, 'crunchbase'), false) AS publish FROM (SELECT *, {_TENTHS} AS confidence FROM records)", "records")
def ma06(spark, d):
    c = F.col
    rows = table(spark, d, "records").withColumn("confidence", V.first_confidence(c("website_url"), c("linkedin_company_url"), c("fund_type"), c("investment_stage"), c("retry_count")))
    return rows.select("id", "confidence", V.first_status(c("confidence")).alias("status"), V.publishable(c("confidence"), c("fund_type"), c("website_url")).alias("publish"))


@query("ma10_effective_assets", "SELECT crd, coalesce(nullif(total_aum, 0), nullif(aum_2025, 0), nullif(aum_2024, 0), nullif(aum_2023, 0)) AS aum FROM registry", "registry")
def ma10(spark, d):
    return table(spark, d, "registry").select("crd", V.effective(*(F.col(c) for c in ("total_aum", "aum_2025", "aum_2024", "aum_2023"))).alias("aum"))


_MONEY = r"try_cast(nullif(regexp_extract(regexp_replace({}, '[$,]', '', 'g'), '^\s*([+-]?\d*\.?\d+)', 1), '') AS DOUBLE)"


@query("ma11_assets_by_year", f""", g AS (SELECT adviser_entity_crd AS crd, sum({_MONEY.format('gav_2023')}::DECIMAL(20,2))::DOUBLE AS g23, sum({_MONEY.format('gav_2024')}::DECIMAL(20,2))::DOUBLE AS g24 FROM vehicles GROUP BY 1)
SELECT r.crd, coalesce(nullif(aum_2023, 0), nullif(g23, 0)) AS aum_2023, coalesce(nullif(aum_2024, 0), nullif(g24, 0)) AS aum_2024, coalesce(nullif(total_aum, 0), nullif(aum_2024, 0), nullif(g24, 0), nullif(aum_2023, 0), nullif(g23, 0)) AS total FROM registry r LEFT JOIN g ON g.crd = r.crd""", "registry", "vehicles")
def ma11(spark, d):
    sums = table(spark, d, "vehicles").groupBy(F.col("adviser_entity_crd").alias("crd")).agg(*(F.sum(T.amount(F.col(f"gav_{y}")).cast("decimal(20,2)")).cast("double").alias(f"g{y}") for y in (2023, 2024)))
    rows = table(spark, d, "registry").join(sums, "crd", "left")
    year = {y: V.effective(F.col(f"aum_{y}"), F.col(f"g{y}")) for y in (2023, 2024)}
    return rows.select("crd", year[2023].alias("aum_2023"), year[2024].alias("aum_2024"), F.coalesce(V.effective(F.col("total_aum")), year[2024], year[2023]).alias("total"))


def _rules(c: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{k}'" for p, k in rules) + f" ELSE {otherwise} END"


_STAGED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{s}' END" for p, s in V.STAGES) + "], lambda x: x IS NOT NULL)"


@query("sf27_types_of_texts", f"""SELECT doc_id, {_rules('text', V.FILED, "'Unknown'")} AS filed, CASE WHEN coalesce(text, '') = '' THEN 'Unknown' WHEN {_rules('text', V.LISTED, "''")} <> '' THEN {_rules('text', V.LISTED, "''")} ELSE 'other' END AS listed, {_rules('text', V.BASIC, "'Unknown'")} AS basic,
  CASE WHEN regexp_matches(lower(text), '{V.OPERATING}') AND NOT regexp_matches(lower(text), '{V.INVESTING}') THEN 'Operating Company' ELSE {_rules('text', V.FIRST, "'Unknown'")} END AS first, CASE WHEN len({_STAGED}) = 1 THEN {_STAGED}[1] WHEN len({_STAGED}) > 1 THEN {_STAGED}[1] || ' to ' || {_STAGED}[-1] END AS stage FROM documents""")
def sf27(spark, d):
    text = F.col("text")
    listed = V.listed_type(text)
    return table(spark, d, "documents").select("doc_id", V.filed_type(text).alias("filed"), F.when(listed == text, "other").otherwise(listed).alias("listed"), V.basic_type(text).alias("basic"), V.first_type(text).alias("first"), V.stage(text).alias("stage"))


@query("sf22_compact_numbers", "SELECT crd, CASE WHEN total_aum IS NULL THEN 'N/A' WHEN total_aum >= 1e9 THEN printf('%.1fB', total_aum / 1e9) WHEN total_aum >= 1e6 THEN printf('%.1fM', total_aum / 1e6) WHEN total_aum >= 1e3 THEN printf('%.1fK', total_aum / 1e3) ELSE printf('%.0f', total_aum) END AS shown FROM (SELECT crd, round(total_aum) + 0.25 AS total_aum FROM registry)", "registry")
def sf22(spark, d):
    return table(spark, d, "registry").select("crd", V.compact(F.round("total_aum") + 0.25).alias("shown"))


@query("sf23_signed_growth", "SELECT crd, CASE WHEN aum_2023 IS NOT NULL AND aum_2025 IS NOT NULL THEN printf('%+.1f%%', ((aum_2025 - aum_2023) / aum_2023 * 100)) END AS growth, regexp_extract(crd || '-' || coalesce(adviser_name, ''), '^(\\d+)-', 1) AS id FROM registry WHERE aum_2023 <> 0 OR aum_2023 IS NULL", "registry")
def sf23(spark, d):
    rows = table(spark, d, "registry").filter("aum_2023 <> 0 OR aum_2023 IS NULL")
    return rows.select("crd", formats.signed_percent(F.try_divide(F.col("aum_2025") - F.col("aum_2023"), F.col("aum_2023")) * 100).alias("growth"), N.slug_id(F.concat(F.col("crd").cast("string"), F.lit("-"), F.coalesce("adviser_name", F.lit("")))).alias("id"))


@query("tk06_persons", f"SELECT id, coalesce(w[1], '') AS first, coalesce(w[-1], '') AS last FROM (SELECT id, {_person('owner_full_name')} AS w FROM owners)", "owners")
def tk06(spark, d):
    return table(spark, d, "owners").select("id", formats.person(F.col("owner_full_name")).alias("p")).select("id", "p.first", "p.last")


@query("tk07_same_persons", f"SELECT a.id, b.id AS other FROM (SELECT id, {_person('owner_full_name')} AS w FROM owners) a JOIN (SELECT id, {_person('upper(owner_full_name)')} AS w FROM owners) b ON b.id = a.id + 1 OR b.id = a.id WHERE a.w[1] <> '' AND a.w[1] = b.w[1] AND a.w[-1] = b.w[-1]", "owners")
def tk07(spark, d):
    rows = table(spark, d, "owners").select("id", "owner_full_name")
    other = rows.select(F.explode(F.array(F.col("id"), F.col("id") - 1)).alias("id"), F.col("id").alias("other"), F.upper("owner_full_name").alias("b"))
    return rows.join(other, "id").filter(formats.same_person(F.col("owner_full_name"), F.col("b"))).select("id", "other")


@query("ur03_sites", """SELECT id, CASE WHEN nullif(trim(url), '') IS NULL THEN NULL WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS clean, CASE WHEN nullif(regexp_extract(url, '(?:twitter\\.com|x\\.com)/([a-zA-Z0-9_]+)(?:/|$|\\?)', 1), '') IS NOT NULL AND lower(regexp_extract(url, '(?:twitter\\.com|x\\.com)/([a-zA-Z0-9_]+)(?:/|$|\\?)', 1)) NOT IN ('search', 'hashtag', 'i', 'intent', 'share', 'home') THEN '@' || regexp_extract(url, '(?:twitter\\.com|x\\.com)/([a-zA-Z0-9_]+)(?:/|$|\\?)', 1) END AS handle,
  CASE WHEN length(s) >= 4 AND NOT regexp_full_match(s, '[0-9-]+') THEN 'https://www.' || s || '.com https://' || s || '.com' ELSE '' END AS candidates FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '(?i)linkedin\\.com/company/([^/?#]+)', 1)), '[^a-z0-9-]', '', 'g') AS s FROM sites)""", "sites")
def ur03(spark, d):
    url = F.col("url")
    return table(spark, d, "sites").select("id", formats.with_scheme(url).alias("clean"), V.handle(url).alias("handle"), F.array_join(V.slug_sites(url), " ").alias("candidates"))


@query("js03_objects_in_texts", "SELECT id, CASE WHEN json_valid(regexp_extract(t, '(?s)(\\{.*\\})', 1)) THEN regexp_extract(t, '(?s)(\\{.*\\})', 1) END AS found FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'none' WHEN id % 5 = 1 THEN '{broken' || '}' ELSE 'So: ' || metadata || ' done.' END AS t FROM findings)", "findings")
def js03(spark, d):
    text = F.when(F.col("id") % 5 == 0, "none").when(F.col("id") % 5 == 1, "{broken}").otherwise(F.concat(F.lit("So: "), F.col("metadata"), F.lit(" done.")))
    return table(spark, d, "findings").select("id", V.first_object(text).alias("found"))


@query("js04_evidence", "SELECT id, to_json(struct_pack(field := 'website_url', value := website_url, status := CASE WHEN is_published THEN 'verified' ELSE 'candidate' END))::VARCHAR AS evidence FROM records", "records")
def js04(spark, d):
    bag = F.struct(F.lit("website_url").alias("field"), F.col("website_url").alias("value"), F.when(F.col("is_published"), "verified").otherwise("candidate").alias("status"))
    return table(spark, d, "records").select("id", F.to_json(bag, {"ignoreNullFields": "false"}).alias("evidence"))


@query("ht06_titled_persons", """
SELECT id, trim(p[1]) AS name, trim(p[2]) AS title, trim(p[3]) AS company
FROM (SELECT id, string_split(coalesce(owner_full_name, '') || CASE WHEN id % 5 <> 0 THEN ' - ' || coalesce(title_or_status, 'Partner') || CASE WHEN id % 4 <> 0 THEN ' - Firm ' || firm_crd ELSE '' END ELSE '' END, ' - ') AS p FROM owners)""", "owners")
def ht06(spark, d):
    """Titles of search results of three, two or one parts."""
    company = F.when(F.col("id") % 4 != 0, F.concat(F.lit(" - Firm "), F.col("firm_crd").cast("string"))).otherwise("")
    rest = F.when(F.col("id") % 5 != 0, F.concat(F.lit(" - "), F.coalesce("title_or_status", F.lit("Partner")), company)).otherwise("")
    return table(spark, d, "owners").select("id", web.titled_person(F.concat(F.coalesce("owner_full_name", F.lit("")), rest)).alias("p")).select("id", "p.*")
