"""Detectors whose results are issues as they are stored: discrepancy_type, severity, adviser_crd, form_d_cik, description and metadata (JSON text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import formats
from fathom.functions import text as T
from fathom.operators import matching as M
from fathom.operators import registry as R
from fathom.operators.core import newest_per
from fathom.sources import work

COLUMNS = ("discrepancy_type", "severity", "adviser_crd", "form_d_cik", "description", "metadata")
#: Types of funds that break the venture exemption; and how older detectors find them.
NOT_VENTURE = "hedge fund|private equity fund|real estate fund|liquidity fund|securitized asset fund|other private fund"
NOT_VENTURE_OLD = "private equity|hedge|real estate|credit|buyout"
#: Lists inside an issue have so many items.
SHOWN = 5
#: What issues say, as users read and search it; {} are values.
TEXTS = {
    "needs_initial_adv_filing": 'Manager "{}" has {} Form D filing(s) since {} but has not filed Form ADV ({} days since first filing, verified against ADV database)',
    "graded_registration": 'Manager "{}" has {} Form D filing(s) since {} but has not filed Form ADV ({} days since first filing)',
    "overdue_annual_amendment": 'Manager "{}" has not filed current year ADV amendment (last filing: {})',
    "filings_since": ". {} Form D filings since then.",
    "vc_exemption_violation": 'Manager "{}" claims VC exemption (203(l)-1) but manages {} non-VC fund(s): {}',
    "fund_type_mismatch": 'Fund type mismatch for "{}": ADV reports "{}", Form D reports "{}"',
    "missing_by_number": 'Fund "{}" (Form D filed {}) has file number {} listed in ADV fund "{}" but Form D not matched to ADV fund record',
    "missing_by_name": 'Fund "{}" filed Form D on {} but not in latest Form ADV ({}) for "{}"',
    "exemption_mismatch": 'Exemption mismatch for "{}": ADV reports 3(c)(1)={}, 3(c)(7)={}; Form D reports 3(c)(1)={}, 3(c)(7)={}',
}


def said(form: str, *values: Column) -> Column:
    """form with a value in place of each {}; a null is the word null."""
    parts = form.split("{}")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:]):
        out += [F.coalesce(value.cast("string"), F.lit("null")), F.lit(rest)]
    return F.concat(*out)


def issues(rows: DataFrame, kind: str, severity: Column | str, crd: Column, cik: Column, description: Column, **metadata: Column) -> DataFrame:
    """rows as issues; metadata keeps nulls."""
    bag = F.to_json(F.struct(*(c.alias(k) for k, c in metadata.items())), {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("discrepancy_type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), crd.cast("long").alias("adviser_crd"), cik.cast("string").alias("form_d_cik"), description.alias("description"), bag.alias("metadata"))


def shown(rows: DataFrame, key: str, value: str, *order: Column | str, to: str) -> DataFrame:
    """key and the first SHOWN values of its rows in an order that is total; no more rows of a key ever come together."""
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= SHOWN)
    return few.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"]).alias(to))


def overdue(matches: DataFrame, filings: DataFrame, due_year: int) -> DataFrame:
    """Advisers whose latest year with values is before due_year, with their filings of later years."""
    known = matches.filter("adviser_entity_crd IS NOT NULL").groupBy(F.col("adviser_entity_crd").alias("crd")).agg(F.min("adviser_name").alias("name"), F.max("latest_adv_year").alias("latest")).filter(F.col("latest") < due_year)
    filed = matches.select(F.col("adviser_entity_crd").alias("crd"), "accessionnumber").distinct().join(filings.select("accessionnumber", F.col("cik").cast("string").alias("cik"), F.year(T.mixed_date(F.col("filing_date"))).alias("year")), "accessionnumber")
    after = known.join(filed, "crd").filter(F.col("year") > F.col("latest"))
    later = after.groupBy("crd").agg(F.count("*").alias("n"), F.min_by("cik", "accessionnumber").alias("cik")).join(shown(after, "crd", "accessionnumber", "accessionnumber", to="all"), "crd", "left")
    rows = known.join(later, "crd", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c = F.col
    more = F.when(c("n") > 0, said(TEXTS["filings_since"], c("n"))).otherwise("")
    return issues(rows, "overdue_annual_amendment", "high", c("crd"), c("cik"), F.concat(said(TEXTS["overdue_annual_amendment"], c("name"), c("latest")), more), adviser_name=c("name"), latest_adv_year=c("latest"), form_d_count_after_adv=c("n"), form_d_filings_after_adv=F.coalesce("all", F.array().cast("array<string>")))


def not_venture(kind: Column) -> Column:
    """A type that names a fund of another kind, or is none of the names of venture funds; no type is no verdict."""
    low = F.lower(F.trim(kind))
    return F.coalesce((low != "") & (low.rlike(NOT_VENTURE) | ~(low.contains("venture capital") | (low == "vc"))), F.lit(False))


def first_ciks(matches: DataFrame, filings: DataFrame) -> DataFrame:
    """crd, ciks (distinct, those of the smallest accession numbers first) of the filings that an adviser's matches name."""
    rows = matches.select(F.col("adviser_entity_crd").alias("crd"), "accessionnumber").filter("crd IS NOT NULL").join(filings.select("accessionnumber", F.col("cik").cast("string").alias("cik")), "accessionnumber").filter("cik <> ''")
    by_cik = rows.groupBy("crd", "cik").agg(F.min("accessionnumber").alias("first"))
    return by_cik.groupBy("crd").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "cik"))), lambda x: x["cik"]).alias("ciks"))


def venture_violations(advisers: DataFrame, funds: DataFrame, filings: DataFrame, matches: DataFrame) -> DataFrame:
    """Advisers that claim the venture exemption and have funds of other kinds: which, and a cik by the first such fund's first file number, else by matches."""
    claims = advisers.filter(T.is_yes(F.col("exemption_2b1"))).select("crd", "adviser_name").dropDuplicates(["crd"])
    theirs = funds.select(F.col("adviser_entity_crd").alias("crd"), "fund_id", "fund_name", F.trim("fund_type").alias("kind"), F.get(T.listed(F.col("form_d_file_number")), F.lit(0)).alias("file_num"), not_venture(F.col("fund_type")).alias("bad")).join(claims, "crd", "left_semi")
    sizes = theirs.groupBy("crd").agg(F.count("*").alias("total"))
    bad = theirs.filter("bad")
    kinds = bad.groupBy("crd", "kind").agg(F.count("*").alias("n")).groupBy("crd").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(said("{} {}", F.col("n"), F.col("kind")))), ", ").alias("breakdown"))
    first = bad.groupBy("crd").agg(F.min_by(F.struct("fund_name", "kind", "file_num"), "fund_id").alias("p")).join(shown(bad, "crd", "fund_name", "fund_id", to="sample"), "crd")
    numbers = filings.filter("file_num IS NOT NULL").groupBy("file_num").agg(F.max_by(F.col("cik").cast("string"), "id").alias("cik"))
    named = matches.select(F.col("adviser_entity_crd").alias("crd"), "accessionnumber").join(filings.select("accessionnumber", F.col("cik").cast("string").alias("other")), "accessionnumber").filter("other <> ''")
    named = named.groupBy("crd").agg(F.min_by("other", "accessionnumber").alias("other"))
    rows = claims.join(kinds, "crd").join(sizes, "crd").join(first, "crd").select("*", F.col("p.file_num").alias("file_num")).join(numbers, "file_num", "left").join(named, "crd", "left")
    c = F.col
    return issues(rows, "vc_exemption_violation", "critical", c("crd"), F.coalesce(F.nullif("cik", F.lit("")), "other"), said(TEXTS["vc_exemption_violation"], c("adviser_name"), c("n"), c("breakdown")),
                  exemption_claimed=F.lit("vc_203l1"), non_vc_fund_count=c("n"), total_funds=c("total"), primary_fund_name=c("p.fund_name"), primary_fund_type=c("p.kind"), primary_fund_form_d_file_num=c("file_num"), primary_formd_cik=F.nullif("cik", F.lit("")), sample_non_vc_funds=c("sample"))


def type_mismatches(matches: DataFrame, funds: DataFrame, filings: DataFrame, equal_is_same: bool = False) -> DataFrame:
    """Matches whose two types have no family in common; sides without a type are skipped.  Types of no family differ from everything unless equal_is_same."""
    rows = matches.filter("fund_type <> '' AND investmentfundtype <> ''").filter(~formats.same_kind(F.col("fund_type"), F.col("investmentfundtype"), equal_is_same))
    rows = rows.join(funds.select("fund_id", "fund_name"), "fund_id").join(filings.select("accessionnumber", "entityname", F.col("cik").cast("string").alias("cik"), "filing_date"), "accessionnumber")
    c = F.col
    return issues(rows, "fund_type_mismatch", "medium", c("adviser_entity_crd"), c("cik"), said(TEXTS["fund_type_mismatch"], c("fund_name"), c("fund_type"), c("investmentfundtype")),
                  adv_fund_name=c("fund_name"), formd_entity_name=c("entityname"), adv_fund_type=c("fund_type"), formd_fund_type=c("investmentfundtype"), formd_accession=c("accessionnumber"), formd_filing_date=c("filing_date"), adviser_name=c("adviser_name"))


def missing_funds(by_number: DataFrame, by_name: DataFrame, filings: DataFrame, funds: DataFrame, advisers: DataFrame, matches: DataFrame) -> DataFrame:
    """Two detectors' filings (accessionnumber, crd) as one: each filing once, by its number rather than by name.

    One found by its number names the adviser's first fund that lists it, one found by name the adviser and its latest year.
    """
    both = by_number.select("accessionnumber", "crd", F.lit("form_d_file_number").alias("way"), F.lit(0).alias("o")).unionByName(by_name.select("accessionnumber", "crd", F.lit("name_matching").alias("way"), F.lit(1).alias("o")))
    once = both.groupBy("accessionnumber").agg(F.min_by(F.struct("crd", "way"), F.struct("o", "crd")).alias("b")).select("accessionnumber", "b.*")
    rows = once.join(filings.select("accessionnumber", "entityname", F.col("cik").cast("string").alias("cik"), "filing_date", "file_num"), "accessionnumber")
    listed = funds.select(F.col("adviser_entity_crd").alias("crd"), "fund_id", "fund_name", F.explode(T.listed(F.col("form_d_file_number"))).alias("file_num"))
    listed = listed.groupBy("crd", "file_num").agg(F.min_by("fund_name", "fund_id").alias("adv_fund"))
    latest = matches.groupBy(F.col("adviser_entity_crd").alias("crd")).agg(F.max("latest_adv_year").alias("latest"))
    rows = rows.join(listed, ["crd", "file_num"], "left").join(advisers.groupBy("crd").agg(F.min("adviser_name").alias("adviser")), "crd", "left").join(latest, "crd", "left")
    c = F.col
    text = F.when(c("way") == "form_d_file_number", said(TEXTS["missing_by_number"], c("entityname"), c("filing_date"), c("file_num"), c("adv_fund")))
    text = text.otherwise(said(TEXTS["missing_by_name"], c("entityname"), c("filing_date"), c("latest"), c("adviser")))
    return issues(rows, "missing_fund_in_adv", "medium", c("crd"), c("cik"), text, detection_strategy=c("way"), fund_name=c("entityname"), form_d_file_number=c("file_num"), formd_accession=c("accessionnumber"))


def exemption_mismatches(matches: DataFrame, funds: DataFrame, filings: DataFrame) -> DataFrame:
    """Matches whose two sides differ in either exclusion; a side that names none says no to both."""
    rows = matches.select("fund_id", "accessionnumber", "adviser_entity_crd", "adviser_name").join(funds.select("fund_id", "fund_name", "exclusion_3c1", "exclusion_3c7"), "fund_id").join(filings.select("accessionnumber", "entityname", "exemptions"), "accessionnumber")
    yes = lambda x: F.coalesce(F.col(x).isin("Y", "true"), F.lit(False))
    rows = rows.select("*", yes("exclusion_3c1").alias("a1"), yes("exclusion_3c7").alias("a7"), T.claims_3c1(F.col("exemptions")).alias("f1"), T.claims_3c7(F.col("exemptions")).alias("f7")).filter("a1 <> f1 OR a7 <> f7")
    c = F.col
    word = lambda x: F.when(c(x), "Y").otherwise("N")
    return issues(rows, "exemption_mismatch", "high", c("adviser_entity_crd"), F.lit(None), said(TEXTS["exemption_mismatch"], c("fund_name"), word("a1"), word("a7"), word("f1"), word("f7")),
                  adv_fund_name=c("fund_name"), formd_entity_name=c("entityname"), adv_3c1=c("a1"), adv_3c7=c("a7"), formd_3c1=c("f1"), formd_3c7=c("f7"), formd_accession=c("accessionnumber"))


def unregistered(filings: DataFrame, matched: DataFrame, advisers: DataFrame, owners: DataFrame, as_of: str, months: int = 6, grace: int = 60) -> DataFrame:
    """Managers of pooled funds that filed in the last months but more than grace days ago, are in no match and found neither as advisers nor by their principals.

    Filings that are amendments, or have no cik, don't count.  Managers that may be exempt are of low severity.
    """
    day, now = T.mixed_date(F.col("filing_date")), F.lit(as_of).cast("date")
    rows = filings.filter("industrygrouptype = 'Pooled Investment Fund' AND isamendment <> 'true' AND cik IS NOT NULL").withColumn("day", day)
    rows = rows.filter((F.col("day") >= F.add_months(now, -months)) & (F.date_diff(now, F.col("day")) > grace)).join(matched.select("accessionnumber"), "accessionnumber", "left_anti")
    who = M.manager_candidates(rows).select("id", F.coalesce(F.nullif("candidate", F.lit("")), F.lit("")).alias("manager"), "source", "platform")
    rows = rows.join(who, "id")
    newest = F.struct(-F.unix_date("day"), F.col("id"))
    amount = F.coalesce(T.leading_number(F.col("totalofferingamount")).cast("decimal(20,2)"), F.lit(0))
    rolled = rows.groupBy("manager").agg(
        F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.sum(amount).alias("total"),
        F.min_by(F.struct("cik", "related_names", "related_roles", "stateorcountry", "platform", "source"), newest).alias("x"),
    )
    rolled = rolled.join(shown(rows, "manager", "entityname", F.desc("day"), "id", to="sample"), "manager")
    # the lookups and the result read it; a filter before would be written out below the steps that make the manager
    rolled = work.written(rolled, "managers").filter("manager <> ''")
    asked = rolled.select(F.col("manager").alias("key"), F.col("manager").alias("name"), "x.related_names", "x.related_roles")
    known = R.search(asked, advisers, owners).select("key").union(R.by_principals(asked, owners, advisers).select("key")).distinct()
    left = rolled.join(known.withColumnRenamed("key", "manager"), "manager", "left_anti").withColumn("tags", M.exemption_tags(F.col("x.stateorcountry"), F.col("x.related_names")))
    days, c = F.date_diff(now, F.col("first")), F.col
    return issues(left, "needs_initial_adv_filing", F.when(F.size("tags") > 0, "low").otherwise("high"), F.lit(None), c("x.cik"), said(TEXTS["needs_initial_adv_filing"], c("manager"), c("n"), c("first"), days),
                  manager_name=c("manager"), fund_count=c("n"), earliest_filing_date=c("first").cast("string"), latest_filing_date=c("last").cast("string"), days_since_first_filing=days, total_offering_amount=c("total").cast("string"), extraction_source=c("x.source"), platform_name=c("x.platform"), likely_exemptions=c("tags"), sample_funds=c("sample"))


def graded(filings: DataFrame, matched: DataFrame, advisers: DataFrame, as_of: str, grace: int = 60) -> DataFrame:
    """Another way to the same: firms that filings more than grace days old may belong to, none of which is an adviser's name or nearly so; graded by the days since the first, the largest offering first.

    A filing counts for its first candidate, or for its entity if it has none; those in a match or without a cik are left
    out.  A date that can't be read is none.
    """
    now, c = F.lit(as_of).cast("date"), F.col
    rows = filings.filter("cik IS NOT NULL").join(matched.select("accessionnumber"), "accessionnumber", "left_anti").withColumn("day", T.mixed_date(c("filing_date")))
    rows = rows.filter(F.date_diff(now, c("day")) > grace)
    listed = R.firm_candidates(c("entityname"), c("related_names"), c("related_roles"))
    raw = F.array(F.struct(c("entityname").alias("name"), F.lit("entity_name_raw").alias("source"), F.lit(5).alias("priority")))
    rows = work.written(rows.withColumn("c", listed).withColumn("c", F.when(F.size("c") > 0, c("c")).otherwise(raw)), "candidates")
    asked = rows.select(c("id").alias("key"), F.posexplode("c").alias("place", "x")).select("key", "place", "x.name", "x.source")
    found = R.index_matches(asked, advisers).select(c("key").alias("id"))
    left = rows.join(found, "id", "left_anti").withColumn("x", F.get("c", F.lit(0))).withColumn("manager", c("x.name")).filter("manager IS NOT NULL")
    amount = F.coalesce(T.leading_number(c("totalofferingamount")).cast("decimal(20,2)"), F.lit(0))
    newest = F.struct(-F.unix_date("day"), c("id"))
    rolled = left.groupBy("manager").agg(
        F.count("*").alias("n"), F.min("day").alias("first"), F.sum(amount).alias("total"), F.min_by(F.struct("cik", c("x.source").alias("source"), F.transform("c", lambda x: x["name"]).alias("names")), newest).alias("x"),
    )
    rolled = rolled.join(shown(left, "manager", "entityname", F.desc("day"), "id", to="sample"), "manager")
    days = F.date_diff(now, c("first"))
    severity = F.when(days > 180, "critical").when(days > 120, "high").otherwise("medium")
    out = issues(rolled.orderBy(F.desc("total"), "manager"), "needs_initial_adv_filing", severity, F.lit(None), c("x.cik"), said(TEXTS["graded_registration"], c("manager"), c("n"), c("first"), days),
                 manager_name=c("manager"), name_source=c("x.source"), fund_count=c("n"), earliest_filing_date=c("first").cast("string"), days_since_first_filing=days, total_offering_amount=c("total").cast("string"), all_firm_candidates=c("x.names"), sample_funds=c("sample"))
    return out


def audited(flagged: DataFrame, filings: DataFrame, advisers: DataFrame, owners: DataFrame) -> DataFrame:
    """manager and category of each flagged (manager_name, cik): a platform's filing, a place abroad, an adviser found after all by name or by a principal, or truly none.

    Looked at with the smallest filing of its cik.
    """
    first = newest_per(filings.filter("cik <> ''"), F.col("cik"), F.col("id")).select("cik", "entityname", "related_names", "related_roles", "stateorcountry")
    rows = flagged.select("manager_name", "cik").join(first, "cik", "left").withColumn("key", F.col("manager_name"))
    rows = work.written(rows, "flagged")  # the lookups read it
    hit = R.lookup(rows.filter("manager_name <> ''").select("key", F.col("manager_name").alias("name"), "related_names", "related_roles"), advisers, owners).select("key", "source")
    person = R.by_principals(rows.select("key", "related_names"), owners, advisers).select("key", F.lit(True).alias("person"))
    place = F.upper(F.trim("stateorcountry"))
    abroad = F.coalesce((place != "") & ~place.isin(*M.HOME), F.lit(False))
    platform = F.size(M.signals(F.coalesce("entityname", F.lit("")), F.coalesce("related_names", F.lit("")))) > 0
    verdict = F.when(F.coalesce("manager_name", F.lit("")) == "", "INCONCLUSIVE").when(F.col("entityname").isNotNull() & platform, "PLATFORM_FILING").when(abroad, "LIKELY_FOREIGN")
    verdict = verdict.when(F.col("source").isin("adviser_owners", "database_related_person"), "LIKELY_FP_PRINCIPAL").when(F.col("source").isNotNull(), "LIKELY_FP_NAME").when(F.col("person"), "LIKELY_FP_PRINCIPAL")
    return rows.join(hit, "key", "left").join(person, "key", "left").select("manager_name", "cik", verdict.otherwise("LIKELY_TRUE").alias("category"))


def found_managers(filings: DataFrame, matched: DataFrame, as_of: str, grace: int = 60, limit: int | None = 200) -> DataFrame:
    """Firms behind unmatched filings older than grace days: n and total; the largest totals, or all."""
    rows = filings.filter(F.date_diff(F.lit(as_of).cast("date"), T.mixed_date(F.col("filing_date"))) > grace).join(matched.select("accessionnumber"), "accessionnumber", "left_anti")
    rows = rows.select(R.manager_entity(F.col("related_names"), F.col("related_roles"), F.col("entityname"))["name"].alias("name"), F.coalesce(T.leading_number(F.col("totalofferingamount")).cast("decimal(20,2)"), F.lit(0)).alias("amount")).filter("name IS NOT NULL")
    rolled = rows.groupBy("name").agg(F.count("*").alias("n_filings"), F.sum("amount").cast("double").alias("total_offering"))
    return rolled if limit is None else rolled.orderBy(F.desc("total_offering"), "name").limit(limit)


def all_of(*parts: DataFrame) -> DataFrame:
    """Issues of several detectors with rank, 0 for the gravest severity."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("severity")) - 1, F.lit(4))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank.cast("int"))


def summary(found: DataFrame) -> DataFrame:
    """n and one sample (the smallest description) of each type."""
    return found.groupBy("discrepancy_type").agg(F.count("*").alias("n"), F.min("description").alias("sample"))


# The older detectors: other thresholds, contacts, and no issue's metadata.


def contacts(advisers: DataFrame) -> DataFrame:
    return advisers.select("crd", F.col("adviser_name").alias("entity_name"), F.struct(F.col("regulatory_contact_email").alias("email"), F.col("phone_number").alias("phone"), F.col("primary_website").alias("website")).alias("contact_info"))


def old_unregistered(filings: DataFrame, advisers: DataFrame, as_of: str, grace: int = 60) -> DataFrame:
    """Series' managers whose first filing is older than grace days and whose first word is in no adviser's names."""
    rows = filings.select(F.trim(T.series_master(F.col("entityname"))).alias("entity_name"), T.mixed_date(F.col("filing_date")).alias("day")).filter("entity_name IS NOT NULL")
    rolled = rows.groupBy("entity_name").agg(F.count("*").alias("fund_count"), F.min("day").alias("first")).withColumn("days_since_filing", F.abs(F.date_diff(F.lit(as_of).cast("date"), F.col("first")))).filter(F.col("days_since_filing") > grace)
    asked = rolled.select("entity_name", F.get(F.split("entity_name", " "), F.lit(0)).alias("part"))
    both = advisers.select("crd", "adviser_name").union(advisers.select("crd", "adviser_entity_legal_name"))
    known = asked.join(R.containing(asked, both).select("part").distinct(), "part").select("entity_name")
    return rolled.join(known, "entity_name", "left_anti").select("entity_name", "fund_count", "days_since_filing", (F.col("days_since_filing") - grace).alias("days_overdue"))


def after_deadline(as_of: str) -> Column:
    """From the fifteenth of April on."""
    day = F.lit(as_of).cast("date")
    return (F.month(day) > 4) | ((F.month(day) == 4) & (F.dayofmonth(day) >= 15))


def old_overdue(matches: DataFrame, advisers: DataFrame, as_of: str) -> DataFrame:
    """Advisers of matches with an older year than this one's, from the fifteenth of April on: their latest year, and how many matches."""
    rows = matches.filter(after_deadline(as_of)).filter((F.col("latest_adv_year") < F.year(F.lit(as_of).cast("date"))) & F.col("adviser_entity_crd").isNotNull())
    rolled = rows.groupBy(F.col("adviser_entity_crd").alias("crd")).agg(F.max("latest_adv_year").alias("latest_adv_year"), F.count("*").alias("fund_count"))
    return rolled.join(contacts(advisers), "crd", "left")


def old_venture_violations(advisers: DataFrame, funds: DataFrame) -> DataFrame:
    """Advisers with the venture exemption and funds whose type names another kind."""
    claims = advisers.filter(T.is_yes(F.col("exemption_2b1"))).select("crd").distinct()
    bad = F.coalesce(F.lower("fund_type").rlike(NOT_VENTURE_OLD), F.lit(False))
    rows = funds.select(F.col("adviser_entity_crd").alias("crd"), bad.alias("bad")).join(claims, "crd", "left_semi").groupBy("crd").agg(F.count("*").alias("total_funds"), F.count_if("bad").alias("non_vc_fund_count"))
    return rows.filter("non_vc_fund_count > 0").join(contacts(advisers), "crd", "left")


def old_type_mismatches(matches: DataFrame, least: float = 0.9) -> DataFrame:
    """Matches of a score from least on whose standard types differ; sides without one are skipped."""
    a, b = formats.standard_type(F.col("fund_type")), formats.standard_type(F.col("investmentfundtype"))
    rows = matches.filter(F.col("match_score") >= least).select("fund_id", "accessionnumber", F.col("adviser_entity_crd").alias("crd"), b.alias("form_d_type"), a.alias("form_adv_type"))
    return rows.filter("form_d_type IS NOT NULL AND form_adv_type IS NOT NULL AND form_d_type <> form_adv_type")


def old_missing(filings: DataFrame, matched: DataFrame, advisers: DataFrame) -> DataFrame:
    """Filings of pooled funds that name an adviser (linked_crd) but are in no match."""
    rows = filings.filter("industrygrouptype = 'Pooled Investment Fund' AND linked_crd IS NOT NULL").join(matched.select("accessionnumber"), "accessionnumber", "left_anti")
    return rows.select("accessionnumber", "entityname", F.col("linked_crd").alias("crd")).join(contacts(advisers), "crd")


def old_exemption_mismatches(matches: DataFrame, funds: DataFrame, filings: DataFrame, least: float = 0.9) -> DataFrame:
    """Matches of a score from least on where the filing names one exclusion literally and the fund only the other."""
    yes = lambda x: F.coalesce(F.col(x).isin("Y", "true"), F.lit(False))
    rows = matches.filter(F.col("match_score") >= least).select("fund_id", "accessionnumber", F.col("adviser_entity_crd").alias("crd"))
    rows = rows.join(funds.select("fund_id", yes("exclusion_3c1").alias("a1"), yes("exclusion_3c7").alias("a7")), "fund_id").join(filings.select("accessionnumber", F.coalesce("exemptions", F.lit("")).alias("e")), "accessionnumber")
    f1, f7 = F.col("e").contains("3(c)(1)"), F.col("e").contains("3(c)(7)")
    rows = rows.filter((f1 & ~F.col("a1") & F.col("a7")) | (f7 & ~F.col("a7") & F.col("a1")))
    word = lambda one, seven: F.when(one, "3(c)(1)").when(seven, "3(c)(7)").otherwise("Unknown")
    return rows.select("fund_id", "accessionnumber", "crd", word(f1, f7).alias("form_d_exemption"), word(F.col("a1"), F.col("a7")).alias("form_adv_exemption"))
