"""Writes to records as merge plans: each takes the old rows and the changes and returns the new rows.  Exports and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.operators import containment
from fathom.operators import registry as R
from fathom.operators.listings import first_text

#: Roles of those who serve a fund, and roles of those who run it.
SERVICE = r"(?i)\badministrator\b|\bfund admin\b|\bcustodian\b|\boutside counsel\b|\bexternal counsel\b|\boutside legal\b|\bexternal legal\b|\baccountant\b|\bauditor\b|\bsecretary\b"
INVESTING = "managing member|manager|general partner|executive officer|director|founder|principal|partner|ceo|cio|cfo|president|chief|portfolio manager"
FIRMS = "LLC|LP|Inc|Corp|Ltd|Fund"


def updated(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the non-null values of changes (key and some of old's columns, one row a key)."""
    new = [c for c in changes.columns if c != key]
    b = changes.select(key, *(F.col(c).alias(f"_{c}") for c in new))
    return old.join(b, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in new else F.col(c) for c in old.columns))


def reviewed(old: DataFrame, actions: DataFrame, now: str) -> DataFrame:
    """Records after actions (id, action, reason): publish shows and verifies one, skip marks it as no fund and hides it."""
    a = F.col("action")
    rows = old.join(actions, "id", "left")
    return rows.select(
        *(c for c in old.columns if c not in ("is_published", "enrichment_status")),
        F.when(a == "publish", True).when(a == "skip", False).otherwise(F.col("is_published")).alias("is_published"),
        F.when(a == "publish", "manually_verified").when(a == "skip", "not_a_fund").otherwise(F.col("enrichment_status")).alias("enrichment_status"),
        F.when(a == "publish", now).alias("verified_at"), F.when(a == "skip", now).alias("updated_at"), F.when((a == "skip") & (F.col("reason") != ""), F.array("reason")).otherwise(F.array().cast("array<string>")).alias("flagged_issues"),
    )


def promoted(old: DataFrame, found: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """old with found's values where they say something; manually verified rows stay unless forced; keys of found alone are new rows."""
    b = found.select(key, *(F.nullif(c, F.lit("")).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    stays = F.lit(False) if force else F.coalesce(F.col("enrichment_status") == "manually_verified", F.lit(False))
    pick = lambda c: F.when(stays, F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c)
    status = F.when(stays | F.col("_there").isNull(), F.col("enrichment_status")).otherwise("auto_enriched").alias("enrichment_status")
    return old.select(key, "enrichment_status", *columns).join(b, key, "full_outer").select(key, status, *map(pick, columns))


def children_replaced(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """old without the rows of parents that new has, and new's rows."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def added(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new whose key old doesn't have; of new rows with one key the smallest counts."""
    rest = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in rest))
    return old.unionByName(once.join(old, key, "left_anti").select(*old.columns))


def blanked(rows: DataFrame, column: str, bad: Column) -> DataFrame:
    """rows with a null in the column where it is bad."""
    return rows.withColumn(column, F.when(~F.coalesce(bad, F.lit(False)), F.col(column)))


def not_yet(managers: DataFrame, records: DataFrame) -> DataFrame:
    """managers (series_master) that no record names, in any case."""
    known = records.select(F.lower(F.trim("series_master_llc")).alias("k")).filter("k IS NOT NULL").distinct()
    return managers.withColumn("k", F.lower(F.trim("series_master"))).join(known, "k", "left_anti").drop("k")


def worth_it(name: Column) -> Column:
    """Four characters and two words of letters or more."""
    return F.coalesce((F.length(name) >= 4) & (F.size(F.filter(F.split(name, r"\s+"), lambda w: w.rlike("^[A-Za-z]{2,}$"))) >= 2), F.lit(False))


def key_person(names: Column, roles: Column) -> Column:
    """The first related party of a filing that is somebody, with the role: name, role; null if there is none."""
    cut = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    both = F.transform(F.arrays_zip(cut(names).alias("n"), cut(roles).alias("r")), lambda x: F.struct(N.party(x["n"]).alias("name"), F.when(F.upper(x["r"]) != "N/A", x["r"]).otherwise("").alias("role")))
    return F.try_element_at(F.filter(both, lambda x: F.coalesce(x["name"], F.lit("")) != ""), F.lit(1))


def parties(names: Column, roles: Column) -> Column:
    """'name (role)' of the related parties that are somebody, each with its own role."""
    cut = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    both = F.transform(F.arrays_zip(cut(names).alias("n"), cut(roles).alias("r")), lambda x: F.struct(N.party(x["n"]).alias("n"), F.coalesce(x["r"], F.lit("")).alias("r")))
    return F.transform(F.filter(both, lambda x: F.coalesce(x["n"], F.lit("")) != ""), lambda x: F.when(x["r"] != "", F.concat(x["n"], F.lit(" ("), x["r"], F.lit(")"))).otherwise(x["n"]))


def owners_of(titles: Column, names: Column, kinds: Column, amounts: Column) -> Column:
    """Four lists with semicolons as one of owners (name, title, type, amount); missing parts are N/A, owners without a name go."""
    cut = lambda c, a: F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)).alias(a)
    said = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    t, n, k, m = (cut(c, a) for c, a in ((titles, "t"), (names, "n"), (kinds, "k"), (amounts, "m")))
    rows = F.transform(t, lambda title, i: F.struct(said(F.get(n, i)).alias("name"), said(title).alias("title"), said(F.get(k, i)).alias("type"), said(F.get(m, i)).alias("amount")))
    return F.when(F.coalesce(titles, F.lit("")) != "", F.filter(rows, lambda o: o["name"] != "N/A")).otherwise(F.filter(rows, lambda o: F.lit(False)))


def filed_team(filings: DataFrame, most: int = 10) -> DataFrame:
    """For each manager after 'a series of' its related persons by the smallest filing: those who run it first, MOST at most; services, platforms and firms go."""
    rows = filings.select("id", F.lower(F.trim(T.series_master(F.col("entityname")))).alias("manager"), "related_names", "related_roles").filter("manager IS NOT NULL AND related_names IS NOT NULL")
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    each = rows.select("id", "manager", F.posexplode(F.arrays_zip(cut(F.col("related_names")).alias("n"), cut(F.col("related_roles")).alias("r"))).alias("place", "x")).select("id", "manager", "place", F.col("x.n").alias("name"), F.coalesce("x.r", F.lit("")).alias("role"))
    kept = each.filter("name IS NOT NULL").filter(~F.col("role").rlike(SERVICE) & ~F.col("name").rlike(N.PLATFORM_STAFF) & ~F.col("name").rlike(FIRMS))
    once = kept.groupBy("manager", F.lower("name").alias("k")).agg(F.min(F.struct("id", "place", "name", "role")).alias("p"))
    order = F.struct((~F.lower("p.role").rlike(INVESTING)).alias("o"), "p.id", "p.place", "p.name", "p.role")
    listed = once.groupBy("manager").agg(F.slice(F.sort_array(F.collect_list(order)), 1, most).alias("team"))
    return listed.select("manager", F.transform("team", lambda t: F.concat(t["name"], F.lit(": "), t["role"])).alias("team"))


def escaped(value: Column, more: str = "") -> Column:
    """A field of a text with commas: in quotes, its own doubled, where it holds a comma, a quote, a line break or one of more; empty for null."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(f'[,"\\n{more}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def contact_lines(records: DataFrame) -> DataFrame:
    """id and line: seven columns of records that have a site or a page, as text with commas."""
    rows = records.filter("website_url IS NOT NULL OR linkedin_company_url IS NOT NULL")
    score = F.when(F.col("confidence_score") != 0, F.format_string("%.2f", "confidence_score")).otherwise("")
    fields = [*(escaped(F.col(c)) for c in ("series_master_llc", "website_url", "linkedin_company_url", "fund_type", "investment_stage")), score, escaped(F.col("enrichment_status"))]
    return rows.select("id", F.concat_ws(",", *(F.coalesce(f, F.lit("")) for f in fields)).alias("line"))


def full_lines(records: DataFrame, filings: DataFrame) -> DataFrame:
    """id and line: records with what their manager's filings add up to, as text with commas (semicolons are quoted too)."""
    f = filings.select(F.lower(F.trim(T.series_master(F.col("entityname")))).alias("key"), "id", T.filing_date(F.col("filing_date")).alias("day"), "filing_date", "cik", T.leading_number(F.col("totalofferingamount")).cast("decimal(20,2)").alias("offered"), T.leading_number(F.col("totalamountsold")).cast("decimal(20,2)").alias("sold"), "investmentfundtype", F.transform(F.split(F.coalesce("federalexemptions_items_list", F.lit("")), ","), lambda x: F.trim(x)).alias("codes")).filter("key IS NOT NULL")
    o = F.struct("day", "id")
    sums = f.groupBy("key").agg(
        F.count("*").alias("n"), F.min_by(F.coalesce("filing_date", F.lit("")), o).alias("first"), F.max_by(F.coalesce("filing_date", F.lit("")), o).alias("last"), F.sum("offered").alias("offered"), F.sum("sold").alias("sold"),
        F.min_by("investmentfundtype", o).alias("kind"), F.array_join(F.filter(F.sort_array(F.array_distinct(F.flatten(F.collect_set("codes")))), lambda x: x != ""), ", ").alias("codes"), F.min(F.nullif("cik", F.lit(""))).alias("cik"),
    )
    rows = records.withColumn("key", F.lower("series_master_llc")).join(sums, "key", "left")
    whole = lambda c: F.when(F.col(c) > 0, F.round(F.col(c)).cast("long").cast("string")).otherwise("")
    place = F.array_join(F.filter(F.array("headquarters_city", "headquarters_state"), lambda x: x.isNotNull() & (x != "")), ", ")
    fields = [escaped(F.col("series_master_llc"), ";"), escaped(F.col("website_url"), ";"), escaped(F.col("first"), ";"), escaped(F.col("last"), ";"), F.coalesce("n", F.lit(0)).cast("string"), whole("offered"), whole("sold"), escaped(first_text(F.col("fund_type"), F.col("kind")), ";"), escaped(F.col("codes"), ";"), escaped(place, ";"), escaped(F.col("cik"), ";"), escaped(F.col("enrichment_status"), ";")]
    return rows.select("id", F.concat_ws(",", *(F.coalesce(x, F.lit("")) for x in fields)).alias("line"))


def merged_team(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two lists of people (id, name, title, email) as one for each id: by name in any case, the old one's values first."""
    key = lambda rows, t: rows.filter("name <> ''").groupBy("id", F.lower(F.trim("name")).alias("k")).agg(F.min(F.struct("name", "title", "email")).alias(t))
    both = key(old, "a").join(key(new, "b"), ["id", "k"], "full_outer")
    return both.select("id", *(first_text(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("name", "title", "email")))


def unregistered(managers: DataFrame, advisers: DataFrame, owners: DataFrame) -> DataFrame:
    """managers (series_master) that no lookup of the register finds: the register has the contacts of the others."""
    asked = managers.select(F.col("series_master").alias("key"), F.col("series_master").alias("name"), *(F.lit(None).cast("string").alias(c) for c in ("related_names", "related_roles")))
    known = R.lookup(asked, advisers, owners).select(F.col("key").alias("series_master"))
    return managers.join(known, "series_master", "left_anti")


def backfilled(records: DataFrame, found: DataFrame) -> DataFrame:
    """What profiles on a record's site add to it: id, linkedin_company_url (the site's, else the old one), team (array of name and linkedin), n_added and changed.

    records: id, linkedin_company_url and team; found: id, company and persons (url, name).  A person of the site is added
    at the end if it has a name and no member's profile holds its user; members stay as they are.
    """
    none = F.array().cast("array<struct<name: string, linkedin: string>>")
    rows = records.join(found, "id", "left").withColumn("team", F.coalesce("team", none))
    user = lambda p: F.lower(F.get(F.split(p["url"], "/in/"), F.lit(1)))

    def add(team: Column, p: Column) -> Column:
        there = F.exists(team, lambda m: F.coalesce(F.contains(F.lower(m["linkedin"]), user(p)), F.lit(False)))
        return F.when(there | p["name"].isNull(), team).otherwise(F.concat(team, F.array(F.struct(p["name"].alias("name"), p["url"].alias("linkedin")))))

    people = F.coalesce("persons", F.array().cast("array<struct<url: string, name: string>>"))
    rows = rows.withColumn("all", F.aggregate(people, F.col("team"), add))
    added = F.size("all") - F.size("team")
    return rows.select("id", F.coalesce("company", "linkedin_company_url").alias("linkedin_company_url"), F.col("all").alias("team"), added.alias("n_added"), (F.col("company").isNotNull() | (added > 0)).alias("changed"))


def filings_of_series(managers: DataFrame, filings: DataFrame) -> DataFrame:
    """series_master and id of each filing that says it is a series of the manager, its name anywhere after the words."""
    parts = managers.select("series_master", F.concat(F.lit("a series of "), F.col("series_master")).alias("part"))
    held = containment.held(parts, filings.select(F.col("entityname").alias("text")))
    return held.join(parts, "part").join(filings.select("id", "entityname"), F.col("text") == F.col("entityname")).select("series_master", "id")
