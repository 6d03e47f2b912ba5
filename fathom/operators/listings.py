"""What lists show: searches, filters, pages and joins for display.  All take and return lazy DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.operators import containment
from fathom.operators.core import newest_per
from fathom.sources import work

#: Searches of fewer characters are ignored.
LEAST_QUERY = 3
#: Columns that a list of funds may be sorted by; the first is the default.
SORTABLE = ("updated_at", "created_at", "fund_name", "latest_gross_asset_value", "adviser_entity_legal_name")
#: Umbrellas of administrators, which are no managers.
UMBRELLAS = ("roll up vehicles", "angellist funds", "multimodal ventures", "mv funds", "cgf2021 llc", "sydecar")
#: Codes of strategies and what they stand for.
STRATEGIES = {"hedge": "Hedge Fund", "pe": "Private Equity Fund", "vc": "Venture Capital Fund", "real_estate": "Real Estate Fund"}
PAGE_CAP, FILINGS_CAP = 500, 2000


def holds(query: str, *columns: str) -> Column:
    """query in one of the columns, in any case; a null column doesn't hold it."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
    return test


def starts(query: str, column: str) -> Column:
    return F.coalesce(F.startswith(F.lower(F.col(column)), F.lit(query.lower())), F.lit(False))


def in_order(query: str, column: str) -> Column:
    """The words of query one after another, anything between them."""
    pattern = "%" + "%".join(w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for w in query.split()) + "%"
    return F.coalesce(F.ilike(F.col(column), F.lit(pattern)), F.lit(False))


def one_of(listed: str, column: str) -> Column:
    """The column is one of the values that a text with commas lists."""
    return F.col(column).isin(*(x.strip() for x in listed.split(",")))


def not_yes(column: str) -> Column:
    """Anything but Y; a null counts."""
    return F.coalesce(F.col(column) != "Y", F.lit(True))


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def search_advisers(advisers: DataFrame, funds: DataFrame, query: str = "", state: str = "", kind: str = "", exemption: str = "", least: float | None = None, most: float | None = None, limit: int | None = 500) -> DataFrame:
    """Advisers by name, place, kind, exemption and assets (in millions), with how many funds they have: those with most assets in 2025, or all."""
    rows = advisers
    if len(query.strip()) >= LEAST_QUERY:
        rows = rows.filter(holds(query, "adviser_name", "adviser_entity_legal_name", "other_business_names"))
    for column, value in (("state_country", state), ("type", kind)):
        if value.strip():
            rows = rows.filter(F.col(column) == value)
    for name, column in (("vc", "exemption_2b1"), ("private_fund", "exemption_2b2")):
        if exemption == name:
            rows = rows.filter(F.col(column) == "Y")
    if least is not None:
        rows = rows.filter(F.col("total_aum") >= least * 1_000_000)
    if most is not None:
        rows = rows.filter(F.col("total_aum") <= most * 1_000_000)
    top = rows if limit is None else rows.orderBy(F.desc_nulls_last("aum_2025"), "crd").limit(limit)
    counts = funds.groupBy(F.col("adviser_entity_crd").alias("crd")).agg(F.count("*").alias("n"))
    return top.join(counts, "crd", "left").withColumn("fund_count", F.coalesce("n", F.lit(0))).drop("n")


def search_funds(funds: DataFrame, query: str = "", scope: str = "all", one: str = "", seven: str = "") -> DataFrame:
    """Funds by name or adviser; one and seven: yes or no to the exclusions.  Nothing for related, which filings alone have."""
    if query and scope == "related":
        return funds.limit(0)
    if query:
        columns = {"name": ("fund_name",), "adviser": ("adviser_entity_legal_name",)}.get(scope, ("fund_name", "adviser_entity_legal_name"))
        funds = funds.filter(holds(query, *columns))
    for value, column in ((one, "exclusion_3c1"), (seven, "exclusion_3c7")):
        if value == "yes":
            funds = funds.filter(F.col(column) == "Y")
        elif value == "no":
            funds = funds.filter(not_yes(column))
    return funds


def page(rows: DataFrame, key: str, number: int = 1, size: int = 100, by: str = "", ascending: bool = False) -> DataFrame:
    """One page of rows, nulls last and ties by key, with total, total_pages and has_more in every row; size is capped."""
    size, by = min(size, PAGE_CAP), by if by in SORTABLE else SORTABLE[0]
    total = rows.count()
    pages = -(-total // size)
    order = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    some = rows.orderBy(order, key).offset((number - 1) * size).limit(size)
    return some.withColumns({"total": F.lit(total).cast("long"), "total_pages": F.lit(pages).cast("long"), "has_more": F.lit(number < pages)})


def with_filings(funds: DataFrame, matches: DataFrame, filings: DataFrame) -> DataFrame:
    """funds with the best of the matches that have their exact name and a score of 1, and that filing's related parties.

    matches: adv_fund_name, formd_entity_name, formd_filing_date, formd_offering_amount, formd_accession, match_score.
    """
    best = newest_per(matches.filter("match_score = 1"), F.col("adv_fund_name"), F.desc("match_score"), F.col("formd_accession"))
    best = best.join(filings.select(F.col("accessionnumber").alias("formd_accession"), "related_names", "related_roles"), "formd_accession", "left")
    named = best.select("adv_fund_name", *(F.col(f"formd_{c}").alias(f"form_d_{c}") for c in ("entity_name", "filing_date", "offering_amount", "accession")), F.col("match_score").alias("form_d_match_score"), "related_names", "related_roles", F.lit(True).alias("has_form_d_match"))
    out = funds.join(named, funds["fund_name"] == named["adv_fund_name"], "left").drop("adv_fund_name")
    return out.withColumn("has_form_d_match", F.coalesce("has_form_d_match", F.lit(False))).withColumn("source", F.lit("adv"))


#: Names under which a list of filings shows columns.
SHOWN = {
    "fund_name": "entityname", "form_d_cik": "cik", "form_d_filing_date": "filing_date", "federal_exemptions": "federalexemptions_items_list", "investment_fund_type": "investmentfundtype", "form_d_offering_amount": "totalofferingamount",
    "form_d_amount_sold": "totalamountsold", "form_d_file_number": "file_num", "form_d_phone": "issuerphonenumber", "form_d_signer": "nameofsigner", "form_d_is_amendment": "isamendment", "form_d_industry": "industrygrouptype",
}


def address(*parts: str) -> Column:
    """The parts that aren't empty, with commas."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", ")


def search_filings(filings: DataFrame, query: str = "", scope: str = "all", state: str = "", start: str | None = None, end: str | None = None, limit: int | None = 1000) -> DataFrame:
    """The newest filing of each cik (of each name where there is none) under the names that lists show; nothing for adviser, which filings don't have.

    Of all filings that fit, the last FILINGS_CAP at most by id are looked at, as lists do; without a limit, all are.
    """
    if query and scope == "adviser":
        return filings.limit(0).select("id", *(F.col(c).alias(a) for a, c in SHOWN.items()), F.lit("").alias("form_d_address"), F.lit("formd").alias("source"))
    if query:
        filings = filings.filter(holds(query, *{"name": ("entityname",), "related": ("related_names",)}.get(scope, ("entityname", "related_names"))))
    if state:
        filings = filings.filter(F.col("stateorcountry") == state)
    day = T.filing_date(F.col("filing_date"))
    some = (filings if limit is None else filings.orderBy(F.desc("id")).limit(min(limit, FILINGS_CAP))).withColumn("_day", day)
    if start:
        some = some.filter(F.col("_day") >= F.lit(start).cast("date"))
    if end:
        some = some.filter(F.col("_day") <= F.lit(end).cast("date"))
    kept = newest_per(some, first_text(F.col("cik"), F.col("entityname")), F.desc("_day"), F.desc("id"))
    return kept.select("id", *(F.col(c).alias(a) for a, c in SHOWN.items()), address("street1", "city", "stateorcountry", "zipcode").alias("form_d_address"), F.lit("formd").alias("source"))


def promoter(names: Column, roles: Column) -> Column:
    """The related party with a promoter's role, else the first; null for N/A, numbers and none."""
    cut = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    at = F.array_position(F.transform(cut(roles), lambda r: F.lower(r).contains("promoter")), True)
    name = F.when(at > 0, F.try_element_at(cut(names), at.cast("int"))).otherwise(F.try_element_at(cut(names), F.lit(1)))
    return F.when(~name.isin("", "N/A") & ~name.rlike(r"^\d+$"), name)


def promoter_advisers(filings: DataFrame, advisers: DataFrame) -> DataFrame:
    """id of each filing whose promoter's name holds an adviser's name or is held by it, with that adviser: the longest such name, then the smallest crd.

    Names of fewer than five characters count on neither side.  Each name of a promoter is looked up once.
    """
    least = 5
    rows = filings.select("id", "related_names", "related_roles").repartition(_tasks(filings))
    rows = rows.select("id", F.lower(promoter(F.col("related_names"), F.col("related_roles"))).alias("who"))
    rows = work.written(rows, "promoters").filter(F.length("who") >= least)  # many joins read it
    known = advisers.select("crd", F.lower(first_text(F.col("adviser_name"), F.col("adviser_entity_legal_name"))).alias("name")).filter(F.length("name") >= least)
    known = known.groupBy("name").agg(F.min("crd").alias("crd"))
    pair = lambda rows, part, text: rows.select(F.col("part").alias(part), F.col("text").alias(text)).select("who", "name")
    one = lambda rows, c, to: rows.select(F.col(c).alias(to))
    longer = pair(containment.held(one(rows, "who", "part"), one(known, "name", "text")), "who", "name")
    shorter = pair(containment.held(one(known, "name", "part"), one(rows, "who", "text")), "name", "who")
    met = longer.unionByName(shorter).join(known, "name")
    best = met.groupBy("who").agg(F.min_by(F.struct("crd", "name"), F.struct(-F.length("name"), "crd")).alias("x"))
    return rows.join(best, "who").select("id", "who", F.col("x.crd").alias("crd"), F.col("x.name").alias("adviser"))


#: Characters of the blocks at which names meet.
_WIDTH = 3


def _blocks(rows: DataFrame, text: str) -> DataFrame:
    """rows once for each whole block of text: its place and its characters.  A shorter text is a block of its own."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _WIDTH).cast("int") - 1), lambda i: F.struct(i.alias("at"), F.substring(F.col(text), i * _WIDTH + 1, F.lit(_WIDTH)).alias("part")))
    whole = F.array(F.struct(F.lit(-1).alias("at"), F.col(text).alias("part")))
    return rows.filter(F.length(text) > 0).select("*", F.explode(F.when(F.length(text) >= _WIDTH, cut).otherwise(whole)).alias("block"))


def _ranked(rows: DataFrame, text: str, often: DataFrame) -> DataFrame:
    """text and the two rarest of its blocks more than it may have wrong, as o; often (block, n) has how many known texts hold a block."""
    each = _blocks(rows.select(text), text).join(often, "block", "left").groupBy(text).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "block"))).alias("o"))
    return each.select(text, F.slice("o", F.lit(1), F.floor(F.length(text) / 9).cast("int") + 2).alias("o"))


def _tasks(rows: DataFrame) -> int:
    """How many tasks names are compared in: few bytes may be many pairs."""
    return 2 * max(rows.sparkSession.sparkContext.defaultParallelism, 16)


def _pairs(ours: DataFrame, theirs: DataFrame, wrong: int) -> DataFrame:
    """near_pairs of ranked names."""

    def keyed(rows: DataFrame, text: str) -> DataFrame:
        most = F.least(F.floor(F.length(text) / 9).cast("int"), F.lit(wrong)) + 2
        alone = F.size("o") == 1
        rows = rows.select(text, alone.alias("alone"), F.transform(F.filter(F.slice("o", F.lit(1), most), lambda x: x["n"] > 0), lambda x: x["block"]).alias("p"))
        two = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        one = F.transform("p", lambda x: F.struct(x.alias("a"), x.alias("b")))
        return rows.select(text, F.explode(F.when(F.col("alone"), one).otherwise(two)).alias("k")).repartition(_tasks(rows), "k")

    return keyed(ours, "shown").join(keyed(theirs, "shown_b"), "k").select("shown", "shown_b").distinct()


def _often(known: DataFrame) -> DataFrame:
    return _blocks(known.select("shown_b"), "shown_b").groupBy("block").agg(F.count("*").alias("n"))


def near_pairs(asked: DataFrame, known: DataFrame, wrong: int) -> DataFrame:
    """shown and shown_b of asked (shown) and known (shown_b), distinct, which share two rare blocks.

    Names of n characters, equal in nine places of ten, differ in n / 9 places at most, and so in as many blocks of three.
    The two rarest blocks that both have are then among the n / 9 + 2 rarest of each, and names meet at both at once:
    one block may stand in every name.  A name of one block meets at that.  Only pairs that differ in at most wrong
    places are sure to meet, at the wrong + 2 rarest.
    """
    often = _often(known)
    return _pairs(_ranked(asked, "shown", often), _ranked(known, "shown_b", often), wrong)


def nearest_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """For each distinct name of asked (shown) that one of known (shown_b, id) equals in nine places of ten or more: shown, id and score of the nearest, the smallest id of equals.

    Names that differ in one place are looked for first, then in two, in four and so on, always for the names only that
    have found none which is surely the nearest: another with d places wrong is worse than one with fewer than .9 d.  So
    a name with near neighbours never meets the far ones.
    """
    spark, place = asked.sparkSession, work.folder(asked.sparkSession, "names")
    known.groupBy("shown_b").agg(F.min("id").alias("id")).write.parquet(f"{place}/known")
    asked.select("shown").distinct().write.parquet(f"{place}/asked")
    known, left = spark.read.parquet(f"{place}/known"), spark.read.parquet(f"{place}/asked")
    longest = left.agg(F.max(F.length("shown"))).first()[0] or 0
    # blocks are counted and ranked once for all rounds
    often = work.written(_often(known), "often")
    theirs, left = work.written(_ranked(known, "shown_b", often), "theirs"), work.written(_ranked(left, "shown", often), "ours")
    parts, wrong, step = [], 1, 0
    while True:
        last, step = wrong >= longest // 9, step + 1
        longer, most = F.greatest(F.length("shown"), F.length("shown_b")), 12
        met = _pairs(left, theirs, wrong).filter(F.least(F.length("shown"), F.length("shown_b")) / longer >= 0.9)
        # places that differ are at least as many as edits, which are counted faster
        edits = F.levenshtein("shown", "shown_b", most)
        near = met.filter((longer > 10 * most) | ((edits >= 0) & (10 * edits <= longer))).withColumn("score", N.positional_similarity(F.col("shown"), F.col("shown_b"))).filter("score >= 0.9").join(known, "shown_b")
        differs = F.round((1 - F.col("score")) * F.greatest(F.length("shown"), F.length("shown_b")))
        best = near.groupBy("shown").agg(F.min_by(F.struct("id", "score", differs.alias("d")), F.struct(-F.col("score"), "id")).alias("x")).select("shown", "x.*")
        best = work.written(best, "best")
        sure = best if last else best.filter(F.col("d") < 0.9 * (wrong + 1))
        parts.append(sure.select("shown", "id", "score"))
        if last:
            return reduce(DataFrame.unionByName, parts)
        left = work.written(left.join(sure.select("shown"), "shown", "left_anti"), "left")
        wrong *= 2


def best_named(funds: DataFrame, filings: DataFrame) -> DataFrame:
    """For each fund (fund_id, fund_name) the filing (id, entityname) of the same name, of the same display form, else of the most equal places from 0.9 on.

    Ties go to the smallest id, but to the largest among filings of the same name.
    """
    shown = lambda c: N.normal(c, "display")
    a = funds.filter("fund_name <> ''").select("fund_id", F.lower(F.trim("fund_name")).alias("key"), shown(F.col("fund_name")).alias("shown"))
    b = filings.filter("entityname <> ''").select("id", F.lower(F.trim("entityname")).alias("key"), shown(F.col("entityname")).alias("shown_b")).groupBy("key", "shown_b").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    exact = a.join(b.groupBy("key").agg(F.max("last").alias("id")), "key").select("fund_id", "id", F.lit(0).alias("how"), F.lit(1.0).alias("score"))
    forms = b.groupBy(F.col("shown_b").alias("shown")).agg(F.min("id").alias("id"))
    same = a.join(exact, "fund_id", "left_anti").join(forms, "shown").select("fund_id", "id", F.lit(1).alias("how"), F.lit(1.0).alias("score"))
    found = exact.unionByName(same)
    rest = a.join(found, "fund_id", "left_anti")
    near = rest.join(nearest_names(rest, b.select("shown_b", "id")), "shown").select("fund_id", "id", F.lit(2).alias("how"), "score")
    return found.unionByName(near).select("fund_id", "id", "how", F.round("score", 6).alias("score"))


def combined(funds: DataFrame, matched: DataFrame, filings: DataFrame) -> DataFrame:
    """Funds with their filing (fund_id, id) and filings that no fund has, one row for each display name.

    A fund goes before a filing, one with a filing before one without, then the smaller id.
    """
    f = filings.select("id", "entityname", F.col("totalofferingamount").alias("form_d_offering_amount"), "investmentfundtype", T.iso_date(F.col("filing_date")).alias("filed"))
    ours = funds.join(matched.select("fund_id", "id"), "fund_id", "left").join(f, "id", "left")
    ours = ours.select("fund_name", F.lit("adv").alias("source"), "fund_type", F.col("investmentfundtype").alias("investment_fund_type"), "form_d_offering_amount", F.col("id").isNotNull().alias("has_form_d_match"), F.coalesce(T.iso_date(F.col("updated_at")), "filed").alias("sort_date"), F.col("fund_id").alias("_id"))
    rest = f.filter("entityname <> ''").join(matched.select("id"), "id", "left_anti")
    rest = rest.select(F.col("entityname").alias("fund_name"), F.lit("formd").alias("source"), F.lit(None).cast("string").alias("fund_type"), F.col("investmentfundtype").alias("investment_fund_type"), "form_d_offering_amount", F.lit(True).alias("has_form_d_match"), F.col("filed").alias("sort_date"), F.col("id").alias("_id"))
    rows = ours.unionByName(rest).withColumn("_key", N.normal(F.coalesce("fund_name", F.lit("")), "display")).filter("_key <> ''")
    return newest_per(rows, F.col("_key"), F.desc(F.col("source") == "adv"), F.desc((F.col("source") == "adv") & F.col("has_form_d_match")), F.col("_id")).drop("_key", "_id")


def narrowed(rows: DataFrame, strategy: str = "", least: float = 0, most: float = 0, start: str = "", end: str = "") -> DataFrame:
    """Rows of a strategy, of an amount and of a range of ISO dates; rows without the amount or the date asked for go."""
    if strategy:
        rows = rows.filter(holds(STRATEGIES.get(strategy, ""), "investment_fund_type", "fund_type"))
    amount = F.nullif(T.amount(F.col("form_d_offering_amount")), F.lit(0.0))
    for test, wanted in ((amount >= least, least), (amount <= most, most), (F.col("sort_date") >= start, start), (F.col("sort_date") <= end, end)):
        if wanted:
            rows = rows.filter(test)
    return rows


def platform_managers(rows: DataFrame, query: str = "", platforms: str = "", least: int = 2) -> DataFrame:
    """Managers on at least so many platforms, of the platforms and words asked for; rows without a name go.  Texts become numbers and lists."""
    whole = lambda c: F.col(c).try_cast("int")
    rows = rows.filter("display_name <> ''")
    if least > 1:
        rows = rows.filter(whole("num_platforms") >= least)
    if platforms:
        rows = rows.filter(F.exists(F.array(*(F.lit(p.strip().lower()) for p in platforms.split(","))), lambda p: F.contains(F.lower(F.coalesce("platforms_used", F.lit(""))), p)))
    if query.strip():
        rows = rows.filter(holds(query, "display_name", "ia_firm_name", "sample_entities"))
    team = F.from_json(F.translate("team_members", "'", '"'), "array<struct<name: string>>")
    return rows.select(
        F.col("manager_key").alias("id"), "display_name", F.coalesce(whole("num_platforms"), F.lit(0)).alias("num_platforms"), F.filter(F.split(F.coalesce("platforms_used", F.lit("")), ", "), lambda x: x != "").alias("platforms"),
        F.coalesce(whole("num_filings"), F.lit(0)).alias("num_filings"), F.nullif("ia_firm_name", F.lit("")).alias("ia_firm_name"), F.slice(F.split(F.coalesce("sample_entities", F.lit("")), r" \| "), 1, 3).alias("sample_entities"),
        F.coalesce(F.transform(F.filter(team, lambda t: t.isNotNull()), lambda t: t["name"]), F.array().cast("array<string>")).alias("team"),
    )


def listed_issues(issues: DataFrame, advisers: DataFrame, severities: str = "", kinds: str = "", query: str = "", status: str = "active") -> DataFrame:
    """Issues with the name of whom they concern, the fund, and contacts: the adviser's where it is known, else what the issue's metadata says."""
    for wanted, column in ((status, "status"), (severities, "severity"), (kinds, "discrepancy_type")):
        if wanted:
            issues = issues.filter(one_of(wanted, column))
    meta = lambda path: F.get_json_object("metadata", f"$.{path}")
    if query.strip():
        issues = issues.withColumns({"_fund": meta("fund_name"), "_entity": meta("entity_name")}).filter(holds(query, "description", "_fund", "_entity")).drop("_fund", "_entity")
    known = advisers.select(F.col("crd").alias("adviser_crd"), "adviser_name", "adviser_entity_legal_name", "primary_website", "phone_number", "regulatory_contact_email")
    contact = F.struct(first_text(F.col("regulatory_contact_email"), meta("contact_email")).alias("email"), first_text(F.col("phone_number"), meta("contact_phone")).alias("phone"), F.col("primary_website").alias("website"))
    return issues.join(known, "adviser_crd", "left").select(
        "id", F.col("adviser_crd").alias("crd"), F.col("discrepancy_type").alias("type"), "severity", "status", "detected_date",
        F.coalesce(first_text(F.col("adviser_name"), F.col("adviser_entity_legal_name"), meta("entity_name"), meta("adviser_name"), meta("fund_name")), F.lit("Unknown")).alias("entity_name"),
        first_text(meta("sample_non_vc_funds[0].name"), meta("primary_fund_name"), meta("adv_fund_name"), meta("fund_name")).alias("fund_name"), contact.alias("contact_info"),
    )


def as_matches(issues: DataFrame) -> DataFrame:
    """listed_issues under the names that lists of matches have."""
    name = first_text(F.col("fund_name"), F.col("entity_name"))
    return issues.select("id", name.alias("adv_fund_name"), name.alias("formd_entity_name"), F.col("entity_name").alias("adviser_entity_legal_name"), F.col("crd").alias("adviser_entity_crd"), F.col("type").alias("issues"), F.col("type").alias("discrepancy_type"), "severity")


def active(*years: str) -> Column:
    """One of the amounts is there and isn't zero."""
    test = F.lit(False)
    for c in years:
        test = test | F.coalesce(F.col(c) != 0, F.lit(False))
    return test


def unified(advisers: DataFrame, records: DataFrame) -> DataFrame:
    """Advisers and looked-into managers that name their crd as one entity each: the adviser's name first, the manager's website first.

    A manager without a known adviser stands alone; of several managers with one crd the smallest id counts.
    """
    r = newest_per(records, F.coalesce(F.concat(F.lit("c"), "linked_crd"), F.concat(F.lit("r"), "id")), F.col("id"))
    r = r.select(F.col("id").alias("record_id"), "linked_crd", "series_master_llc", "website_url", F.col("fund_type").alias("record_fund_type"))
    both = advisers.join(r, advisers["crd"] == r["linked_crd"], "full_outer")
    on = active("total_aum", "aum_2023", "aum_2024", "aum_2025")
    there = F.col("crd").isNotNull()
    return both.select(
        F.coalesce("crd", "linked_crd").alias("crd"), "record_id", first_text(F.col("adviser_name"), F.col("adviser_entity_legal_name"), F.col("series_master_llc")).alias("name"), first_text(F.col("website_url"), F.col("primary_website")).alias("website"),
        (there & on).alias("has_form_adv"), (there & ~on).alias("is_adviser_defunct"), F.col("record_id").isNotNull().alias("has_enriched_data"), F.when(there, F.col("total_aum")).alias("aum"), F.col("record_fund_type").alias("fund_type"),
    )


def looked_into(managers: DataFrame, records: DataFrame) -> DataFrame:
    """managers (series_master) with the record of that full name, else of that manager's name after 'a series of'; the last id of equals."""
    full = records.select(F.lower("series_master_llc").alias("key"), F.lit(0).alias("prio"), full_record().alias("record")).filter("key <> ''")
    part = records.select(F.lower(T.series_master(F.col("series_master_llc"))).alias("key"), F.lit(1).alias("prio"), full_record().alias("record")).filter("key IS NOT NULL")
    # of equal full names the last one counts, of equal umbrella names the first
    best = full.unionByName(part).groupBy("key").agg(F.min_by("record", F.struct("prio", F.when(F.col("prio") == 0, -F.col("record.id")).otherwise(F.col("record.id")))).alias("record"))
    return managers.withColumn("key", F.lower("series_master")).join(best, "key", "left").drop("key")


def full_record() -> Column:
    return F.struct("id", "website_url", "linkedin_company_url", "primary_contact_email", "fund_type", "investment_stage", "enrichment_status")


def managers_of(filings: DataFrame, start: str | None = None, umbrellas: tuple[str, ...] = UMBRELLAS) -> DataFrame:
    """Pooled funds' filings that are no amendments, rolled up to the manager after 'a series of'; administrators' umbrellas go.

    Missing and unreadable dates count as the first day of 1970, amounts that are no numbers as 0.
    """
    rows = filings.filter("industrygrouptype = 'Pooled Investment Fund'").filter(F.coalesce(F.col("isamendment") != "true", F.lit(False)))
    rows = rows.select("id", F.trim(T.series_master(F.col("entityname"))).alias("series_master"), T.filing_date(F.col("filing_date")).alias("day"), T.leading_number(F.col("totalofferingamount")).cast("decimal(20,2)").alias("amount"), "related_names")
    rows = rows.filter(F.col("series_master").isNotNull() & ~F.lower("series_master").rlike("|".join(umbrellas)))
    if start:
        rows = rows.filter(F.col("day") >= F.lit(start).cast("date"))
    newest = F.struct(-F.unix_date("day"), F.col("id"))
    return rows.groupBy("series_master").agg(F.count("*").alias("fund_count"), F.sum(F.coalesce("amount", F.lit(0))).cast("double").alias("total_offering_amount"), F.min("day").alias("first_filing"), F.min_by("related_names", newest).alias("related_names"))


def merged(managers: DataFrame, investors: DataFrame) -> DataFrame:
    """looked_into managers with an investor (series_master, investor_url, investor_mail, investor_type) filled in where they say nothing.

    A record that may not be shown (neither site nor page) gets no identity fields from elsewhere; neutral fields always may.
    """
    r = F.col("record")
    rows = managers.join(investors, "series_master", "left")
    hidden = r.isNotNull() & first_text(r["website_url"], r["linkedin_company_url"]).isNull()
    fill = lambda a, b: F.when(hidden, F.nullif(a, F.lit(""))).otherwise(first_text(a, b))
    return rows.select(
        "series_master", "fund_count", "total_offering_amount", "first_filing", r["id"].alias("record_id"), fill(r["website_url"], F.col("investor_url")).alias("website"), fill(r["primary_contact_email"], F.col("investor_mail")).alias("email"),
        first_text(r["fund_type"], F.col("investor_type")).alias("fund_type"), hidden.alias("suppressed"), F.col("investor_type").isNotNull().alias("has_external_db"),
    )


def merged_references(contacts: DataFrame, terms: DataFrame) -> DataFrame:
    """Two references of investors as one, by the investor form of the name: contacts and names of the first go before, amounts are the second's.

    contacts: investor_name, website_url, primary_contact_email.  terms: investor_name, website_url, check_min.  Of
    equal names in one reference the smallest full name counts.  Names without a letter or digit go.
    """

    def keyed(rows: DataFrame, tag: str, *columns: str) -> DataFrame:
        rows = rows.withColumn("key", N.normal(F.col("investor_name"), "investor")).filter("key <> ''")
        return newest_per(rows, F.col("key"), F.col("investor_name"), F.col("website_url")).select("key", *(F.col(c).alias(f"{c}_{tag}") for c in columns), F.lit(True).alias(f"in_{tag}"))

    a, b = keyed(contacts, "a", "investor_name", "website_url", "primary_contact_email"), keyed(terms, "b", "investor_name", "website_url", "check_min")
    source = F.when(F.col("in_a") & F.col("in_b"), "merged").when(F.col("in_a"), "contacts").otherwise("terms")
    return a.join(b, "key", "full_outer").select("key", F.coalesce("investor_name_a", "investor_name_b").alias("investor_name"), first_text(F.col("website_url_a"), F.col("website_url_b")).alias("website_url"), "primary_contact_email_a", T.dollars(F.col("check_min_b")).alias("check_min"), source.alias("source")).withColumnRenamed("primary_contact_email_a", "primary_contact_email")


def exactly_one(rows: DataFrame) -> DataFrame:
    """rows, which must be one; none or more is an error."""
    n = rows.limit(2).count()
    if n != 1:
        raise LookupError(f"one row expected, found {'none' if n == 0 else 'several'}")
    return rows


def first_of(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row in an order, or none."""
    return rows.orderBy(*order).limit(1)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that depends on the seed alone."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def strided(rows: DataFrame, key: str, n: int, step: int = 37) -> DataFrame:
    """n rows spread over all of them, the same on every run: those whose whole-number key times step leaves the smallest rests."""
    return rows.orderBy(F.pmod(F.col(key) * step, F.lit(max(1, rows.count()))), key).limit(n)
