"""Who stands behind a filing, and which adviser that is.  Pairs come from equi-joins on names and tokens only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.operators.core import newest_per

#: Platform -> patterns of entity names, patterns of related names.  Signers are given by the caller.
PLATFORMS: dict[str, tuple[list[str], list[str]]] = {
    "AngelList": ([r"\broll\s+up\s+vehicles\b", r"\bangellist\b", r",\s*al,?\s*lp\s*$", r"-al-", r"\bangellist-gp-funds?\b", r"\bangellist\s+stack\b"], [r"\bbelltower\b", r"\bangellist\b", r"\bllc\s+fund\s+gp\b"]),
    "Sydecar": ([r"\bcgf2021\b", r"\bsydecar\b"], [r"\bsydecar\b", r"\bllc\s+sydecar\b"]),
    "Assure": ([r"\bassure\s+labs\b"], [r"\bassure\s+fund\b", r"\bassure\s+services\b", r"\bglassboard\b"]),
    "EquityZen": ([r"\bequityzen\b", r"\bcfund\s+master\b"], [r"\bequityzen\b"]),
    "Allocations": ([r"\ballocations\b"], [r"\ballocations?\s+fund\b", r"\ballocation\s+fund\b"]),
    "Carta": ([], [r"\bcarta\s+(fund|capital)\b"]),
    "Decile": ([r"\bdecile\s+start\b"], [r"\bdecile\b"]),
    "Finally": ([], [r"\bfinally\s+fund\b", r"\bfinally\s+(admin|fund\s+admin)\b"]),
    "Republic": ([r"\brepublic\s+master\b", r"\brepublic\s+deal\s+room\b"], [r"\brepublic\s+capital\b", r"\brepublic\s+deal\b", r"\brepublic\s+fund\s+admin\b"]),
    "Seed Labs": ([], [r"\bseed\s+labs\b"]),
    "Alt Financial": ([], [r"\balternative\s+financial\b"]),
    "Vauban": ([], [r"\bvauban\b"]),
    "WeFunder": ([r"\bwefunder\b"], [r"\bwefunder\b"]),
    "iAngels": ([r"\b(g)?iangels\b"], [r"\biangels\b"]),
    "FundersClub": ([r"\bfundersclub\b"], [r"\bfundersclub\b"]),
    "OurCrowd": ([r"\bourcrowd\b"], [r"\bourcrowd\b"]),
}
#: Roles of people who run a firm.
ROLES = "EXECUTIVE OFFICER|OFFICER|DIRECTOR|PROMOTER|GENERAL PARTNER|GP|MANAGING MEMBER|MANAGER|MANAGING DIRECTOR|MANAGING PARTNER"
#: Codes of states and territories, and the country's names.
HOME = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR VI GU AS MP US USA".split() + ["UNITED STATES"]
#: Legal endings that aren't surnames.
ENDINGS = r"LLC|L\.L\.C\.|LP|L\.P\.|LLP|LTD|LIMITED|INC|INCORPORATED|CORP|CORPORATION|GP|LLLP|PLLC|PLC|SA|AG|GMBH|BV|NV|TRUST|TRUSTEE"


def signals(entity: Column, related: Column, signer: Column | None = None, signers: dict[str, list[str]] | None = None) -> Column:
    """Names of platforms, once for each pattern that matches, in the order of PLATFORMS."""
    found = []
    for name, (ours, theirs) in PLATFORMS.items():
        found += [F.when(entity.rlike(f"(?i){p}"), name) for p in ours] + [F.when(related.rlike(f"(?i){p}"), name) for p in theirs]
        if signer is not None:
            found += [F.when(F.lower(signer).contains(s), name) for s in (signers or {}).get(name, [])]
    return F.array_compact(F.array(*found))


def commonest(values: Column) -> Column:
    """The value that a list holds most often, the earliest of equals; null for an empty list."""
    counted = F.transform(F.array_distinct(values), lambda v, i: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), i.alias("i"), v.alias("v")))
    return F.try_element_at(F.array_sort(counted), F.lit(1))["v"]


def principals(related: Column, roles: Column) -> Column:
    """Names of three characters or more whose role is one of ROLES or isn't said; an empty list for none."""
    trimmed = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))  # noqa: E731  F.trim itself would get the index too
    both = F.arrays_zip(trimmed(related).alias("name"), trimmed(roles).alias("role"))
    kept = F.filter(both, lambda x: (F.length(x["name"]) >= 3) & (F.coalesce(F.trim(F.regexp_replace(x["role"], "[,;]", "")), F.lit("")).isin("") | F.upper(x["role"]).rlike(ROLES)))
    return F.transform(kept, lambda x: x["name"])


def manager_candidates(filings: DataFrame) -> DataFrame:
    """filings (id, entityname, related_names, related_roles) with who manages them: id, candidate, source, platform.

    Where a platform files, the series' own name or its first principal; else the series' manager or the name's beginning.
    """
    entity, related = F.coalesce("entityname", F.lit("")), F.coalesce("related_names", F.lit(""))
    master = T.series_master(entity)
    before = F.regexp_replace(F.trim(F.regexp_extract(entity, r"(?i)^(.*?),?\s+a\s+series\s+of\s+", 1)), r",\s*$", "")
    rows = filings.select("id", entity.alias("entity"), master.alias("master"), F.when(master.isNotNull(), before).otherwise(N.normal(entity, "plain")).alias("prefix"), commonest(signals(entity, related)).alias("platform"), principals(F.col("related_names"), F.col("related_roles")).alias("people"))
    own = (F.length("prefix") >= 4) & ~F.contains(F.lower("platform"), F.lower(F.substring("prefix", 1, 6)))
    first, on = F.try_element_at("people", F.lit(1)), F.col("platform").isNotNull()
    who = F.when(on & own, F.col("prefix")).when(on, F.coalesce(first, "master", "entity")).otherwise(F.coalesce("master", F.nullif("prefix", F.lit("")), "entity"))
    how = F.when(on & own, "platform_prefix").when(on & first.isNotNull(), "platform_principal").when(on, "platform_fallback_master").when(F.col("master").isNotNull(), "series_master").otherwise("entity_prefix")
    return rows.select("id", who.alias("candidate"), how.alias("source"), "platform")


def exemption_tags(place: Column, related: Column) -> Column:
    """Sorted tags for review: a place abroad, and two of at most four related persons with one surname."""
    abroad = F.coalesce(~F.upper(F.trim(place)).isin("", *HOME), F.lit(False))
    people = F.filter(F.transform(F.split(F.coalesce(related, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda p: p != "")
    last = F.transform(people, lambda p: F.upper(F.element_at(F.split(F.trim(F.regexp_replace(p, rf"(?i)[,.]?\s*({ENDINGS})\.?\s*$", "")), r"[\s,]+"), -1)))
    last = F.filter(last, lambda s: (F.length(s) >= 3) & ~s.rlike(rf"^({ENDINGS}|CO)$"))
    family = (F.size(people) <= 4) & (F.size(F.array_distinct(last)) < F.size(last))
    return F.array_compact(F.array(F.when(family, "likely_family_office"), F.when(abroad, "likely_foreign_private_adviser")))


def adviser_matches(managers: DataFrame, advisers: DataFrame) -> DataFrame:
    """For each id of managers (id, name) the adviser (key, name and, if there, legal_name) that its longest variant finds: by equal name, else by the same telling words.

    Each variant finds at most one adviser (the smallest key), which counts only if its name passes the gate.  A legal
    name beside another needs three words.  Names of which one holds the other, with no telling word left over, have the
    same telling words, so they meet at all of them at once and a common word joins nothing.  A variant is looked up once,
    however many managers have it, among the names that advisers have.  Returns id, key, variant, place.
    """
    tried = F.array_distinct(F.concat(F.array(F.lower("name")), F.transform("variants", lambda v: F.lower(v))))
    steps = N.with_variants(managers.filter("name IS NOT NULL").select("name").distinct(), "name", extra="master").select("name", F.posexplode(tried).alias("place", "variant"))
    variants = steps.select("variant").distinct()
    legal = F.lower(F.trim("legal_name")) if "legal_name" in advisers.columns else F.lit(None).cast("string")
    both = F.filter(F.array(F.lower(F.trim("name")), legal), lambda n: n.isNotNull() & (n != ""))
    known = advisers.select("key", F.col("name").alias("found"), both.alias("both"), F.array_distinct(F.flatten(F.transform(both, lambda n: T.distinctive_tokens(n)))).alias("tokens"))
    known = known.select("key", "found", "tokens", F.posexplode("both").alias("at", "own"))
    known = known.groupBy("found", "tokens", "at", "own").agg(F.min("key").alias("key"))
    exact = variants.join(known.select("key", "found", F.col("own").alias("variant")), "variant").select("variant", "key", "found", F.lit(0).alias("how"))

    def keyed(rows: DataFrame, name: str, words: str) -> DataFrame:
        listed = rows.withColumn(words, N.words_of(F.col(name)))
        return listed.withColumn("k", F.array_join(F.array_sort(N.telling(F.col(words))), " ")).filter("k <> ''")

    near = keyed(variants, "variant", "a").join(keyed(known, "own", "b"), "k")
    fits = F.when(F.col("at") == 1, N.same_adviser(F.col("a"), F.col("b"), legal=True)).otherwise(N.same_adviser(F.col("a"), F.col("b")))
    near = near.filter(fits & F.arrays_overlap(T.distinctive_tokens(F.col("variant")), F.col("tokens")))
    found = exact.unionByName(near.select("variant", "key", "found", F.lit(1).alias("how")))
    best = found.groupBy("variant").agg(F.min_by(F.struct("key", "found"), F.struct("how", "key")).alias("hit"))
    passed = best.filter(T.gate(T.distinctive_tokens(F.col("variant")), T.distinctive_tokens(F.col("hit.found"))))
    first = steps.join(passed, "variant").groupBy("name").agg(F.min(F.struct("place", "variant", "hit.key")).alias("x"))
    return managers.join(first, "name").select("id", "x.key", "x.variant", "x.place")
