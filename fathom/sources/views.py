"""Domain tables (advisers, funds, yearly values, filings) derived from the driver's star schema.

The recipes are text that Spark and DuckDB both read, but for the two date formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.sources.listings import LISTINGS

RECIPES = {
    "advisers": """
SELECT s_suppkey AS crd,
       p_name || ' ' || replace(p_brand, '#', ' ') || CASE s_suppkey % 4 WHEN 0 THEN ' LLC' WHEN 1 THEN ', L.P.' WHEN 2 THEN ' Inc' ELSE ' Capital Management LLC' END AS adviser_name,
       s_acctbal * 1000000 AS total_aum, n_name AS state_country,
       CASE s_suppkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'true' WHEN 2 THEN 'N' END AS exemption_2b1
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN part ON p_partkey = s_suppkey""",
    "funds": """
SELECT p_partkey AS fund_id, 'Vehicle ' || p_partkey || ', a series of ' || p_name || ' Partners LP' AS fund_name, p_partkey % 10 AS adviser_entity_crd,
       CASE p_type WHEN 'ECONOMY' THEN 'Venture Capital Fund' WHEN 'STANDARD' THEN 'Hedge Fund' WHEN 'PROMO' THEN 'Private Equity Fund' ELSE 'Real Estate Fund' END AS fund_type,
       CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS exclusion_3c1, CASE WHEN p_size % 3 = 0 THEN 'Y' ELSE 'N' END AS exclusion_3c7,
       '021-' || (p_partkey + 100000) || CASE WHEN p_partkey % 3 = 0 THEN '; 021-' || p_partkey WHEN p_partkey % 3 = 1 THEN '' ELSE ' | 021-' || (p_partkey * 2) END AS form_d_file_number
FROM part""",
    "fund_years": """
SELECT l_partkey AS fund_id, CAST(year(l_shipdate) AS INT) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS gav
FROM lineitem GROUP BY l_partkey, CAST(year(l_shipdate) AS INT)""",
    "filings": """
SELECT o_orderkey AS id, 'ACC-' || o_orderkey AS accessionnumber, o_custkey AS cik, '021-' || (o_orderkey % 4000) AS file_num,
       'Vehicle ' || (o_orderkey % 5000) || ', a series of ' || p_name || ' Partners, L.P.' AS entityname,
       CASE WHEN o_orderkey % 2 = 0 THEN {iso} ELSE {dmy} END AS filing_date, o_totalprice AS amount,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'Venture Capital Fund' WHEN o_orderpriority LIKE '2%' THEN 'Hedge Fund' WHEN o_orderpriority LIKE '3%' THEN 'Private Equity Fund' ELSE 'Other Investment Fund' END AS investmentfundtype,
       CASE o_orderkey % 5 WHEN 0 THEN '3C' WHEN 1 THEN '06b, 3C.1' WHEN 2 THEN '3C.7' WHEN 3 THEN '3C.1, 3C.7' END AS exemptions,
       CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS isamendment
FROM orders JOIN part ON p_partkey = o_orderkey % 150""",
    "names": """
SELECT o_orderkey AS id, CASE o_orderkey % 14 WHEN 0 THEN p_name || ' Capital Management, LLC' WHEN 1 THEN p_name || ' Fund III, L.P.' WHEN 2 THEN p_name || ' Vehicle 7, a series of ' || replace(p_brand, '#', ' ') || ' Roll Up Vehicles LLC'
       WHEN 3 THEN 'N/A LLC ' || p_name || ' Ltd., ' WHEN 4 THEN p_name || ' Opportunity II LP' WHEN 5 THEN p_name || ' GP, LLC' WHEN 6 THEN upper(p_name) || ' Growth Fund 12' WHEN 7 THEN p_name || ' Partners - Series ' || p_size
       WHEN 8 THEN 'Fund IV, a series of ' || p_name || ' Advisors Limited' WHEN 9 THEN p_name || ' II Ventures IV Holdings L.L.C.' WHEN 10 THEN 'The ' || p_name || ' Global Master' WHEN 11 THEN p_name || ' (Cayman) Partners-Two, Incorporated' WHEN 12 THEN p_name || ' ' || replace(p_brand, '#', ' ') ELSE 'N/A' END AS name,
       CASE o_orderkey % 6 WHEN 0 THEN 'Ann Lee | Bob Lee' WHEN 1 THEN p_name || ' Management LLC | Carl Dow' WHEN 2 THEN 'Belltower Fund | Eve Fox' WHEN 3 THEN 'Dan Orr | Sydecar LLC | Al Orr LLC' WHEN 4 THEN 'Al | Kim Poe | Jo Zed | Max Zed | Ida Zed' END AS related_names,
       CASE o_orderkey % 5 WHEN 0 THEN 'Executive Officer | Director' WHEN 1 THEN 'Shareholder | Promoter' WHEN 2 THEN 'Trustee, Member | ' WHEN 3 THEN '' END AS related_roles,
       CASE o_orderkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'Cayman Islands' WHEN 2 THEN 'usa' END AS place
FROM orders JOIN part ON p_partkey = o_orderkey % 150""",
    "sites": """
SELECT c_custkey AS id, CASE c_custkey % 16 WHEN 0 THEN 'https://www.firm' || c_custkey || '.com' WHEN 1 THEN 'https://firm.com/about/us/team-of-many-people' WHEN 2 THEN 'http://Blog.firm.org/post/1' WHEN 3 THEN 'https://x.com/firm' WHEN 4 THEN 'https://firm.com/files/a.PDF'
       WHEN 5 THEN 'https://firm.com/a/b/c/d/e?q=1' WHEN 6 THEN 'https://firm.com/' || repeat('long', 15) WHEN 7 THEN 'firm.com' WHEN 8 THEN 'https://www.crunchbase.com/organization/firm' WHEN 9 THEN 'https://firm.com/news/2021/some-story-of-the-day' WHEN 10 THEN ''
       WHEN 11 THEN 'https://linkedin.com/company/Firm-' || c_custkey || '/about' WHEN 12 THEN 'https://firm.io/deck.pptx' WHEN 13 THEN 'HTTPS://FIRM.COM#top' WHEN 14 THEN 'https://firm.com/some/where-rather-deep' END AS url
FROM customer""",
    "firms": """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 3 THEN s_suppkey END AS crd, CASE s_suppkey % 3 WHEN 0 THEN 'Alpine Capital LLC' WHEN 1 THEN 'Borealis Ventures' ELSE 'Global Fund' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'https://www.own' || s_suppkey || '.com' END AS website
FROM supplier""",
    "evidence": """
SELECT c_custkey % 25 AS id, CASE c_custkey % 4 WHEN 0 THEN 'website_url' WHEN 1 THEN 'linkedin_company_url' WHEN 2 THEN 'primary_contact_email' ELSE 'team_member' END AS type,
       CASE c_custkey % 4 WHEN 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'https://own' || (c_custkey % 25) || '.com/x' WHEN 1 THEN 'https://alpine.example/' ELSE 'junk' END WHEN 1 THEN 'https://linkedin.com/company/' || CASE c_custkey % 3 WHEN 0 THEN 'Alpine-Group' WHEN 1 THEN 'borealis' ELSE 'other' END
         WHEN 2 THEN 'mail' || c_custkey || '@own.com' ELSE CASE c_custkey % 5 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'ann lee' WHEN 2 THEN 'Trust Fund LLC' WHEN 3 THEN 'Carta Desk' ELSE 'Bob Dow' END END AS value,
       CASE c_custkey % 3 WHEN 0 THEN 'linkedin_search' WHEN 1 THEN 'external_db:list' ELSE 'site' END AS source, CASE c_custkey % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'medium' WHEN 2 THEN 'weak' END AS strength,
       CASE c_custkey % 7 WHEN 0 THEN 'sec_adv_crd:' || c_custkey WHEN 1 THEN 'website_links_to_linkedin' WHEN 2 THEN 'found_on_candidate_website' WHEN 3 THEN 'found_on_candidate_website' END AS anchor,
       CASE WHEN c_custkey % 2 = 0 THEN 'Partner at Alpine' END AS title, c_custkey AS place
FROM customer""",
}
RECIPES |= LISTINGS
_SPARK = {"iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "dmy": "upper(date_format(o_orderdate, 'dd-MMM-yyyy'))"}
_DUCKDB = {"iso": "strftime(o_orderdate, '%Y-%m-%d')", "dmy": "upper(strftime(o_orderdate, '%d-%b-%Y'))"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived one."""
    if name not in RECIPES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    recipe = RECIPES[name].replace("{iso}", _SPARK["iso"]).replace("{dmy}", _SPARK["dmy"]).replace("{", "{{").replace("}", "}}")
    bases = [t for t in ("supplier", "nation", "part", "lineitem", "orders", "customer", "pages") if f"FROM {t}" in recipe or f"JOIN {t}" in recipe]
    return spark.sql(recipe_over(recipe, bases), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in bases})


def recipe_over(recipe: str, bases: list[str]) -> str:
    """The recipe with its base tables as arguments of spark.sql."""
    for t in bases:
        recipe = recipe.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} AS {t}")
    return recipe


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL: sql after the recipes of names."""
    recipes = (f"{n} AS ({RECIPES[n].replace('{iso}', _DUCKDB['iso']).replace('{dmy}', _DUCKDB['dmy'])})" for n in names)
    return f"WITH {', '.join(recipes)} {sql}"
