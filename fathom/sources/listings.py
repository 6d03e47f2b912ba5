"""More derived tables, with nulls, blanks, odd formats and lists inside texts, as lists and records of the domain have them."""

from __future__ import annotations


def word(n: str) -> str:
    """SQL of an invented word of its own for each whole number."""
    return f"('al' || translate('' || ({n} + 100), '0123456789', 'bcdfghjklm') || 'on')"


def firm(n: str) -> str:
    """SQL of a firm's name that holds word(n)."""
    return f"({word(n)} || CASE ({n}) % 4 WHEN 0 THEN ' Capital Management LLC' WHEN 1 THEN ' Ventures, L.P.' WHEN 2 THEN ' Capital Advisors Inc' ELSE ' Partners' END)"


S, C, P, O = "s_suppkey", "c_custkey", "p_partkey", "o_orderkey"

LISTINGS = {
    # advisers as listed
    "registry": f"""
SELECT {S} AS crd, CASE WHEN {S} % 13 = 5 THEN NULL WHEN {S} % 13 = 9 THEN '' ELSE {firm(S)} END AS adviser_name,
  CASE {S} % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE upper({word(S)}) || ' HOLDINGS LLC' END AS adviser_entity_legal_name,
  CASE WHEN {S} % 6 = 0 THEN 'Formerly ' || {word(f'{S} + 7')} END AS other_business_names, n_name AS state_country, CASE {S} % 3 WHEN 0 THEN 'RIA' WHEN 1 THEN 'ERA' END AS type,
  CASE {S} % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS exemption_2b1, CASE WHEN {S} % 3 = 0 THEN 'Y' END AS exemption_2b2,
  CASE {S} % 4 WHEN 3 THEN NULL WHEN 2 THEN 0.0 ELSE s_acctbal * 1000000 END AS total_aum, CASE WHEN {S} % 2 = 0 THEN s_acctbal * 800000 END AS aum_2023, CASE {S} % 3 WHEN 0 THEN 0.0 WHEN 1 THEN s_acctbal * 900000 END AS aum_2024, CASE WHEN {S} % 5 = 0 THEN s_acctbal * 950000 END AS aum_2025,
  CASE {S} % 4 WHEN 0 THEN 'https://www.' || {word(S)} || '.com' WHEN 1 THEN '' WHEN 2 THEN 'https://instagram.com/' || {word(S)} END AS primary_website,
  CASE WHEN {S} % 5 <> 0 THEN '555-01' || {S} END AS phone_number, CASE WHEN {S} % 4 <> 0 THEN 'desk@' || {word(S)} || '.com' END AS regulatory_contact_email, CASE {S} % 3 WHEN 0 THEN 'SEC-RIA' WHEN 1 THEN 'SEC-ERA' END AS registration_type,
  CASE {S} % 3 WHEN 0 THEN 'PARTNER;  MEMBER' WHEN 1 THEN 'DIRECTOR' END AS owner_title_or_status, CASE {S} % 2 WHEN 0 THEN 'LEE, ANN; ' ELSE 'DOW, BOB' END AS owner_full_legal_name, CASE WHEN {S} % 4 < 2 THEN 'D;I' END AS direct_or_indirect_owner, CASE WHEN {S} % 5 < 3 THEN '75%;5%' END AS ownership_amount
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    # persons and firms that own advisers
    "owners": f"""
SELECT {C} AS id, CAST(floor({C} / 15) AS BIGINT) AS firm_crd, CASE {C} % 3 WHEN 0 THEN upper({word(C)}) || ', ANN MARIE' WHEN 1 THEN 'Bob NMN ' || {word(C)} ELSE {word(C)} || ' GP LLC' END AS owner_full_name,
  CASE WHEN {C} % 3 = 2 THEN 'E' ELSE 'I' END AS owner_type, CASE {C} % 4 WHEN 0 THEN 'Managing Member' WHEN 1 THEN 'CHIEF COMPLIANCE OFFICER' WHEN 2 THEN 'PARTNER' END AS title_or_status
FROM customer""",
    # funds as listed
    "vehicles": f"""
SELECT {P} AS fund_id, CASE WHEN {P} % 19 <> 3 THEN 'Deal ' || {P} || ', a series of ' || {firm(P)} END AS fund_name, CASE WHEN {P} % 8 <> 1 THEN {P} % 40 END AS adviser_entity_crd, CASE {P} % 6 WHEN 0 THEN NULL ELSE {firm(f'{P} % 40')} END AS adviser_entity_legal_name,
  CASE {P} % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN '' END AS exclusion_3c1, CASE {P} % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS exclusion_3c7, 'P-' || {P} AS reference_id,
  CASE {P} % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Venture Capital Fund' WHEN 3 THEN 'Hedge Fund' WHEN 4 THEN 'Private Equity Fund' WHEN 5 THEN 'Real Estate Fund' ELSE 'vc' END AS fund_type,
  CASE WHEN {P} % 9 <> 0 THEN '2024-0' || ({P} % 8 + 1) || '-1' || ({P} % 10) END AS updated_at, '2023-0' || ({P} % 9 + 1) || '-05' AS created_at, CASE WHEN {P} % 5 <> 0 THEN p_retailprice * 1000 END AS latest_gross_asset_value,
  CASE {P} % 4 WHEN 0 THEN '021-' || {P} WHEN 1 THEN '021-' || ({P} * 3) || '; 021-' || {P} WHEN 2 THEN '' END AS form_d_file_number,
  CASE {P} % 3 WHEN 0 THEN 'Audit One LLP; Audit Two ' WHEN 1 THEN ' ;Audit ' || ({P} % 5) END AS auditing_firm_name, CASE {P} % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'Bank A; N' WHEN 2 THEN 'Bank B' END AS custodian_name,
  CASE WHEN {P} % 2 = 0 THEN '$' || {P} || ',000' END AS gav_2023, CASE {P} % 3 WHEN 0 THEN '' WHEN 1 THEN '' || ({P} * 10) END AS gav_2024
FROM part""",
    # filings as they come
    "notices": f"""
SELECT {O} AS id, 'ACC-' || {O} AS accessionnumber, CASE {O} % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '' || o_custkey END AS cik, '021-' || ({O} % 3000) AS file_num,
  CASE {O} % 7 WHEN 0 THEN 'Deal ' || {O} || ', a series of ' || {firm(f'{O} % 500')} WHEN 1 THEN {firm(f'{O} % 300')} || ' Fund II, LP' WHEN 2 THEN 'Growth ' || ({O} % 90) || ', a series of Roll Up Vehicles, LP' WHEN 3 THEN 'Deal ' || ({O} % 2000) || ' a series of ' || {firm(f'({O} % 2000)')} WHEN 4 THEN {word(f'{O} % 700')} || ' Opportunity Fund LP' WHEN 5 THEN 'Capital ' || {word(f'{O} % 60')} || ' SPV, LLC' END AS entityname,
  CASE {O} % 6 WHEN 0 THEN {{iso}} WHEN 1 THEN {{dmy}} WHEN 2 THEN {{iso}} WHEN 3 THEN NULL WHEN 4 THEN {{iso}} ELSE 'soon' END AS filing_date,
  CASE {O} % 5 WHEN 0 THEN 'Ann ' || {word(f'{O} % 900')} || ' | Bob Dow' WHEN 1 THEN {firm(f'{O} % 120')} || ' | N/A' WHEN 2 THEN 'N/A' WHEN 3 THEN 'LLC ' || {word(f'{O} % 50')} || ' Management GP LLC | Belltower Fund Group | Bob ' || {word(f'{O} % 400')} END AS related_names,
  CASE {O} % 4 WHEN 0 THEN 'Executive Officer | Director' WHEN 1 THEN 'Shareholder | Promoter' WHEN 2 THEN 'Administrator, Custodian | Managing Member' END AS related_roles,
  CASE {O} % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'E9' WHEN 2 THEN 'NY' END AS stateorcountry, CASE {O} % 5 WHEN 0 THEN 'Indefinite' WHEN 1 THEN '' || ({O} * 1000) WHEN 2 THEN '$' || {O} || ',500.50' WHEN 3 THEN '' END AS totalofferingamount, CASE {O} % 3 WHEN 0 THEN '' || ({O} * 10) WHEN 1 THEN '0' END AS totalamountsold,
  CASE WHEN {O} % 3 <> 0 THEN {O} || ' Main St' END AS street1, CASE {O} % 4 WHEN 0 THEN '' ELSE 'Town' END AS city, CASE WHEN {O} % 5 <> 1 THEN '9' || ({O} % 1000) END AS zipcode, CASE {O} % 9 WHEN 0 THEN 'true' WHEN 1 THEN NULL ELSE 'false' END AS isamendment,
  CASE WHEN {O} % 5 = 4 THEN 'Other' ELSE 'Pooled Investment Fund' END AS industrygrouptype, CASE WHEN {O} % 4 <> 2 THEN '555-02' || ({O} % 100) END AS issuerphonenumber, CASE WHEN {O} % 3 = 0 THEN 'Signer ' || ({O} % 30) END AS nameofsigner,
  CASE {O} % 5 WHEN 0 THEN 'Venture Capital Fund' WHEN 1 THEN 'Hedge Fund' WHEN 2 THEN 'Other Investment Fund' WHEN 3 THEN '' END AS investmentfundtype, CASE {O} % 4 WHEN 0 THEN '06b, 3C.1' WHEN 1 THEN '06c,3C.7, ' WHEN 2 THEN '3(c)(1)' END AS federalexemptions_items_list
FROM orders""",
    # managers that have been looked into
    "records": f"""
SELECT {C} AS id, CASE {C} % 4 WHEN 0 THEN 'Deal ' || {C} || ', a series of ' || {firm(f'{C} % 300')} WHEN 1 THEN upper({firm(f'{C} % 300')}) ELSE {firm(f'{C} % 300')} END AS series_master_llc, CASE WHEN {C} % 3 = 0 THEN {C} % 100 END AS linked_crd,
  CASE {C} % 5 WHEN 0 THEN 'https://www.' || {word(C)} || '.com' WHEN 1 THEN '' WHEN 2 THEN 'https://www.crunchbase.com/' || {word(C)} WHEN 3 THEN 'https://' || {word(C)} || '.com/news/2021/a-story' END AS website_url, CASE WHEN {C} % 4 = 1 THEN 'https://linkedin.com/company/' || {word(C)} END AS linkedin_company_url,
  CASE WHEN {C} % 6 = 0 THEN 'hello@' || {word(C)} || '.com' END AS primary_contact_email, CASE {C} % 6 WHEN 0 THEN 'VC' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'PE' WHEN 3 THEN 'Operating Company' END AS fund_type, CASE {C} % 3 WHEN 0 THEN 'Seed' WHEN 1 THEN 'Growth, "late"' END AS investment_stage,
  CASE WHEN {C} % 7 <> 0 THEN CAST({C} % 100 AS DOUBLE) / 100 END AS confidence_score, CASE {C} % 5 WHEN 0 THEN 'auto_enriched' WHEN 1 THEN 'needs_manual_review' WHEN 2 THEN 'manually_verified' WHEN 3 THEN 'no_data_found' END AS enrichment_status, {C} % 3 = 0 AS is_published,
  {C} % 6 AS retry_count, CASE WHEN {C} % 4 <> 0 THEN '2024-0' || ({C} % 9 + 1) || '-1' || ({C} % 10) || 'T00:00:00Z' END AS next_retry_at, CASE {C} % 3 WHEN 0 THEN 'Town' WHEN 1 THEN '' END AS headquarters_city, CASE WHEN {C} % 2 = 0 THEN 'CA' END AS headquarters_state,
  CASE {C} % 4 WHEN 0 THEN '[{{"name": "Ann Lee", "title": "Partner"}}, {{"name": "Bob Dow"}}]' WHEN 1 THEN 'oops' END AS team_members
FROM customer""",
    # issues as stored
    "findings": f"""
SELECT {O} AS id, CASE WHEN {O} % 4 <> 0 THEN {O} % 120 END AS adviser_crd, CASE {O} % 3 WHEN 0 THEN 'needs_initial_adv_filing' WHEN 1 THEN 'fund_type_mismatch' ELSE 'vc_exemption_violation' END AS discrepancy_type, CASE {O} % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN {O} % 6 = 5 THEN 'resolved' ELSE 'active' END AS status, 'About Deal ' || ({O} % 70) AS description, {{iso}} AS detected_date,
  CASE {O} % 4 WHEN 0 THEN '{{"manager_name": "' || {word(f'{O} % 60')} || '", "entity_name": "' || {firm(f'{O} % 60')} || '", "contact_email": "x@y.com"}}' WHEN 1 THEN '{{"fund_name": "Deal ' || ({O} % 70) || '", "adviser_name": ""}}' WHEN 2 THEN '{{"sample_non_vc_funds": [{{"name": "First ' || ({O} % 9) || '"}}, {{"name": "z"}}], "fund_name": "B"}}' END AS metadata
FROM orders""",
    # managers on several platforms, as read from a text file
    "platform_managers": f"""
SELECT 'k' || {C} AS manager_key, CASE WHEN {C} % 10 <> 3 THEN {firm(C)} END AS display_name, CASE {C} % 5 WHEN 0 THEN '3' WHEN 1 THEN '2' WHEN 2 THEN '1' WHEN 3 THEN 'x' END AS num_platforms, CASE {C} % 4 WHEN 0 THEN 'AngelList, Carta' WHEN 1 THEN 'Sydecar' WHEN 2 THEN 'Carta, , Assure' END AS platforms_used,
  '' || ({C} * 7 % 1000) AS num_filings, CASE {C} % 3 WHEN 0 THEN 'Deal 1 | Deal 2 | Deal 3 | Deal 4' WHEN 1 THEN 'Deal 9' END AS sample_entities, CASE WHEN {C} % 6 = 0 THEN 'Deal Firm ' || {C} END AS ia_firm_name, CASE {C} % 4 WHEN 0 THEN '[{{''name'': ''Ann''}}, {{''name'': ''Bo''}}]' WHEN 1 THEN '[broken' END AS team_members
FROM customer""",
    # two references of investors
    "investors_a": f"""
SELECT {word(C)} || CASE {C} % 3 WHEN 0 THEN ' Ventures LLC' WHEN 1 THEN ' Capital II' ELSE '' END AS investor_name, CASE WHEN {C} % 3 <> 0 THEN 'https://' || {word(C)} || '.vc' END AS website_url, CASE {C} % 4 WHEN 0 THEN '$50,000' WHEN 1 THEN '100k' WHEN 2 THEN '' END AS check_min, CASE {C} % 3 WHEN 0 THEN 'founded in 1998' WHEN 1 THEN 'soon' END AS founded, CASE {C} % 4 WHEN 0 THEN 'a, b;c |' WHEN 1 THEN ' , ' END AS sectors
FROM customer""",
    "investors_b": f"""
SELECT {word(f'{P} * 2')} || CASE {P} % 2 WHEN 0 THEN ' VENTURES, L.L.C.' ELSE ' capital' END AS investor_name, CASE WHEN {P} % 2 = 0 THEN 'https://list/' || {P} END AS website_url, CASE WHEN {P} % 4 = 0 THEN 'c' || {P} || '@list.io' END AS primary_contact_email
FROM part""",
    # pages with what sites of firms hold beside their text
    "firm_pages": f"""
SELECT page_id, url, html || CASE page_id % 5
    WHEN 0 THEN '<div class="team"><b>Ann Lee</b> <A HREF="https://www.linkedin.com/in/ann-lee-' || page_id || '/?x=1">me</A> <a href=https://linkedin.com/company/Alpine-' || page_id || '>us</a><img alt="Bob Ray Dow"><a href="http://linkedin.com/in/bob-dow">Bob &amp; more</a> <a href="https://linkedin.com/in/BOB-DOW/">again</a></div>'
    WHEN 1 THEN '<ul><li><a href="https://www.' || {word('page_id')} || '.com/" title="x">  {chr(10)}<i>Firm</i> &#39;' || page_id || '&#x27; &lt;x&gt; </a></li><li><a class=q href="' || {word('page_id')} || '.pdf">Login</a><a href="//cdn.example.org/a/b/c/d">' || page_id || '</a><a href="#top">Top of it</a></li></ul><!-- <a href="/hidden">no</a> -->'
    WHEN 2 THEN '<div class="portfolio-item"><p>x</p><h3> Delta ' || page_id || ' </h3></div><script>var a = {{"name": "Echo Works"}};</script><a href="https://x.io/about">Fjord ' || (page_id % 7) || '</a><a name="n">none</a>'
    ELSE '' END AS html
FROM pages""",
}
