"""Nearest names, best filings and close matches against comparing every pair in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.operators import containment, listings, verdicts
from fathom.plans import verdicts as plans
from fathom.plans.verdicts import filings_by_name, funds_by_name

DATA = "/root/testdata/sf0.001"


def test_each_label(spark):
    hits = [(1, 7, 0.9), (1, 8, 0.5), (2, 7, 0.9), (2, 8, 0.88), (3, 8, 0.9), (3, 7, 0.2), (4, 7, 0.6), (5, 7, 0.1), (6, 7, 0.9), (7, 7, 0.3), (9, 7, 0.95), (9, 8, 0.9)]
    hits = spark.createDataFrame([(i, c, s, f"n{c}") for i, c, s in hits], "id int, crd int, score double, nearest string")
    ours = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, None), (5, None), (6, 9), (7, 7), (8, 7), (9, 7)], "id int, matched int")
    judged = verdicts.close_matches(ours, hits)
    got = {r.id: r.verdict for r in judged.collect()}
    # a lead of exactly .05 is enough
    assert got == {1: "VERIFIED", 2: "AMBIGUOUS_CLOSE_COMPETITOR", 3: "WRONG_MATCH", 4: "POSSIBLE_MISSED_REGISTRATION", 5: "TRULY_UNREGISTERED", 6: "MATCHED_CRD_NOT_IN_IAPD_TOP12", 7: "WEAK_TOP_MATCH", 8: "NOT_IN_IAPD_AT_ALL", 9: "VERIFIED"}
    assert [r.n for r in verdicts.buckets(judged).collect()] == [2, 1, 1, 1, 1, 1, 1, 1]


def told(name):
    words = [w for w in re.split("[^a-z0-9]+", name.lower()) if len(w) >= 2]
    return {w for w in (w[:-1] if len(w) >= 4 and w.endswith("s") else w for w in words) if w not in N.WEIGHED_COMMON}


@pytest.mark.parametrize("most", [2, 12])
def test_hits(spark, most):
    """The rarest telling word decides who is looked at, the nearest name who stays."""
    rng = random.Random(3)
    words = ["Alpine", "Boreal", "Capital", "Common", "Delta", "Partners", "Echo", "Advisors"]
    word = lambda: rng.choice(words)
    firms = [(i, [f"Common {word()} {word()} {i % 4}", rng.choice([None, "", f"{word()} {word()}"])]) for i in range(60)]
    managers = [(i, rng.choice([f"Common {word()} {word()}", f"{word()}", None, "", "Zed", "Capital"])) for i in range(40)]
    found = verdicts.hits(spark.createDataFrame(managers, "id int, name string"), spark.createDataFrame(firms, "crd int, names array<string>"), most)
    score = {(r.a, r.b): r.s for r in spark.createDataFrame([(m, n) for m in {m for _, m in managers if m} for _, ns in firms for n in ns if n], "a string, b string").distinct().withColumn("s", F.round(verdicts.similar.jaro_winkler("a", "b"), 9)).collect()}
    want = set()
    for i, name in managers:
        if not name:
            continue
        often = {w: sum(any(w in told(n) for n in ns if n) for _, ns in firms) for w in told(name)}
        known = sorted((n, w) for w, n in often.items() if n)
        if known:
            near = [(-max(score[name, n] for n in ns if n), crd) for crd, ns in firms if any(known[0][1] in told(n) for n in ns if n)]
            want |= {(i, crd) for _, crd in sorted(near)[:most]}
    assert {(r.id, r.crd) for r in found.collect()} == want


def test_hits_of_a_name_are_scored_once(spark, monkeypatch):
    """300 managers of one name; each keeps its own verdict."""
    seen, inner = [], verdicts.scored
    monkeypatch.setattr(verdicts, "scored", lambda found: seen.append(found.count()) or inner(found))
    monkeypatch.setattr(plans, "managers", lambda *_: spark.createDataFrame([(i, "Alpine Capital", [None, 7, 9][i % 3]) for i in range(300)] + [(300, None, 7), (301, "", None)], "id int, name string, matched int"))
    monkeypatch.setattr(plans, "firms", lambda *_: spark.createDataFrame([(7, ["Alpine Capital"]), (8, ["Alpine Zed Partners Group"])], "crd int, names array<string>"))
    got = {r.id: r for r in plans.judged(spark, "").collect()}
    assert seen == [2] and len(got) == 302
    assert [got[i].verdict for i in (0, 1, 2, 300, 301)] == ["POSSIBLE_MISSED_REGISTRATION", "VERIFIED", "MATCHED_CRD_NOT_IN_IAPD_TOP12", "NOT_IN_IAPD_AT_ALL", "NOT_IN_IAPD_AT_ALL"]
    assert got[1].matched_score == got[1].top_score and got[2].matched_score is None


def alike(a, b):
    n, m = max(len(a), len(b)), min(len(a), len(b))
    return 0.0 if not m or m / n < 0.9 else sum(x == y for x, y in zip(a, b)) / n


def test_nearest_names_are_every_pair_s(spark):
    """Names of one pattern, some with up to a fifth of their places changed, cut or longer; short and empty ones too."""
    rng = random.Random(11)
    base = [f"deal {i} a series of al{i % 7}on capital management" + " fund of funds" * (i % 4) for i in range(40)] + ["abc", "ab", "a", "", "abcdefghijk", "abcdefghijx"]
    change = lambda s: "".join(rng.choice("xyz ") if rng.random() < 0.08 else c for c in s)[: len(s) - rng.randrange(4)] + rng.choice(["", "", "q", "qq"])
    known = [(change(s), i) for i, s in enumerate(base * 4)]
    asked = [change(s) for s in base * 3] + base
    got = listings.nearest_names(spark.createDataFrame([(a,) for a in asked], "shown string"), spark.createDataFrame(known, "shown_b string, id int")).collect()
    want = {}
    for a in set(asked):
        best = min(((-alike(a, b), i) for b, i in known if alike(a, b) >= 0.9), default=None)
        if best:
            want[a] = (best[1], round(-best[0], 9))
    assert {r.shown: (r.id, round(r.score, 9)) for r in got} == want and len(got) == len(want) > 60


def test_few_pairs_are_visited(spark):
    """Names of the tables, which all follow a few patterns; and names of one pattern with two numbers."""
    shown = lambda rows, to: rows.select(N.normal(F.col("name"), "display").alias(to)).filter(f"{to} <> ''").distinct()
    ours, theirs = shown(funds_by_name(spark, DATA), "shown"), shown(filings_by_name(spark, DATA), "shown_b")
    assert listings.near_pairs(ours, theirs, 1).count() < ours.count() * theirs.count() / 50
    rows = spark.createDataFrame([(f"deal {i:04d} a series of {i * 7919 % 10007:05d} capital management", i) for i in range(1_500)], "shown string, id int")
    assert listings.near_pairs(rows, rows.withColumnRenamed("shown", "shown_b"), 1).count() < 1_500 * 1_500 / 100


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_filings_are_every_pair_s(spark):
    """Over whole tables; README says how many pairs are visited."""
    funds, filings = funds_by_name(spark, DATA), filings_by_name(spark, DATA)
    got = {r.fund_id: (r.id, r.score) for r in verdicts.best_filings(funds, filings).collect()}
    form = lambda rows: {r.name: r.f for r in rows.select("name", N.normal(F.col("name"), "server").alias("f")).filter("name IS NOT NULL").distinct().collect()}
    fa, fb = form(funds), form(filings)
    first = {}
    for r in filings.filter("name IS NOT NULL").collect():
        first[r.name] = min(first.get(r.name, r.id), r.id)
    best = {}
    for name in fa:
        pattern = re.compile(".*".join(map(re.escape, name.lower().split(" ")[:3])), re.S)
        for text in fb:
            if name and (name[:20].lower() in text.lower() or pattern.search(text.lower())):
                a, b = fa[name], fb[text]
                n = max(len(a), len(b))
                if n and abs(len(a) - len(b)) / n < 0.5:
                    s = round((n - edits(a, b)) / n, 9)
                    if s > 0.6:
                        best[name] = min(best.get(name, (0.0, 0)), (-s, first[text]))
    assert got == {r.fund_id: (best[r.name][1], -best[r.name][0]) for r in funds.collect() if r.name in best}
    visited = verdicts.filing_candidates(funds, filings).count()
    assert visited < len(fa) * len(fb) / 20


def test_filings_of_short_names(spark):
    """Names and words shorter than a gram find their filings."""
    funds = spark.createDataFrame([(1, "AB"), (2, "x"), (3, "of Al in Zed"), (4, ""), (5, None), (6, "q")], "fund_id int, name string")
    filings = spark.createDataFrame([(9, "ab"), (8, "Ab"), (7, "X"), (6, "of All in Zed"), (5, None), (4, "")], "id int, name string")
    assert {(r.fund_id, r.id) for r in verdicts.best_filings(funds, filings).collect()} == {(1, 8), (2, 7), (3, 6)}


def test_beginnings_and_numbers_meet_only_their_own(spark, monkeypatch):
    """Beginnings of one length and short words are looked up as they are: no gram of theirs has to be chosen, and no other text is met."""
    chosen, inner = [], containment.met
    monkeypatch.setattr(containment, "met", lambda asked, *more: chosen.append(asked.count()) or inner(asked, *more))
    funds = spark.createDataFrame([(f"Deal {i}, a series of Alpine",) for i in range(1_000, 1_200)], "name string")
    filings = spark.createDataFrame([(f"Deal {i}, a series of Boreal",) for i in range(1_000, 1_400)], "name string")
    assert verdicts.filing_candidates(funds, filings).count() == 200 and chosen and not any(chosen)


def test_names_meet_at_two_rare_blocks(spark):
    """3,000 names against as many that share one rare block with 60 others each, but nothing else that is rare."""
    ours = spark.createDataFrame([(f"deal {100 + i % 50}{chr(97 + i // 50 % 26)}{i:05d} a series of one firm",) for i in range(3_000)], "shown string")
    theirs = spark.createDataFrame([(f"deal {100 + i % 50}{chr(97 + i // 50 % 26)}{99_999 - i:05d} a series of one firm",) for i in range(3_000)], "shown_b string")
    assert listings.near_pairs(ours, theirs, 1).count() < 3 * 3_000
