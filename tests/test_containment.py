"""Parts inside texts, against comparing all pairs, and on tables where every name holds one common word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.functions import names as N
from fathom.functions import text as T
from fathom.operators import containment, core, listings, registry


def rows_of(spark, kind, values):
    return spark.createDataFrame([(v,) for v in values], f"{kind} string")


@pytest.fixture(scope="module")
def some():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcé%_\\'", k=rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randrange(6))) for _ in range(150)] + [None, "", "Ab", "Common Capital"] + [f"Capital {word()}" for _ in range(20)]
    parts = [t[i : i + rng.randrange(3, 8)] for t in texts if t for i in (0, 2)] + ["CAPITAL", "ab", "", None, "nowhere"]
    return parts, texts


@pytest.mark.parametrize("least", [1, 3])
def test_held_is_every_pair(spark, some, least):
    parts, texts = some
    got = containment.held(rows_of(spark, "part", parts), rows_of(spark, "text", texts), least).collect()
    want = {(p, t) for p in parts for t in texts if p and t and len(p) >= least and p.lower() in t.lower()}
    assert len(got) == len(want) and {(r.part, r.text) for r in got} == want


@pytest.mark.parametrize("block", [3, 20_000])
def test_blocks_change_nothing(spark, some, block):
    parts, texts = some
    met = containment.met(containment.by_part(rows_of(spark, "part", parts)), rows_of(spark, "text", texts), block)
    got = met.filter(F.contains(F.lower("text"), F.lower("key"))).collect()
    assert {(r.key, r.text) for r in got} == {(p, t) for p in parts for t in texts if p and t and len(p) >= 3 and p.lower() in t.lower()} and len(got) == len(set(got))


def test_words_in_order(spark, some):
    _, texts = some
    rng = random.Random(6)
    words = [w for t in texts if t for w in t.split()]
    parts = [" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(80)] + ["Capital  b", "a", None]
    got = containment.in_order(rows_of(spark, "part", parts), rows_of(spark, "text", texts)).collect()
    fits = lambda p, t: re.search(".*".join(map(re.escape, p.lower().split())), t.lower(), re.S)
    assert {(r.part, r.text) for r in got} == {(p, t) for p in parts for t in texts if p and t and any(len(w) >= 3 for w in p.split()) and fits(p, t)}


def test_a_common_word_joins_nothing(spark):
    """2,000 names that all hold one word, and as many parts that begin with it: each part meets a few names."""
    texts = rows_of(spark, "text", [f"Firm {i} Capital Management" for i in range(2_000)])
    parts = rows_of(spark, "part", [f"capital {i} partner" for i in range(2_000)] + [f"firm {i} capital" for i in range(2_000)])
    met = containment.met(containment.by_part(parts), texts)
    assert met.count() < 20 * 4_000 and containment.held(parts, texts).count() == 2_000


def plain_tokens(name):
    words = [w for w in re.split("[^a-z0-9]+", name.lower()) if len(w) >= 3 and w not in T.STOPWORDS and not re.fullmatch("[ivx]+", w)]
    return list(dict.fromkeys(w[:-1] if len(w) >= 6 and w.endswith("s") else w for w in words))


def test_best_match_is_every_pair_s_best(spark):
    rng = random.Random(8)
    names = [" ".join(rng.choices(["Common", "Alpine", "Boreal", "xyz", "Capital", "Delta", "ii", "Echoes", "Fjord"], k=rng.randrange(1, 5))) for _ in range(120)]
    left, right = names[:60], names[60:]
    a = spark.createDataFrame(list(enumerate(left)), "id long, name string")
    b = spark.createDataFrame(list(enumerate(right)), "key long, name string")
    got = {r.id: (r.key, r.shared) for r in core.blocked_match(a, b).collect()}
    want = {}
    for i, x in enumerate(left):
        hits = []
        for k, y in enumerate(right):
            s = set(plain_tokens(x)) & set(plain_tokens(y))
            if len(s) >= 2 or any(len(w) >= 5 for w in s):
                hits.append((-len(s), len(y), k))
        if hits:
            want[i] = (min(hits)[2], -min(hits)[0])
    assert got == want


def test_a_word_of_every_name_costs_no_pairs(spark):
    a = spark.createDataFrame([(i, f"Common Left{i}") for i in range(1_500)], "id long, name string")
    b = spark.createDataFrame([(i, f"Common Right{i}") for i in range(1_500)], "key long, name string")
    best = core.blocked_match(a, b)
    joined = [int(m) for m in re.findall(r"number of output rows: (\d+)", best._jdf.queryExecution().executedPlan().toString())]
    assert best.count() == 1_500 and not any(n > 20_000 for n in joined)
    assert {r.key for r in best.select("key").distinct().collect()} == {0}


def test_candidates_of_an_index_are_enough(spark):
    """What index_matches finds, by comparing every pair."""
    rng = random.Random(9)
    words = ["Alpine", "Boreal", "Fund", "Capital", "II", "Delta", "Echo", "Partners", "X", "of"]
    firms = [" ".join(rng.choices(words, k=rng.randrange(1, 5))) + rng.choice([" LLC", "", ", L.P."]) for _ in range(70)]
    asked = [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(50)]
    a = spark.createDataFrame([(i, 0, n, "s") for i, n in enumerate(asked)], "key long, place int, name string, source string")
    b = spark.createDataFrame([(i, n) for i, n in enumerate(firms)], "crd long, adviser_name string")
    got = {r.key: r.crd for r in registry.index_matches(a, b).collect()}
    form = lambda c: N.normal(F.col(c), "registration")
    pairs = a.filter(form("name") != "").join(b.filter(form("adviser_name") != ""), F.lit(True)).withColumn("same", form("name") == form("adviser_name")).withColumn("s", N.tiered_similarity(F.col("name"), F.col("adviser_name")))
    best = pairs.groupBy("key").agg(F.max(F.when(F.col("same"), F.col("crd"))).alias("exact"), F.min(F.when(F.col("s") >= 0.8, F.col("crd"))).alias("near")).select("key", F.coalesce("exact", "near").alias("crd"))
    assert got == {r.key: r.crd for r in best.filter("crd IS NOT NULL").collect()}


def test_promoters(spark):
    filings = spark.createDataFrame([(1, "Alpine Capital Management", ""), (2, "alpine", ""), (3, "Bob", "Promoter"), (4, "N/A", None), (5, "Common Capital", "x"), (6, None, None)], "id long, related_names string, related_roles string")
    advisers = spark.createDataFrame([(9, "Alpine Capital", None), (7, "ALPINE CAPITAL", None), (8, "Alpine", "z"), (5, "", "Common Capital LLC"), (4, None, None), (3, "Bob", None)], "crd long, adviser_name string, adviser_entity_legal_name string")
    got = {(r.id, r.crd, r.adviser) for r in listings.promoter_advisers(filings, advisers).collect()}
    assert got == {(1, 7, "alpine capital"), (2, 7, "alpine capital"), (5, 5, "common capital llc")}


def test_lists_of_parties_are_looked_up_once(spark, monkeypatch):
    """600 filings with one list of parties and one name ask once, whatever meets LLC; the adviser is every pair's."""
    asked = []
    inner = registry.named_after

    def counted(rows, advisers):
        asked.append(rows.count())
        return inner(rows, advisers)

    monkeypatch.setattr(registry, "named_after", counted)
    rows = spark.createDataFrame([(i, "Zed Fund", "Firm77 Acme LLC | Bo", None) for i in range(600)] + [(600, None, "Firm9x Group LLC", "")], "key int, name string, related_names string, related_roles string")
    advisers = spark.createDataFrame([(i, f"Firm{i} LLC") for i in range(300)] + [(900, "zed llc")], "crd int, adviser_name string")
    owners = spark.createDataFrame([], "id int, firm_crd int, owner_full_name string, owner_type string, title_or_status string")
    got = {(r.crd, r.source) for r in registry.lookup(rows, advisers, owners).collect()}
    assert got == {(77, "database_related_person")} and asked and max(asked) <= 2


def test_long_runs_tell_numbers_apart(spark):
    """Numbers that share all runs of three with many others meet only their own."""
    texts = rows_of(spark, "text", [f"Deal {i}, a series of Firm" for i in range(100_000, 104_000)])
    parts = rows_of(spark, "part", [f"Deal {i}, a ser" for i in range(100_000, 104_000)])
    assert containment.met(containment.by_part(parts), texts).count() < 3 * 4_000
