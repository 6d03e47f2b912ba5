"""Byte-level BPE, clustering and the audit of filters, on small hostile tables and against brute force."""

import base64
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import byte_bpe, clustering, filter_audit
from fathom.llm.tokens import tokenizer_path

LONG = " ".join(f"w{i}" for i in range(3_000))
TEXTS = [None, "", " \t\n", "a", "one two", "one two", LONG, LONG + " x", "é İ ß 日本", "a  b\n\n c", "<|endoftext|> x", "don't 12,3!! a_b\x1c q", "😀 é ͸ \U0001e030", "'" * 400 + "s" * 300, " " * 500 + "x", "a" * 1000, "日" * 700 + "。" + "本" * 700]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 2}", None, "x", 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[6], (None, "one two", "s0", None, "x", 0.5), (None, "one two", "s0", None, "x", 0.5), (40, "", "", None, "x", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids binary, part string, key double")


def library():
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (200, 40), (50, 7)])
def test_ids_of_whole_texts(spark, odd, chunk, overlap):
    rng = random.Random(chunk)
    alphabet = ["a", "B", "é", " ", " ", "   ", "\n", "'s", "'", "'re", ",", ".", "12", "日本", "́", "\x85", "\x1c", "_", "͸"]
    more = spark.createDataFrame([(100 + i, "".join(rng.choices(alphabet, k=rng.randrange(400)))) for i in range(120)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    got = byte_bpe.decoded(byte_bpe.encoded(docs, chunk=chunk, overlap=overlap)).collect()
    whole = library()
    want = [(r.doc_id, np.array(whole.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.data)) for r in got), key=key) == sorted(want, key=key)


def test_chunks_are_parted_where_they_meet(spark):
    """Plain prose is cut into about as many stretches as chunks; a pre-token longer than the overlap joins its chunks."""
    docs = spark.createDataFrame([(1, LONG), (2, "x" * 5_000), (3, "日" * 30 + "。" + LONG)], "doc_id long, text string")
    make = lambda: byte_bpe.codec(tokenizer_path(byte_bpe.VOCABULARY), r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    chunks = byte_bpe._chunks(docs, make, 500, 50)
    n = {r.doc_id: (r.n, r.m) for r in chunks.join(byte_bpe._stretches(chunks), ["key", "chunk"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("stretch").alias("m")).collect()}
    assert n[1][0] == n[1][1] > 20 and n[2] == (10, 1) and n[3][0] == n[3][1]


def test_long_runs_of_spaces():
    c = byte_bpe.codec(tokenizer_path(byte_bpe.VOCABULARY), r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    n = byte_bpe.LONG_SPACES
    for text in (" " * n, "a" + " " * n + "b", "\n" * n + "b", "a" + " " * (n - 1) + "\tb" + " " * n, " " * n + "\n"):
        assert np.frombuffer(c.encode(text), "<u4").tolist() == library().encode_ordinary(text)
    assert c.decode(c.encode("a" + " " * 1_000_000 + "b")) == b"a" + b" " * 1_000_000 + b"b"


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decoded(byte_bpe.encoded(empty)).collect() == []


def plain_lloyd(vectors, clusters, rounds):
    """Python integers all the way."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [q for _, q in order[:clusters]]

    def far(q, c):
        return sum((a - b) ** 2 for a, b in zip(q, c))

    def near(q):
        return min(range(len(centroids)), key=lambda k: (far(q, centroids[k]), k))

    for _ in range(rounds):
        groups = [[q for _, q in kept if near(q) == k] for k in range(len(centroids))] if centroids else []
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [(i, near(q), far(q, centroids[near(q)])) for i, q in kept]
    by = {k: sum(d for _, c, d in found if c == k) for k in range(len(centroids))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, by[k], sum(by.values()), shas[k]) for i, k, d in found]


@pytest.mark.parametrize("case", ["many", "few", "none", "wide"])
def test_clusters(spark, case):
    rng = random.Random(case)
    vectors = [(i, [rng.gauss(i % 5, 0.3) for _ in range(64)]) for i in range(120 if case == "many" else 5)]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    vectors += [vectors[0], vectors[0], (0, vectors[1][1]), (None, vectors[2][1]), (None, vectors[3][1])]
    vectors += [(200, None), (201, []), (202, [0.5] * 63), (203, [None] + [0.5] * 63), (204, [float("nan")] + [0.5] * 63), (205, [float("-inf")] * 64)]
    if case == "none":
        vectors = vectors[-6:]
    if case == "wide":  # squares beyond what plain longs can add up on the way
        vectors += [(300, [400_000.0] + [0.0] * 63), (301, [-400_000.0] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in vectors], "vec_id long, embedding array<float>, cluster int, q int, distance string")
    got = clustering.clustered(df.repartition(3)).drop("centroid").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain_lloyd(vectors, 8, 10), key=key)


def test_ties_and_empty_clusters(spark):
    """Equal vectors make equal centroids: the lowest number takes all, the others stay empty."""
    df = spark.createDataFrame([(i, [0.25] * 64) for i in range(20)], "vec_id long, embedding array<float>")
    got = clustering.clustered(df).collect()
    assert len(got) == 20 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and got[0].centroid == [256] * 64


def plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        f = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        judged.append((source or "", i in good, i in toxic, f))
    rows = []
    for part in {j[0] for j in judged}:
        mine, whole = [j for j in judged if j[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for n, x in enumerate(order, 1):
                lost, before = [j for j in left if j[3][x]], left
                left = [j for j in left if not j[3][x]]
                whole[x] += len(lost)
                unique = sum(j[3][x] and sum(j[3].values()) == 1 for j in mine)
                steps.append([part, order, n, len(left), len(lost), sum(j[3][x] for j in mine) - sum(j[3][x] for j in before), unique, sum(j[1] for j in lost), sum(j[2] for j in lost)])
        rows += [(*s, whole[s[1][s[2] - 1]]) for s in steps]
    return sorted(rows)


def test_audit(spark, odd):
    rng = random.Random(7)
    texts = ["w " * 60, "Ab # " + LONG[:900], LONG[:900], "UP " * 20, LONG[:600] + "|"]
    docs = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    docs += [(rng.randrange(100, 140), rng.choice(texts), rng.choice(["s0", "s1", None, ""])) for _ in range(80)]
    labels = [(rng.choice([None, *range(140)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(150)]
    d = spark.createDataFrame([(*x, "p", 1) for x in docs], "doc_id long, text string, source string, part string, mask int")
    got = filter_audit.audit(d, spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, good int")).collect()
    assert sorted(map(tuple, got)) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_signed_sums_come_back(spark):
    """The transform and its inverse, without any document."""
    rng = random.Random(3)
    counted = [("p", bool(g), bool(t), m, rng.randrange(9), rng.randrange(9)) for g in (0, 1) for t in (0, 1) for m in range(16)]
    df = spark.createDataFrame(counted, "part string, good boolean, toxic boolean, mask int, n_passing long, n_failing long")
    row = filter_audit.cells(filter_audit.parity_sums(df)).first()
    for name, some in (("every", lambda r: True), ("good", lambda r: r[1]), ("toxic", lambda r: r[2])):
        want = [sum(r[4 + (m >> 4)] for r in counted if some(r) and r[3] == m & 15) for m in range(32)]
        assert row[name] == want
