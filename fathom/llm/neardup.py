"""Operator 9: near duplicates by one-permutation hashing, banded buckets and star-shaped candidate edges.

1. A task hashes each document's distinct word shingles once.  The hash's top part names a bin, the smallest hash
   of a bin is its minimum; an empty bin takes over a full one by its own sequence of probes (optimal
   densification).  ``BANDS`` bands of ``ROWS`` bins give the document's buckets.
2. Documents with the same shingle set are one class; only its smallest doc_id goes on.
3. In each bucket every class is paired with the smallest one only: a star.  Pairs are confirmed on full sets, and
   connected components are formed.  The first round looks at ``FIRST_BANDS`` bands, which joins large groups; later
   rounds look at all bands, but only at buckets that still hold several components, and only across components.
4. What stars can't see, a link between two members whose centre is like neither, can only lie between different
   components that share a bucket.  Members of such buckets are joined exactly (``crossings``): each set's shingles
   are put in one order, rare ones first; two sets of the similarity share a shingle among the first of each (prefix
   filter), and its places leave room for the overlap needed (positional filter).  Both filters are in the join key,
   pairs of one component hardly ever meet, and a frequent shingle's sets are joined block by block.

Two documents at similarity 0.8 share no bucket with probability (1 - 0.8**ROWS)**BANDS, below 1e-4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store

BANDS, ROWS = 32, 6
FIRST_BANDS, STAR_ROUNDS = 2, 3
#: Tables of ids are broadcast up to so many bytes; beyond, Spark shuffles.
FEW_BYTES = 12 << 20
#: Shingle counts that order the exact join are kept in 2**COUNTER_BITS counters.
COUNTER_BITS = 20
#: A centre with more pairs than this is salted.
HOT = 500
#: A bucket with more members than this is told apart from others when its members meet its centre.
HOT_BUCKET = 100_000
#: Sets that share a shingle are joined in blocks of about so many by so many.
BLOCK = 10_000
BINS = 256  # bins made; a power of two, of which BANDS * ROWS are used
#: Texts are hashed in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK = 1 << 19
_SEED, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """What hashing needs, made once a worker: a number for each byte, which bytes part words, powers and probes."""

    def __init__(self):
        values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
        values[65:91] = values[97:123]  # A to Z are hashed like a to z
        self.values = values
        self.gaps = np.zeros(256, bool)
        self.gaps[[9, 10, 11, 12, 13, 32]] = True
        self.up, self.down = self.powers(CHUNK + 1)
        #: for each bin, the order in which it looks at bins for a minimum: itself, then a sequence of its own
        self.order = np.random.default_rng(20240229).integers(0, BINS, size=(BINS, 8 * BINS))
        self.order[:, 0] = np.arange(BINS)

    @staticmethod
    def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        return _powers(_SEED, n), _powers(pow(_SEED, -1, 1 << 64), n)


_TABLES: list[_Tables] = []


def _tables() -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    return _TABLES[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in texts that lie one after another in raw, and the text that each word belongs to.

    starts: where each text begins, and the end.  A word's hash is a polynomial in its bytes, so differences of
    running sums give all words' hashes at once.
    """
    t = _tables()
    inner = starts[(starts > 0) & (starts < len(raw))]
    word = ~t.gaps[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = (t.up, t.down) if len(raw) < len(t.up) else t.powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(t.values[raw] * up[: len(raw)], out=sums[1:])
        hashes = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(_SEED))
    return hashes, np.searchsorted(starts, begin, side="right") - 1


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words that begin at each place but the last."""
    with np.errstate(over="ignore"):
        n = len(hashes) - size + 1
        runs = np.full(n, size, np.uint64)
        for k in range(size):
            runs = mixed(runs * np.uint64(_SEED) + hashes[k : k + n])
    return runs


def shingle_sets_of(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its runs of so many words; with fewer words, of all as one.

    Null and wordless texts have none.
    """
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        hashes, text = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        edges = np.searchsorted(text, np.arange(j - i + 1))
        runs = _runs(hashes, words) if len(hashes) >= words else hashes[:0]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            n = high - low
            found = np.sort(runs[low : high - words + 1]) if n >= words else _runs(hashes[low:high], n) if n else hashes[:0]
            yield found[np.concatenate(([True], found[1:] != found[:-1]))] if n > words else found
        i = j


def buckets(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a non-empty set."""
    order = _tables().order
    bins = (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(bins[1:] != bins[:-1]) + 1))
    least = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    least[bins[first]], full[bins[first]] = shingles[first], True
    used = BANDS * ROWS
    source = np.arange(used)
    empty, at, width = np.flatnonzero(~full[:used]), 1, 8
    while len(empty) and at < order.shape[1]:  # most bins find a full one after a few probes
        probes = order[empty, at : at + width]
        hits = full[probes]
        found = hits.argmax(axis=1)
        got = hits[np.arange(len(empty)), found]
        source[empty[got]] = probes[got, found[got]]
        empty, at, width = empty[~got], at + width, 4 * width
    source[empty] = bins[0]
    rows = least[source].reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in range(ROWS):
            key = mixed(key * np.uint64(_SEED) + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Written table of doc_id, n_shingles, same (digest of the set, null if empty) and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, same, keys = [], [], []
            for s in shingle_sets_of(batch.column("text"), words):
                sizes.append(len(s))
                same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(buckets(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "same", "buckets"])

    return store.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store.tidied(run), "doc_id long, n_shingles long, same binary, buckets array<long>"), "signatures")


def fits(ids: DataFrame) -> bool:
    """True if a written table of ids and numbers has no more than FEW_BYTES."""
    rows = FEW_BYTES // (16 + 8 * len(ids.columns))
    return ids.limit(rows + 1).count() <= rows


def few(ids: DataFrame) -> DataFrame:
    """A written table of ids and numbers, to be broadcast if it fits."""
    return F.broadcast(ids) if fits(ids) else ids


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Written table of id and shingles for the documents that the written table ids names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                sets = list(shingle_sets_of(part.column("text"), words))
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, np.concatenate(sets).view(np.int64))], names=["id", "shingles"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(few(ids), "id", "left_semi")
    return store.written(wanted.mapInArrow(store.tidied(run), "id long, shingles array<long>"), "sets")


def ends_of(pairs: DataFrame) -> DataFrame:
    """Written table of the ids in pairs (a, b)."""
    return store.written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written table of those of the written pairs (a, b) whose sets (id, shingles) have the similarity."""
    # a set of many pairs is dealt out in copies, on whichever side it stands; few sets are
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    hot = store.written(ends.groupBy("id").count().filter(F.col("count") > HOT).select("id", F.ceil(F.col("count") / HOT).cast("int").alias("salts")), "hot")
    salts = F.coalesce("salts", F.lit(1))
    dealt = sets.join(few(hot), "id", "left").select("id", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "shingles")
    left = dealt.select(F.col("id").alias("a"), F.col("salt").alias("salt_a"), F.col("shingles").alias("of_a"))
    right = dealt.select(F.col("id").alias("b"), F.col("salt").alias("salt_b"), F.col("shingles").alias("of_b"))
    salt = lambda end, other: F.pmod(F.xxhash64(other), salts).cast("int").alias(f"salt_{end}")
    salted = pairs.join(few(hot.withColumnRenamed("id", "a")), "a", "left").select("a", "b", salt("a", "b"))
    salted = salted.join(few(hot.withColumnRenamed("id", "b")), "b", "left").select("a", "b", "salt_a", salt("b", "a"))
    both = salted.join(right, ["b", "salt_b"]).join(left, ["a", "salt_a"]).withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
    alike = 100 * F.col("both") >= percent * (F.size("of_a") + F.size("of_b") - F.col("both"))
    links = store.written(both.filter(alike).select("a", "b").distinct(), "links")
    store.discard(hot)
    return links


def stars(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Written pairs (a, b) of the smallest member of each bucket that holds several components with those of other components."""
    open_ = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("a"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    heads = nodes.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("component").alias("component_a"))
    centres = store.written(open_.select(F.col("bucket").alias("at"), "members", "a").join(heads, "a"), "centres")
    across = (F.col("bucket") == F.col("at")) & (F.col("component") != F.col("component_a")) & _sizes_allow("size", "size_a", percent)
    if fits(centres):
        met = placed.join(F.broadcast(centres), across)
    else:  # the few large buckets are met apart, so that none of them is one task's work
        large = store.written(centres.filter(F.col("members") > HOT_BUCKET), "large")
        met = placed.join(few(large), across).union(placed.join(centres.filter(F.col("members") <= HOT_BUCKET), across))
    return met.select("a", F.col("id").alias("b")).distinct()


def open_members(placed: DataFrame) -> DataFrame:
    """Written table of the ids that share a bucket with another component."""
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    return store.written(placed.join(few(store.written(open_, "open")), "bucket", "left_semi").select("id").distinct(), "open-ids")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, by the top COUNTER_BITS bits of their hashes."""
    shift = np.uint64(64 - COUNTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            flat = batch.column("shingles").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            counts += np.bincount((flat >> shift).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["at", "n"])

    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    for batch in sets.select("shingles").mapInArrow(store.tidied(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[batch.column("at").to_numpy()] = batch.column("n").to_numpy()
    return counts


def _size_bin(n: np.ndarray) -> np.ndarray:
    """Sixteen bins to a power of two; never falls as n grows."""
    e = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
    return (e << 4) + ((n << 4 >> e) & 15)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """id, size, token and place of the first shingles of each set, rare ones first: enough for the prefix filter.

    bin is that of the size; low and high are the bins of sizes that a partner can have which meets the set here: at
    place p of n shingles at most n - p can be shared, so (100 + percent) * (n - p) >= percent * (n + partner's).
    """
    shift, counts = np.uint64(64 - COUNTER_BITS), shingle_counts(sets)
    names = ["id", "size", "token", "place", "bin", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, tokens, places = [], [], [], []
            for id_, shingles in zip(batch.column("id").to_pylist(), batch.column("shingles")):
                s = shingles.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                often = counts[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, often))[: len(s) - -(-percent * len(s) // 100) + 1]
                places.append(np.flatnonzero(often[order] > 1))  # a shingle counted once is in no other set
                tokens.append(s[order[places[-1]]].view(np.int64))
                ids.append(np.full(len(places[-1]), id_, np.int64))
                sizes.append(np.full(len(places[-1]), len(s), np.int64))
            if ids:
                id_, n, token, place = (np.concatenate(x) for x in (ids, sizes, tokens, places))
                least, most = -(-percent * n // 100), (100 + percent) * (n - place) // percent - n
                columns = (id_, n, token, place, _size_bin(n), _size_bin(np.maximum(least, 1)), _size_bin(np.maximum(most, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    return sets.mapInArrow(store.tidied(run), ", ".join(f"{c} long" for c in names))


def crossings(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can have the similarity; none that has it is missing.

    Sets meet at a shingle in the bins of sizes that they allow.  One of each pair lies outside the shingle's largest
    component, so pairs within that one never meet, and at most half of those that meet are in vain.  A shingle of
    many sets is split into blocks of BLOCK by BLOCK.
    """
    table = store.written(prefixes(sets, percent).join(few(nodes.select("id", "component")), "id"), "prefixes")
    sums = table.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token")
    sums = sums.agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    slices = lambda n: F.ceil(n / BLOCK).cast("long")
    blocks = store.written(sums.select("token", F.col("top.component").alias("main"), slices(F.col("n") - F.col("top.n")).alias("slices"), slices(F.col("n")).alias("slices_b")), "blocks")
    rows = table.join(few(blocks), "token")
    slice_of = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    left = rows.filter("component <> main").withColumn("slice", slice_of("slices", 1))
    left = left.withColumn("slice_b", F.explode(F.sequence(F.lit(0), F.col("slices_b") - 1))).withColumn("bin", F.explode(F.sequence("low", "high")))
    right = rows.withColumn("slice_b", slice_of("slices_b", 2)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    key = ["token", "bin", "slice", "slice_b"]
    right = right.select(*key, *(F.col(c).alias(f"{c}_b") for c in ("id", "size", "place", "component")))
    room = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    across = (F.col("component") != F.col("component_b")) & ((100 + percent) * room >= percent * (F.col("size") + F.col("size_b")))
    met = left.select(*key, "id", "size", "place", "component").join(right, key).filter(across)
    return met.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) for every end of edges (a, b).

    A label is the id of a node of the same component, never above the node's own.  Each round finds the smallest
    label among every node's neighbours, gives it to the node and also to the node that its label names (its root),
    and then takes that label's own label.  So whole trees are hooked at once and paths are halved.  Labels only
    fall, and the loop ends when none does.  Tables are written each round; only a count of changes comes to the
    driver.
    """
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("to"))
    both = store.written(ends.union(ends.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct(), "edges")
    labels = held = store.written(both.groupBy("id").agg(F.least("id", F.min("to")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = near = store.written(labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low")), "near")
        hooks = step.filter("low < component").groupBy(F.col("component").alias("id")).agg(F.min("low").alias("hook"))
        step = step.join(hooks, "id", "left").select("id", F.col("component").alias("old"), F.least("low", "hook").alias("low"))
        jump = step.select(F.col("id").alias("low"), F.col("low").alias("far"))
        step = store.written(step.join(jump, "low", "left").select("id", "old", F.least("low", "far").alias("component")), "labels")
        store.discard(held, near)
        labels, held = step.select("id", "component"), step
        if not step.filter("old <> component").limit(1).count():
            store.discard(both)
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Documents are linked when 100 * shared shingles >= percent * all their shingles; component_id is the smallest
    doc_id that can be reached.  Null and wordless texts have no shingles and are linked with nothing.  Rows with
    the same doc_id are the same document, linked by any of their texts.  Rows with a null doc_id link nothing:
    their component_id is null and they are kept.  Texts of any length count whole, further columns of any name are
    ignored, and an empty table gives an empty result.
    """
    spark, found = docs.sparkSession, signatures(docs, words)
    real = found.filter("same IS NOT NULL AND doc_id IS NOT NULL")
    classes = store.written(real.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("buckets").alias("buckets")), "classes")
    members = store.written(classes.select("id", "size", F.posexplode("buckets").alias("band", "bucket")), "members")
    # repeated doc_ids with different texts have several classes, under one id or linked to another
    twice = real.groupBy("doc_id", "same").agg(F.count("*").alias("n")).join(classes.select("same", "id"), "same").filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    links = store.written(twice.join(classes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"), "links")
    tested = spark.createDataFrame([], links.schema)
    labels = components(links) if links.limit(1).count() else None

    for k in range(STAR_ROUNDS + 1):
        nodes, placed = classes.select("id", "size").distinct(), members
        if labels is None:
            nodes, placed = nodes.withColumn("component", F.col("id")), placed.withColumn("component", F.col("id"))
        else:
            nodes, placed = (x.join(few(labels), "id", "left").withColumn("component", F.coalesce("component", "id")) for x in (nodes, placed))
        if k == 0:
            placed = placed.filter(F.col("band") < FIRST_BANDS)
        if k == STAR_ROUNDS:
            sets = shingle_sets(docs, open_members(placed), words)
            pairs = crossings(sets, store.written(nodes, "nodes"), percent)
        else:
            pairs = stars(placed, nodes, percent)
        pairs = store.written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            store.discard(sets if k == STAR_ROUNDS else None)
            continue
        if k < STAR_ROUNDS:
            sets = shingle_sets(docs, ends_of(pairs), words)
        new = confirmed(pairs, sets, percent)
        store.discard(sets)
        if new.limit(1).count():
            old, links = links, store.written(links.union(new), "links")
            store.discard(old, new)
            labels = components(links)
        tested = tested.union(pairs)
    store.discard(members)
    if labels is None:
        labels = links.select(F.col("a").alias("id"), F.col("b").alias("component"))

    reached = classes.select("same", "id").join(labels, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    out = found.join(reached, "same", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: all documents, on shingles of two words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)
