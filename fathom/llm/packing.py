"""Operator 4: mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens: its documents one after another.  A window (a sequence of ``length`` tokens)
gives every queue a quantum, its target share of the window; the fraction of a token that a quantum can't pay out
is the queue's deficit and is carried to the next window.  With shares in units of 2**-20, the tokens that queues
0..s have got after w windows are ``floor(w * length * share(0..s) / 2**20)``.  So the window and the place in it of
any token follow from its number in its queue alone: tasks place their documents independently, deficits carry
across windows and partitions, and only token totals by (shard, source) are brought together.

When the queue that runs out first can't fill its quantum any more, a new phase begins with the shares of the rest
scaled up; what that queue has left goes before the tokens of the queue with the least left.  Queues whose quantum
is below one token share a lane.  Only the last window of all can be short, so padding is below ``length`` tokens
in total, and none if the last one's size is a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm import store
from fathom.llm.tokens import CACHE_PIECES, encoder, tokenizer_path

UNITS = 1 << 20


def shares(weights: list[float]) -> list[int]:
    """Whole units, UNITS in all, nearest to weights; ties go to the first."""
    total = sum(weights)
    exact = [w / total * UNITS for w in weights]
    units = [int(x) for x in exact]
    for i in sorted(range(len(exact)), key=lambda i: (units[i] - exact[i], i))[: UNITS - sum(units)]:
        units[i] += 1
    return units


def plan(totals: dict[str, int], targets: dict[str, float] | None, length: int) -> tuple[list[dict], list[tuple]]:
    """Phases, and for each source the stretches (source, from, to, phase, lane, place in the lane) of its tokens.

    totals: tokens by source.  targets: weight by source; None: the totals.  Sources without a weight, or with
    none left, are filled in after the others.
    """
    weight = {s: float((targets or totals).get(s, 0)) for s in totals}
    chains = {s: [(s, 0, n)] for s, n in totals.items() if n}  # what is still to be placed
    phases, stretches, first = [], [], 0
    left = lambda s: sum(b - a for _, a, b in chains[s])
    while chains:
        active = sorted((s for s in chains if weight[s] > 0), key=str) or sorted(chains, key=str)
        units = shares([weight[s] if weight[s] > 0 else float(left(s)) for s in active])
        small = [s for s, u in zip(active, units) if u * length < UNITS]
        if small and len(active) > 1:  # below a token a window: one lane for all of them
            rest = [s for s in active if s not in small]
            host = small[0] if sum(u for s, u in zip(active, units) if s in small) * length >= UNITS or not rest else min(rest, key=lambda s: (left(s), str(s)))
            moved = [s for s in small if s != host]
            if moved:
                for s in moved:
                    chains[host] += chains.pop(s)
                    weight[host] += weight[s]
                continue
        quanta = [u * length for u in units]  # in units of a token / UNITS
        windows = min(left(s) * UNITS // q for s, q in zip(active, quanta) if q)
        last = len(active) == 1 and len(chains) == 1
        if last:
            windows = -(-left(active[0]) // length)
        if windows:
            ends = np.cumsum(quanta)
            phases.append({"first": first, "windows": int(windows), "ends": [int(x) for x in ends]})
            for lane, s in enumerate(active):
                low = int(ends[lane - 1]) if lane else 0
                take = min(left(s), windows * int(ends[lane]) // UNITS - windows * low // UNITS)
                at, keep = 0, []
                for source, a, b in chains[s]:
                    n = min(b - a, take - at)
                    if n > 0:
                        stretches.append((source, a, a + n, len(phases) - 1, lane, at))
                        at += n
                    if a + max(n, 0) < b:
                        keep.append((source, a + max(n, 0), b))
                chains[s] = keep
            first += windows
        for s in [s for s in chains if not chains[s]]:
            del chains[s]
        if len(chains) > 1 and chains:  # the one that can't pay a quantum next time joins the shortest other
            active = [s for s in active if s in chains]
            if active:
                least = min(active, key=lambda s: (left(s) / max(weight[s], 1e-9), str(s)))
                others = [s for s in active if s != least] or [s for s in chains if s != least]
                host = min(others, key=lambda s: (left(s), str(s)))
                chains[host] = chains.pop(least) + chains[host]
    return phases, stretches


def windows_of(start: int, n: int, phase: dict, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens start..start+n of a lane: sequence numbers, lengths and offsets of the pieces."""
    high, low = phase["ends"][lane], phase["ends"][lane - 1] if lane else 0
    got = lambda w: (w * high // UNITS) - (w * low // UNITS)  # noqa: E731  the lane's tokens in w windows
    w = start * UNITS // (high - low)
    while got(w) > start:
        w -= 1
    while got(w + 1) <= start:
        w += 1
    e = (start + n) * UNITS // (high - low)
    while got(e) < start + n:
        e += 1
    while e - 1 > w and got(e - 1) >= start + n:
        e -= 1
    at = np.arange(w, e + 1, dtype=np.int64)
    top, bottom = at * high // UNITS, at * low // UNITS
    edges = top - bottom
    a, b = np.maximum(edges[:-1], start), np.minimum(edges[1:], start + n)
    keep = b > a
    offset = (bottom[1:] - bottom[:-1]) + (a - edges[:-1])
    return (at[:-1] + phase["first"])[keep], (b - a)[keep], offset[keep]


def tokenised(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, pieces: int = CACHE_PIECES) -> DataFrame:
    """Written table of doc_id, source, shard, at (tokens of the same source before it in its shard), n, ids.

    Null texts are empty, so the end id alone; a null source is a source of its own.  Texts of any length are encoded
    whole, repeated rows are documents of their own, and columns other than doc_id, text and source are ignored.
    """
    path = tokenizer_path(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids_of, seen = TaskContext.get().partitionId(), encoder("word", path, pieces=pieces), {}
        end = np.array([end_id], np.uint16).tobytes()
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                ids = [raw + end for raw in ids_of.encode([t or "" for t in part.column("text").to_pylist()])]
                at = []
                for source, raw in zip(part.column("source").to_pylist(), ids):
                    at.append(seen.get(source, 0))
                    seen[source] = at[-1] + len(raw) // 2
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.array([shard] * len(part), pa.int32()), pa.array(at, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "shard", "at", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    return store.written(columns.mapInArrow(store.tidied(encode, tokens=True), f"doc_id {kind}, source string, shard int, at long, n long, ids binary"), "tokenised")


def pack(docs: DataFrame, targets: dict[str, float] | None = None, length: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, with_ids: bool = True, pieces: int = CACHE_PIECES) -> DataFrame:
    """Packs docs (doc_id, text, source) into sequences of at most length tokens.

    targets: weight by source; None: in proportion to the sources' tokens.  Returns a row per piece: doc_id, start
    (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, source and ids (the
    piece's, little-endian u16; null without with_ids).  Each id is in exactly one piece, sequences have no gaps.  An empty table gives no
    rows; repeated doc_ids are documents of their own.  pieces: what a worker keeps of the tokenizer's, for time or
    memory.
    """
    spark = docs.sparkSession
    table = tokenised(docs, tokenizer, end_id, pieces)
    ordered = Window.partitionBy("source").orderBy("shard")
    sums = table.groupBy("source", "shard").agg(F.sum("n").alias("tokens"))
    sums = store.written(sums.withColumn("before", F.sum("tokens").over(ordered) - F.col("tokens")), "totals")
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    phases, stretches = plan({k: int(v) for k, v in totals.items()}, targets, length)
    by_source: dict[str, list[tuple]] = {}
    for s in stretches:
        by_source.setdefault(s[0], []).append(s[1:])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            docs_, sources, raws = (batch.column(c).to_pylist() for c in ("doc_id", "source", "ids"))
            firsts, counts = batch.column("first").to_pylist(), batch.column("n").to_pylist()
            for k, (source, first, n) in enumerate(zip(sources, firsts, counts)):
                view, wide = memoryview(raws[k]), memoryview(np.frombuffer(raws[k], "<u2").astype("<u4").tobytes())
                for a, b, phase, lane, lane_at in by_source[source]:
                    low, high = max(a, first), min(b, first + n)
                    if low >= high:
                        continue
                    ids, lengths, offsets = windows_of(lane_at + low - a, high - low, phases[phase], lane)
                    start = low - first
                    for w, m, o in zip(ids.tolist(), lengths.tolist(), offsets.tolist()):
                        piece = bytes(view[2 * start : 2 * (start + m)]) if with_ids else None
                        rows.append((docs_[k], start, m, crc32(wide[4 * start : 4 * (start + m)]), n, w, o, source, piece))
                        start += m
                    if len(rows) >= 20_000:
                        yield pieces(rows, batch)
                        rows = []
            if rows:
                yield pieces(rows, batch)

    def pieces(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, start, m, sums, n, w, o, source, raw = zip(*rows)
        whole = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("doc_id").type), whole(start), whole(m), whole(sums), whole(n), whole(w), whole(o), pa.array(source, pa.string()), pa.array(raw, pa.binary())], names=[f.name for f in out.fields])

    whole = T.LongType()
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, whole) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("source", T.StringType()), T.StructField("ids", T.BinaryType())])
    before = sums.select(F.col("source").alias("s"), F.col("shard").alias("k"), "before")
    placed = table.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k")))
    return placed.select("doc_id", "source", "n", "ids", (F.col("before") + F.col("at")).alias("first")).mapInArrow(store.tidied(place), out)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: all documents in sequences of 2048; the sources' shares are those of the corpus."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False, pieces=1_200_000).drop("ids")
