"""Operator 11: byte-level BPE of texts of any length, by overlapping chunks.

A pre-token is a match of the vocabulary's pattern; merges stay inside it.  What matches from a place on depends on
nothing before that place.  So a long text is cut into chunks that overlap, each chunk is pre-tokenised by a task of
its own as if it began a text, and where the pre-tokens of a chunk and of the one before it begin at the same place
inside their overlap, they are the same from there on: the first such place parts the two.  The stretches between
those places are encoded, again by tasks of their own.  Chunks without such a place (a pre-token longer than the
overlap) are joined and encoded together.  Decoding puts the bytes of the ids one after the other.

Python's ``regex`` finds the places, the tiktoken library the ids.  They may know different versions of Unicode, so a
place beside a character that Python's own tables don't know doesn't count.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm import store
from fathom.llm.tokens import tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points: texts up to CHUNK are encoded in one piece; chunks of longer ones reach OVERLAP into the next.
CHUNK = 1 << 15
OVERLAP = 1 << 10
#: What matches this near to the end of a chunk may match otherwise in the whole text ('re, 've and 'll reach two on).
UNSURE = 3
#: The library's matcher fails on runs of white space some ten times as long.
LONG_SPACES = 20_000
BATCH_BYTES = 8 << 20


class Codec:
    """Ids and bytes of whole texts; one of each kind per Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern, self.spaces = regex.compile(pattern), regex.compile(r"\s{%d,}" % LONG_SPACES)
        self.texts = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.bytes = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids, at = [], 0
        for run in self.spaces.finditer(text) if len(text) >= LONG_SPACES else ():
            end = run.end() if run.end() == len(text) else run.end() - 1  # the last one may lead the next pre-token
            ids += self.texts.encode_ordinary(text[at : run.start()]) + self.pieces.encode_ordinary(text[run.start() : end])
            at = end
        return np.array(ids + self.texts.encode_ordinary(text[at:]), "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def starts(self, text: str, low: int, high: int, ends: bool) -> tuple[list[int], list[int], list[int]]:
        """Where pre-tokens begin before low, from high on, and those of the latter that do whatever stands before them.

        No match holds a space or line feed after another kind of character.  ends: the text ends with this chunk.
        """
        head, tail, firm, sure = [], [], [], len(text) if ends else len(text) - UNSURE
        for m in self.pattern.finditer(text):
            at, end = m.span()
            if end > sure:
                break
            if not at or low <= at < high:
                continue
            kind = unicodedata.category(text[at - 1])
            # white space at the end of a stretch would match otherwise than before what follows it
            if text[at - 1].isspace() or kind == "Cn" or unicodedata.category(text[at]) == "Cn":
                continue
            if at < low:
                head.append(at)
            if at >= high:
                tail.append(at)
                if text[at] in " \n" and kind[0] in "LNPS":
                    firm.append(at)
        return head, tail, firm


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _by_row(schema: str, begin: Callable[[], Callable]) -> Callable:
    """For mapInArrow: what begin returns gives rows (tuples in the schema's order) for each row, sent on in batches of a few MB."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, out, size = begin(), [], 0
        for batch in batches:
            for i in range(len(batch)):
                for row in make(*(column[i].as_py() for column in batch.columns)):
                    out.append(row)
                    size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return store.tidied(run)


def _chunks(docs: DataFrame, make: Callable[[], Codec], chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of docs (doc_id, text): key of the row, chunk, start, text, and the starts of pre-tokens in both overlaps.

    Rows alike in doc_id and text have one key; each chunk's text is there once, its other rows have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut_schema = f"key string, doc_id {kind}, chunk int, start long, ends boolean, text string"

    def cut(doc_id, text):
        key, n = hashlib.sha256(f"{doc_id}:{text}".encode()).hexdigest(), 0
        for start in range(0, len(text), chunk):
            ends = start + chunk >= len(text)
            yield key, doc_id, n, start, ends, text[start : start + chunk + overlap]
            n += 1

    def split():
        seen: set[tuple[str, int]] = set()

        def look(key, doc_id, n, start, ends, text):
            if (key, n) in seen:
                return [(key, doc_id, n, start, None, None, None, None)]
            seen.add((key, n))
            return [(key, doc_id, n, start, text, *([start + x for x in places] for places in make().starts(text, overlap, chunk, ends)))]

        return look

    schema = f"key string, doc_id {kind}, chunk int, start long, text string, head array<long>, tail array<long>, firm array<long>"
    # the rows' keys and numbers don't depend on the task, so a task that is run again deals them out alike
    dealt = docs.mapInArrow(_by_row(cut_schema, lambda: cut), cut_schema).repartition("key", "chunk")
    return store.written(dealt.mapInArrow(_by_row(schema, split), schema), "chunks")


def _stretches(chunks: DataFrame) -> DataFrame:
    """key, chunk, stretch (chunks that are encoded together), begin and end: places of the text, null where it begins or ends."""
    order = Window.partitionBy("key").orderBy("chunk")
    met = chunks.filter("text IS NOT NULL").select(
        "key", "chunk",
        F.array_min(F.array_intersect(F.lag("tail").over(order), "head")).alias("both"),
        F.array_min(F.array_intersect(F.lag("firm").over(order), "head")).alias("firm"),
    )
    # what a chunk says is the whole text's if it met the one before, and so on down to one that needs none before it
    last = lambda when: F.coalesce(F.max(F.when(when, F.col("chunk"))).over(order), F.lit(-1))
    known = met.withColumn("known", last((F.col("chunk") == 0) | F.col("firm").isNotNull()) > last((F.col("chunk") > 0) & F.col("both").isNull()))
    parted = known.withColumn("begin", F.when(F.lag("known").over(order), F.col("both")).otherwise(F.col("firm")))
    stretch = F.sum(F.when(F.col("begin").isNotNull(), 1).otherwise(0)).over(order)
    return parted.select("key", "chunk", "begin", F.lead("begin").over(order).alias("end"), stretch.alias("stretch"))


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers as binary) of each row of docs (doc_id, text).

    The ids are the tiktoken library's for the whole text, without special tokens.  A null text is an empty one and
    has no ids; texts longer than ``chunk`` go through chunks and may be of any length whose ids fit in a row (2 GB).
    Null doc_ids stay null, repeated rows come out as often as they went in, other columns are ignored, and no rows
    give no rows.  ``pattern`` is the vocabulary's own unless given.
    """
    if not chunk > overlap > 0:
        raise ValueError("chunks must be longer than their overlap")
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    path, kind = tokenizer_path(vocabulary), docs.schema["doc_id"].dataType.simpleString()
    make = lambda: codec(path, pattern)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, ids binary"
    short = rows.filter(F.length("text") <= chunk).mapInArrow(_by_row(schema, lambda: lambda doc_id, text: [(doc_id, make().encode(text))]), schema)

    chunks = _chunks(rows.filter(F.length("text") > chunk), make, chunk, overlap)
    copies = chunks.filter("chunk = 0").groupBy("key").agg(F.count("*").alias("copies"))
    whole = chunks.filter("text IS NOT NULL").join(_stretches(chunks), ["key", "chunk"])
    together = whole.groupBy("key", "stretch").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("chunk", "start", "begin", "end", "text"))).alias("parts"))
    part_schema = f"key string, stretch long, doc_id {kind}, ids binary"

    def stretch(key, number, doc_id, parts):
        first, last = parts[0], parts[-1]
        begin, texts, reached = first["begin"] or 0, [], first["begin"] or 0
        for p in parts:
            texts.append(p["text"][reached - p["start"] :])
            reached = p["start"] + len(p["text"])
        end = reached if last["end"] is None else last["end"]
        yield key, number, doc_id, make().encode("".join(texts)[: end - begin])

    done = together.mapInArrow(_by_row(part_schema, lambda: stretch), part_schema)
    joined = done.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("stretch", "ids"))).alias("parts")).join(copies, "key")
    long = joined.select("doc_id", "parts", "copies").mapInArrow(_by_row(schema, lambda: lambda doc_id, parts, n: [(doc_id, b"".join(p["ids"] for p in parts))] * n), schema)
    return short.union(long)


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and data, the bytes that the ids stand for.  No ids are no bytes; an id that the vocabulary lacks is an error."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    path, schema = tokenizer_path(vocabulary), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids binary, data binary"
    return ids.select("doc_id", "ids").mapInArrow(_by_row(schema, lambda: lambda doc_id, raw: [(doc_id, raw, codec(path, pattern).decode(raw))]), schema)


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11: all documents, encoded and decoded again."""
    back = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select("doc_id", F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
