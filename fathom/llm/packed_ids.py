"""Operator 3: token ids in a fixed-width bit-packed file format.

A shard file holds blocks.  A block holds up to ``BLOCK_IDS`` ids of ``bits`` bits each, least significant bit
first, so block ``b`` begins at a fixed place and any id is found without reading others:

    blocks: ceil(block ids * bits / 8) bytes each, the last one shorter
    for each block: its offset in the file as u64
    for each document: number of its first id as u64, and one end mark
    magic ``FTID``, version u16, bits u16, block ids u32, ids u64, documents u64      (28 bytes, little endian)

``bits`` is the smallest width for the vocabulary.  Shards follow each other in ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm import store
from fathom.llm.tokens import encoder, load, tokenizer_path

BLOCK_IDS = 1 << 16
FOOT = struct.Struct("<4sHHIQQ")


def width(vocabulary: int) -> int:
    """Bits for ids below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a run of bits, the least significant bit of each first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype("<u4").reshape(-1, 1) >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int, first: int = 0) -> np.ndarray:
    """Ids first to first + n of a block, without touching those before."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, first * 2).astype(np.uint32)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    raw = np.frombuffer(data + bytes(8), np.uint8)
    start = at >> 3
    word = np.zeros(n, np.uint64)
    for k in range((bits + 7) // 8 + 1):
        word |= raw[start + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class ShardWriter:
    """Writes one shard; documents come in their order."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.starts, self.offsets, self.at = [0], [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, end, self.block_ids):
            data = pack(ids[i : min(i + self.block_ids, end)], self.bits)
            self.offsets.append(self.at)
            self.at += self.out.write(data)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(FOOT.pack(b"FTID", 1, self.bits, self.block_ids, self.n_ids, len(self.starts) - 1))
        self.out.close()


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, version, self.bits, self.block_ids, self.n_ids, self.n_docs = FOOT.unpack(source.read_at(FOOT.size, size - FOOT.size))
        if (magic, version) != (b"FTID", 1):
            raise ValueError("not a file of packed ids")
        n_blocks = -(-self.n_ids // self.block_ids)
        tail = 8 * (n_blocks + self.n_docs + 1)
        self.end = size - FOOT.size - tail
        index = np.frombuffer(source.read_at(tail, self.end), "<u8").astype(np.int64)
        self.offsets, self.starts = index[:n_blocks], index[n_blocks:]
        self.block, self.data = -1, b""

    def ids(self, first: int, n: int) -> np.ndarray:
        parts = [np.zeros(0, np.uint32)]
        while n > 0:
            b, inside = divmod(first, self.block_ids)
            if b != self.block:
                end = self.offsets[b + 1] if b + 1 < len(self.offsets) else self.end
                self.block, self.data = b, self.source.read_at(int(end - self.offsets[b]), int(self.offsets[b]))
            take = min(n, self.block_ids - inside)
            parts.append(unpack(self.data, take, self.bits, inside))
            first, n = first + take, n - take
        return np.concatenate(parts) if len(parts) > 2 else parts[-1]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i]))


def write_packed(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) and writes shards below folder, in ascending doc_id order.

    Returns the written manifest: shard (its rank in that order), path, doc_id, place (its number in the shard),
    n_tokens.  Null texts are empty, so they hold the end id alone.  Null doc_ids come first; rows with the same
    doc_id stand together, by text.  Other columns are ignored.  A task that is run again writes a new file, and
    only the files of the manifest count.  Texts of any
    length are encoded whole, and an empty table gives no files and an empty manifest.
    """
    spark = docs.sparkSession
    path, n = tokenizer_path(tokenizer), partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = width(load(path).get_vocab_size(with_added_tokens=True))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = store.filesystem(folder)
        fs.create_dir(root, recursive=True)
        leaf = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        encode, end = encoder("byte", path), np.array([end_id], np.uint32)
        writer, place = None, 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                writer = writer or ShardWriter(fs.open_output_stream(f"{root}/{leaf}.part"), bits)
                counts = []
                for raw in encode.encode([t or "" for t in part.column("text").to_pylist()]):
                    ids = np.concatenate([np.frombuffer(raw, np.uint16).astype(np.uint32), end])
                    writer.add(ids)
                    counts.append(len(ids))
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task.partitionId()] * k, pa.int32()), pa.array([f"{folder}/{leaf}"] * k), part.column("doc_id"), pa.array(range(place, place + k), pa.int64()), pa.array(counts, pa.int64())],
                    names=["shard", "path", "doc_id", "place", "n_tokens"],
                )
                place += k
        if writer is not None:
            writer.close()
            fs.move(f"{root}/{leaf}.part", f"{root}/{leaf}")

    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = f"shard int, path string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, place long, n_tokens long"
    return store.written(ordered.mapInArrow(store.tidied(write, tokens=True), schema), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds start: ids of all documents before each.  Only totals by shard meet in one task."""
    totals = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "shard").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read_packed(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each manifest row, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader = None, None
        for batch in batches:
            counts, sums = [], []
            for path, place in zip(batch.column("path").to_pylist(), batch.column("place").to_pylist()):
                if path != held:
                    fs, root = store.filesystem(path)
                    held, reader = path, ShardReader(fs.open_input_file(root))
                ids = reader.document(place)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = manifest.schema["doc_id"].dataType.simpleString()
    return manifest.select("path", "place", "doc_id", "start").mapInArrow(store.tidied(read), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3: writes all documents' ids and reads them back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_packed(with_starts(write_packed(docs, store.work_dir(spark, "ids"))))
