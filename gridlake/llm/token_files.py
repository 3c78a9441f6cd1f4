"""Token ids in bit-packed binary files (operator 2).

A file is one shard, little-endian throughout:

    magic 8 bytes, version, bits per id, ids per block (u32 each), 0 (u32),
    ordinal (u64), documents, ids, blocks (u64 each),
    document ids (i64 each), null marks of the document ids (u8 each),
    first id of each document, counted within the shard (u64, one more than documents),
    byte offset of each block in the payload (u64, one more than blocks),
    payload, and one line feed.

An id takes the fewest bits that hold the vocabulary. A block holds a multiple of 8 ids, so
it starts at a byte; any id is found from its block's offset without reading what is before.
The shards in the order of their ordinals hold the documents in ascending order of id.
Spark's own text writer puts one shard in one file, so a lost executor leaves no half file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.llm.arrow import by_bytes
from gridlake.llm.encoding import Encoder, worker_copy

MAGIC = b"GLTOKENS"
BLOCK = 4096
SHARD_IDS = 1 << 20
#: Bytes of text that are encoded together.
ENCODE_BYTES = 4 << 20
HEAD = np.dtype([("magic", "S8"), ("version", "<u4"), ("bits", "<u4"), ("block", "<u4"), ("zero", "<u4"),
                 ("ordinal", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8")])


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each, lowest bit first, filled up to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8), axis=None, bitorder="little").tobytes()


def unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return data[:n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    planes = np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits)
    return planes @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def shard_bytes(ordinal: int, doc_ids: list, ids: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    n_blocks = -(-len(ids) // BLOCK)
    head = np.zeros(1, HEAD)
    head[0] = (MAGIC, 1, bits, BLOCK, 0, ordinal, len(doc_ids), len(ids), n_blocks)
    payload = b"".join(pack(ids[lo:lo + BLOCK * 64], bits) for lo in range(0, len(ids), BLOCK * 64))
    offsets = np.minimum(np.arange(n_blocks + 1) * (BLOCK * bits // 8), len(payload))
    return b"".join([
        head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.concatenate(([0], np.cumsum(counts))).astype("<u8").tobytes(),
        offsets.astype("<u8").tobytes(), payload])


class Shard:
    """A shard read back; ids(lo, hi) unpacks only the blocks that hold them."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.head = np.frombuffer(data, HEAD, 1)[0]
        if self.head["magic"] != MAGIC:
            raise ValueError("not a token file")
        docs, blocks, at = int(self.head["docs"]), int(self.head["blocks"]), HEAD.itemsize
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.nulls = np.frombuffer(data, "u1", docs, at + 8 * docs).astype(bool)
        at += 9 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = raw[at + 8 * (blocks + 1):]
        self.n_ids, self.bits, self.block = int(self.head["ids"]), int(self.head["bits"]), int(self.head["block"])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, -(-hi // self.block)
        n = min(last * self.block, self.n_ids) - first * self.block
        data = self.payload[self.offsets[first]:self.offsets[last]]
        return unpack(data, self.bits, n)[lo - first * self.block:hi - first * self.block]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, end_id: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text, append end_id, write shards to `folder` in order of id.

    A null text holds the end id only. Null ids come first; rows of the same id are ordered
    by text. An empty table gives no shard. Other columns are not read.
    """
    bits = bits_for(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_copy(Encoder, tokenizer_path)
        part, number = TaskContext.get().partitionId(), 0
        names, held, counts, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            data = shard_bytes(part << 32 | number, names, np.concatenate(held), np.concatenate(counts), bits)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for batch in by_bytes(batches, limit=ENCODE_BYTES):
            ids, sizes = encoder(batch.column(1))
            ends = np.cumsum(sizes)
            names += batch.column(0).to_pylist()
            held.append(np.insert(ids, ends, end_id))
            counts.append(sizes + 1)
            total += len(held[-1])
            if total >= SHARD_IDS:
                yield shard()
                names, held, counts, total, number = [], [], [], 0, number + 1
        if names:
            yield shard()

    (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
     .repartitionByRange("doc_id", F.xxhash64("text"))
     .sortWithinPartitions("doc_id", "text")
     .mapInArrow(write, "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder))


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where("length > 1")


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """ordinal, first: how many ids all shards before hold. One row per shard."""
    def number(field: str):
        at = HEAD.fields[field][1]
        digits = [F.hex(F.substring("content", at + i + 1, 1)) for i in reversed(range(8))]
        return F.conv(F.concat(*digits), 16, 10).cast("long")

    heads = shard_files(spark, folder).select(number("ordinal").alias("ordinal"), number("ids").alias("ids"))
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return heads.select("ordinal", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                crcs = []
                for lo in range(0, len(shard.doc_ids), 512):
                    hi = min(lo + 512, len(shard.doc_ids))
                    ids = shard.ids(int(shard.starts[lo]), int(shard.starts[hi])).astype("<u4")
                    cuts = (shard.starts[lo:hi + 1] - shard.starts[lo]).tolist()
                    crcs += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(crcs), shard.head["ordinal"]), pa.int64()),
                    pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls),
                    pa.array(shard.starts[:-1], pa.int64()),
                    pa.array(np.diff(shard.starts), pa.int64()),
                    pa.array(crcs, pa.int64())], ["ordinal", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shard_files(spark, folder).select("content").mapInArrow(
        read, "ordinal long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(spark, folder), "ordinal").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
