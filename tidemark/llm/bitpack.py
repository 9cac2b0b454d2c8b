"""Token ids in fixed-width bit-packed blocks, in ascending doc_id order, with random access.

The file format is a folder of Parquet files whose rows are blocks of whole documents:

    shard    place of the file's rows in the order of ids          first    ids of the shard before the block
    doc_ids  the documents of the block, in order                  lengths  ids of each
    width    bits per id                                           payload  the ids, ``width`` bits each

Id i of a block takes bits [i * width, (i + 1) * width) of the payload, lowest bit first. ``unpack`` reads any
range of a block with numpy from just the bytes that hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textblocks import lean
from tidemark.llm.tokens import encoder

BLOCK_IDS = 1 << 16  # a block is closed at so many ids; a longer document has a block of its own
SCHEMA = "shard int, first bigint, doc_ids array<bigint>, lengths array<bigint>, width int, payload binary"
END_ID = 0


def pack(ids: np.ndarray, width: int) -> bytes:
    ids = ids.astype("<u4")
    if width % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """Ids [first, first + count) of a block, as unsigned 32-bit numbers."""
    if count == 0:
        return np.zeros(0, "<u4")
    low, high = first * width // 8, -(-(first + count) * width // 8)
    raw = np.frombuffer(payload, np.uint8, high - low, low)
    if width % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : width // 8] = raw.reshape(count, width // 8)
        return out.reshape(-1).view("<u4")
    bits = np.unpackbits(raw, bitorder="little")[first * width - low * 8 :][: count * width].reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def width_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def write(docs: DataFrame, path: str, definition: str, kind: str = "spaced", end_id: int = END_ID) -> None:
    """Encode (doc_id, text) and write the blocks to a fresh folder.

    Documents are ordered by doc_id (null first), equal ids by text hash. Null and empty texts are one end id;
    repeated rows are written as often as they come; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # the tokenizer's file

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(shared.value, kind)
        width = width_for(max(tool.tokenizer.get_vocab_size(), end_id + 1))
        shard, first = TaskContext.get().partitionId(), 0
        end = np.array([end_id], tool.dtype).tobytes()
        doc_ids, lengths, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(parts), tool.dtype), width)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([payload], pa.binary())],
                ["shard", "first", "doc_ids", "lengths", "width", "payload"])

        for batch in batches:
            column = batch.column("text")
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in column.slice(at, 256).to_pylist()]
                for doc_id, raw in zip(batch.column("doc_id").slice(at, 256).to_pylist(), tool.ids(texts)):
                    n = len(raw) // tool.dtype.itemsize + 1
                    if held and held + n > BLOCK_IDS:
                        yield block()
                        first, held = first + held, 0
                        doc_ids, lengths, parts = [], [], []
                    doc_ids.append(doc_id)
                    lengths.append(n)
                    parts += [raw, end]
                    held += n
        if held:
            yield block()
        tool.rest()

    rows = docs.select("doc_id", F.col("text").cast("string"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids of all documents before the block."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.max(F.col("first") + F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")).collect()
    before, base = 0, {}  # one number per file
    for shard, n in sorted((r.shard, r.n) for r in sizes):
        base[shard], before = before, before + n
    starts = spark.createDataFrame([(k, v) for k, v in base.items()], "shard int, base bigint")
    return blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("base") + F.col("first"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                raw = unpack(row["payload"], row["width"], 0, int(lengths.sum())).tobytes()
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(starts.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = blocks_of(spark, path).select("start", "doc_ids", "lengths", "width", "payload")
    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def ids_of(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids [start, start + count) of the whole corpus, from the blocks that hold them."""
    hit = blocks_of(spark, path).where((F.col("start") < start + count) & (F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y) > start))
    out = []
    for row in hit.orderBy("start").collect():
        low, high = max(start, row.start), min(start + count, row.start + sum(row.lengths))
        out.append(unpack(bytes(row.payload), row.width, low - row.start, high - low))
    return np.concatenate(out) if out else np.zeros(0, "<u4")
