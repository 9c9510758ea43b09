"""Operator 8: token ids in fixed-width bit-packed blocks.

An id takes the least number of bits that holds the vocabulary.  Documents are written
in ascending order of id, in blocks of whole documents.  A block's row holds its packed
ids, the place of its first id in its shard and the place of each document in it, so a
reader can unpack any block alone, and any document or range of ids within it, with
vectorised shifts.  Blocks are rows of a Parquet dataset written through Spark, so they
can live in any store that Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, partitions, small_batches
from .tokens import default_tokenizer, id_encoder, vocabulary_size

#: A block ends with the first document that brings it to so many ids.
BLOCK_IDS = 1 << 18


def width_for(vocabulary: int) -> int:
    """Bits that hold each of ``vocabulary`` ids."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id's lowest ``bits`` bits, least significant first, without gaps."""
    if bits in (8, 16, 32):  # whole bytes: the same layout as a little-endian array
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from place ``first`` on, reading only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count, offset=first * bits // 8).astype("<u4")
    begin, end = first * bits, (first + count) * bits
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8)[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 : begin % 8 + count * bits]
    return (flat.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


_BLOCK = "shard int, block int, first_id long, n_ids long, bits int, payload binary, doc_ids array<long>, doc_first array<long>"


def write_packed(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Write the ids of all texts, each ended with ``end_id``, to the block dataset at ``path``.

    A null text counts as empty: it has its end id only.  Null ids come first; equal ids
    each keep their ids, side by side.  An empty table gives a dataset without blocks.
    """
    vocabulary = tokenizer or default_tokenizer()
    bits = width_for(max(vocabulary_size(vocabulary), end_id + 1))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = id_encoder(vocabulary), end_id.to_bytes(4, "little")
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        ids: list = []
        places: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), dtype="<u4"), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([bits], pa.int32()), pa.array([payload], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.int64()))],
                ["shard", "block", "first_id", "n_ids", "bits", "payload", "doc_ids", "doc_first"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = encode(text) + end
                held.append(got)
                ids.append(doc_id)
                places.append(size)
                size += len(got) // 4
                if size >= BLOCK_IDS:
                    yield flush()
                    block, before = block + 1, before + size
                    held, ids, places, size = [], [], [], 0
        if ids:
            yield flush()

    # Texts are dealt out in order before they are encoded, so that finding the ranges doesn't encode anything.
    # Rows that share an id are told apart by their texts' hashes, so a common id fills no task.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    rows.repartitionByRange(partitions(docs.sparkSession), "id", "hash").sortWithinPartitions("id", "hash").drop("hash").mapInArrow(run, _BLOCK).write.parquet(path)


def read_packed(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids_crc32, ids`` of each document in the block dataset at ``path``.

    ``ids`` holds little-endian unsigned 32-bit integers; leave it out where it isn't needed.
    """
    blocks = spark.read.schema(_BLOCK).parquet(path)
    # A row for each shard.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], r["bits"], 0, r["n_ids"])
                cuts = [*r["doc_first"], r["n_ids"]]
                parts = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["shard_start"] + r["first_id"] + a for a in r["doc_first"]], pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    ["id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    small_batches(spark)
    return blocks.join(F.broadcast(starts), "shard").select("first_id", "n_ids", "bits", "payload", "doc_ids", "doc_first", "shard_start").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, ids binary").withColumnRenamed("id", id_col)


def read_ids(spark: SparkSession, path: str, shard: int, first: int, count: int) -> np.ndarray:
    """``count`` ids of a shard from place ``first`` on: random access to the blocks that hold them (a small range, by its caller's choice)."""
    end = first + count
    blocks = spark.read.schema(_BLOCK).parquet(path).where((F.col("shard") == shard) & (F.col("first_id") < end) & (F.col("first_id") + F.col("n_ids") > first)).orderBy("first_id")
    out = [np.empty(0, dtype="<u4")]
    for r in blocks.select("first_id", "n_ids", "bits", "payload").toLocalIterator():
        a, b = max(first - r["first_id"], 0), min(end - r["first_id"], r["n_ids"])
        out.append(unpack(bytes(r["payload"]), r["bits"], a, b - a))
    return np.concatenate(out)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a block dataset in the shared folder and read its documents back."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write_packed(docs, path, id_col=id_col, text_col=text_col, tokenizer=tokenizer)
    return read_packed(spark, path, id_col)
