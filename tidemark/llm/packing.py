"""Operator 7: packing documents into training sequences by minimum bin slack.

Each document is tokenised, ended with ``end_id`` and cut into full sequences plus one
remainder shorter than the capacity.  Remainders differ only in length, so the plan is
made on their histogram, which has fewer entries than the capacity whatever the
corpus: the longest remaining length opens a window, a subset-sum over a bitset of
reachable fillings finds the multiset of remaining lengths that comes closest to
filling it, backtracking gives how often each length is used, and the pattern is
repeated while its lengths last.  Documents then take their places in the plan by
their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, small_batches, stored
from .tokens import default_tokenizer, id_encoder


def closest_filling(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """How often each length is used in the fullest filling of ``room`` with at most ``left[n]`` of each ``n``.

    ``lengths`` lists the lengths in descending order; of equally full ones, those with
    longer pieces are preferred.
    """
    whole = (1 << (room + 1)) - 1
    reach, stages, used = 1, [], []
    for n in lengths:
        if n > room or not left[n]:
            continue
        stages.append(reach)
        used.append(n)
        todo, step = min(left[n], room // n), 1
        while todo > 0:  # 1, 2, 4, ... copies at once
            take = min(step, todo)
            reach |= (reach << (take * n)) & whole
            todo, step = todo - take, step * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for n, before in zip(reversed(used), reversed(stages), strict=True):
        copies = 0
        while not before >> total & 1:
            total, copies = total - n, copies + 1
        if copies:
            out[n] = copies
    return out


def minimum_slack_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows ``(length, first_rank, copies, repeats, first_sequence, offset)`` and the number of sequences.

    Ranks ``first_rank ...`` of a length fill ``repeats`` sequences from
    ``first_sequence``, ``copies`` in each, from ``offset`` on.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(left, reverse=True)
    taken: dict[int, int] = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    for longest in order:
        while left[longest]:
            left[longest] -= 1
            pattern = closest_filling(order, left, capacity - longest)
            left[longest] += 1
            pattern[longest] = pattern.get(longest, 0) + 1
            repeats, offset = min(left[n] // c for n, c in pattern.items()), 0
            for n, c in sorted(pattern.items(), reverse=True):
                rows.append((n, taken[n], c, repeats, sequence, offset))
                taken[n] += c * repeats
                left[n] -= c * repeats
                offset += c * n
            sequence += repeats
    return rows, sequence


def _cut(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """A row per document: ids with the end id, checksums of its full sequences, length and checksum of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, size = id_encoder(path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            n, full, rest, rest_crc = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text) + end
                whole = len(ids) // size
                n.append(len(ids) // 4)
                full.append([zlib.crc32(ids[i * size : (i + 1) * size]) for i in range(whole)])
                rest.append(len(ids) // 4 - whole * capacity)
                rest_crc.append(zlib.crc32(ids[whole * size :]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int32()), pa.array(rest_crc, pa.int64())], ["id", "doc_tokens", "full", "rest", "rest_crc"])

    return docs.mapInArrow(run, "id long, doc_tokens long, full array<long>, rest int, rest_crc long")


def packed(docs: DataFrame, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text still has its end id.  Rows with equal or null ids are packed as
    documents of their own.  An empty table gives no pieces.  Other columns of ``docs`` are
    not read.  The longest texts give many pieces of ``capacity`` ids and one rest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    salts = partitions(spark)
    # The salt decides the window in which a document is ranked, so neither a common id nor a common length fills one.
    cut = stored(_cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), capacity, end_id, tokenizer or default_tokenizer()).withColumn("salt", F.pmod(F.xxhash64("id", "rest_crc", F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "cut")
    # At most capacity - 1 rows.
    histogram = {r["rest"]: r["n"] for r in cut.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, sequences = minimum_slack_plan(histogram, capacity)
    by_length: dict[int, np.ndarray] = {}
    for n in histogram:
        by_length[n] = np.array([row[1:] for row in plan if row[0] == n], dtype=np.int64)

    of_salt = Window.partitionBy("salt").orderBy("id", "rest_crc", "doc_tokens", "full")
    of_both = Window.partitionBy("rest", "salt").orderBy("id", "rest_crc", "doc_tokens", "full")
    ranked = cut.withColumns({"rank": F.row_number().over(of_both).cast("long") - 1, "full_before": F.sum(F.size("full").cast("long")).over(of_salt.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("full")})
    counted = cut.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("full").cast("long")).alias("n_full"))
    ranks = counted.select("rest", "salt", (F.sum("n").over(Window.partitionBy("rest").orderBy("salt")) - F.col("n")).alias("rank_base"))
    # One row for each salt.
    fulls, base = {}, sequences
    for r in sorted(counted.groupBy("salt").agg(F.sum("n_full").alias("n")).collect()):
        fulls[r["salt"]], base = base, base + r["n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for r in batch.to_pylist():
                first = fulls[r["salt"]] + r["full_before"]
                for k, crc in enumerate(r["full"]):
                    for column, value in zip(out, (r["id"], k * capacity, capacity, crc, r["doc_tokens"], first + k, 0), strict=True):
                        column.append(value)
                if n := r["rest"]:
                    rank = r["rank"] + r["rank_base"]
                    steps = by_length[n]
                    first_rank, copies, _, sequence, offset = steps[np.searchsorted(steps[:, 0], rank, "right") - 1].tolist()
                    turn, slot = divmod(rank - first_rank, copies)
                    for column, value in zip(out, (r["id"], len(r["full"]) * capacity, n, r["rest_crc"], r["doc_tokens"], sequence + turn, offset + slot * n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = ranked.join(ranks, ["rest", "salt"]).select("id", "doc_tokens", "full", "rest", "rest_crc", "salt", "rank", "rank_base", "full_before")
    return rows.mapInArrow(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
