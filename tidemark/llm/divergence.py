"""Operator 12: how the wording of sources differs within a language, by integer-dictionary encoding.

Terms are runs of letters, A to Z lower-cased.  One pass counts them for each language and
source, and in how many documents each is.  The counts are then dealt out in ranges of
(language, term): a range holds all rows of its terms, so which terms a language keeps is
decided there.  Its kept terms, sorted as UTF-8 bytes, are cut into chunks; a term's id is its
place in the chunk (found by binary search), so ids order as terms do.  A chunk's
counts make one dense vector for each source (a bincount over ids), and all comparisons
are arithmetic on such vectors:

* ``pair``: how far a source is from each other one, summed over all kept terms;
* ``term``: the terms that a source has more often than its language.

All of it is exact: shares are integers of a billionth, and counts are never rounded.
Sources of a language are compared in blocks, so memory depends neither on how many there are
nor on how many terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, small_batches, stored

#: Kept terms, and counts, in a chunk; a chunk ends with a whole term.
CHUNK_TERMS, CHUNK_COUNTS = 2048, 1 << 15
#: Full chunks' worth of kept terms that a task compares, on average; each task hands on the best terms of each of its sources.
CHUNKS_A_TASK = 64
#: Sources of a language that are compared at once with as many others, on average.
BLOCK = 64
#: Distinct terms, and bytes of documents' terms, after which a task hands on what it has counted.
HELD_TERMS, HELD_BYTES = 200_000, 1 << 25
#: Bytes of a text that are cut into words at once.
SLAB = 1 << 22
#: What a share of one is.
ONE = 1_000_000_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slabs(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some megabytes at a time; a cut lies at a separator."""
    text = text.translate(_LETTERS)
    start = 0
    while len(text) - start > SLAB:
        end = text.find(b" ", start + SLAB)
        if end < 0:
            break
        yield text[start:end].split()
        start = end
    yield text[start:].split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, term, n, docs`` of one task, several for one term if there are many terms; an empty term for each group."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            for part in batched(n.items(), 1 << 14):
                terms, counts = zip(*part, strict=True)
                arrays = [pa.array([lang] * len(part), pa.binary()), pa.array([source] * len(part), pa.binary()), pa.array(terms, pa.binary()), pa.array(counts, pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    held = size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _slabs(text):
                n.update(words)
                seen.update(words)
            seen.add(b"")
            n[b""] = 0
            docs.update(seen)
            if new := len(n) - before:
                held, size = held + new, size + sum(map(len, seen))
        if held > HELD_TERMS or size > HELD_BYTES:
            yield from rows()
            groups.clear()
            held = size = 0
    yield from rows()


_ENCODED = "lang binary, chunk long, terms array<binary>, sources array<binary>, totals array<long>, source_of array<int>, term_of array<int>, counts array<long>"


def _exact_bincount(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Sums of integer counts by id. Each half of the bits is summed without rounding."""
    low, high = (np.bincount(ids, weights=half, minlength=size) for half in (counts & 0xFFFFFFFF, counts >> 32))
    return low.astype(np.int64) + (high.astype(np.int64) << 32)


def _encoder(least_docs: int):
    """Chunks of rows that come sorted by language and term."""

    def chunk(lang: bytes, number: int, terms: list[bytes], sources: list[bytes], n: list[int], docs: list[int]) -> list | None:
        term, count = np.array(terms, dtype=object), np.array(n, dtype=np.int64)
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        in_docs = np.add.reduceat(np.array(docs, dtype=np.int64), starts)
        is_kept = in_docs >= least_docs
        kept = term[starts][is_kept]
        if not len(kept):
            return None
        mine = np.repeat(is_kept, np.diff(np.append(starts, len(term))))
        term, count, source = term[mine], count[mine], np.array(sources, dtype=object)[mine]
        names = np.array(sorted(set(source)), dtype=object)
        source_of, term_of = np.searchsorted(names, source), np.searchsorted(kept, term)
        totals = _exact_bincount(source_of, count, len(names))
        return [lang, number, kept.tolist(), names.tolist(), totals, source_of.astype(np.int32), term_of.astype(np.int32), count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        lang = last = None
        n_terms = number = 0
        schema = pa.schema([("lang", pa.binary()), ("chunk", pa.int64()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.binary())), ("totals", pa.list_(pa.int64())), ("source_of", pa.list_(pa.int32())), ("term_of", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal number, n_terms
            if held[0] and (row := chunk(lang, number, *held)):
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
            for h in held:
                h.clear()
            n_terms = 0

        for batch in batches:
            for part, row_lang, term, source, n, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang is None:
                    number = part << 32
                if row_lang != lang or (term != last and (n_terms >= CHUNK_TERMS or len(held[0]) >= CHUNK_COUNTS)):
                    yield from flushed()
                    lang, last = row_lang, None
                if term != last:
                    last, n_terms = term, n_terms + 1
                for h, value in zip(held, (term, source, n, docs), strict=True):
                    h.append(value)
        yield from flushed()

    return run


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(ONE * (counts + 1) / total)``, exact for counts below 2^63 and totals below 9e15."""
    counts = counts + 1
    if counts.size == 0 or counts.max() < (1 << 63) // ONE:
        return 1 + counts * ONE // total
    whole, rest = counts // total, counts % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return 1 + whole


def _comparer(top: int):
    """Sums over this task's chunks for each pair of sources in two blocks, and the best terms of each source."""
    out_schema = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])

    def dense(block: np.ndarray, names: np.ndarray, source_of: np.ndarray, term_of: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(block, names), len(block) - 1)
        row = np.where(block[at] == names, at, -1)[source_of]
        mine = row >= 0
        return _exact_bincount(row[mine] * m + term_of[mine], counts[mine], len(block) * m).reshape(len(block), m)

    def rows(lang: bytes, left: np.ndarray, right: np.ndarray, sums: np.ndarray, best: list) -> Iterator[pa.RecordBatch]:
        source, item, value = np.repeat(left, len(right)), np.tile(right, len(left)), sums.ravel()
        other = source != item
        found = [(source[other].tolist(), "pair", item[other].tolist(), value[other])]
        for name, b in zip(left, best, strict=True):
            if b is not None:
                found.append(([name] * len(b[0]), "term", b[3].tolist(), b[0]))
        for sources, part, items, values in found:
            n = len(sources)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.binary()), pa.array(sources, pa.binary()), pa.array([part] * n, pa.string()), pa.array(items, pa.binary()), pa.array(values, pa.int64())], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            of = lambda name, i: column[name][i].as_py()  # noqa: E731, B023
            flat = lambda name, i: column[name][i].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
            objects = lambda name, i: np.array(column[name][i].as_py(), dtype=object)  # noqa: E731, B023
            for i in range(batch.num_rows):
                this = (of("lang", i), of("block", i), of("other", i))
                if this != key:
                    if key:
                        yield from rows(key[0], left, right, sums, best)
                    key, same = this, this[1] == this[2]
                    left, right = objects("sources_l", i), objects("sources_r", i)
                    n_left, n_right, v, n_lang = flat("totals_l", i), flat("totals_r", i), of("v", i), of("n_lang", i)
                    sums, best = np.zeros((len(left), len(right)), dtype=np.int64), [None] * len(left)
                terms, names = objects("terms", i), objects("sources", i)
                args = names, flat("source_of", i), flat("term_of", i), flat("counts", i), len(terms)
                c_left = dense(left, *args)
                p = shares(c_left, (n_left + v)[:, None])
                q = p if same else shares(dense(right, *args), (n_right + v)[:, None])
                for g in range(len(left)):
                    apart = p[g] - q
                    sums[g] += (apart * apart // q).sum(1)
                if not same:
                    continue
                usual = shares(_exact_bincount(args[2], args[3], len(terms)), n_lang + v)
                for g in range(len(left)):
                    ids = np.flatnonzero((c_left[g] > 0) & (p[g] > usual))
                    if not len(ids):
                        continue
                    apart = p[g][ids] - usual[ids]
                    new = (apart * apart // usual[ids], np.full(len(ids), of("chunk", i)), ids, terms[ids])
                    joined = new if best[g] is None else tuple(np.concatenate(pair) for pair in zip(best[g], new, strict=True))
                    # Chunk and id order as terms do.
                    first = np.lexsort((joined[2], joined[1], -joined[0]))[:top]
                    best[g] = tuple(a[first] for a in joined)
        if key:
            yield from rows(key[0], left, right, sums, best)

    return run


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by distance, and each source's own terms.

    A term is kept in a language if at least ``least_docs`` of its rows hold it.  With N kept
    occurrences in a group and V kept terms in the language, a share is ``1 + floor(10^9 * (count
    + 1) / (N + V))``; two shares p and q differ by ``floor((p - q)^2 / q)``.  Part ``pair`` sums
    this over all kept terms for each other source (0 without kept terms), all of them ranked; part
    ``term`` has the first ``top`` terms of a group whose share is above the language's.  Ranks
    go by value, then by item as UTF-8.  Nulls in any column are empty texts; each row is a
    document of its own, whatever else it shares; a language of one source has no pairs; an empty
    table gives no rows.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    salts = partitions(spark)
    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(raw(lang_col).alias("lang"), raw(source_col).alias("source"), raw(text_col).alias("text"))
    partial = texts.mapInArrow(_counted, "lang binary, source binary, term binary, n long, docs long")
    counted = stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")

    # All rows of a term in one range; rows of a term are as many as its language has sources.
    ranges = counted.where(F.length("term") > 0).repartitionByRange(salts, "lang", "term").sortWithinPartitions("lang", "term")
    encoded = stored(ranges.select(F.spark_partition_id().cast("long").alias("at"), "lang", "term", "source", "n", "docs").mapInArrow(_encoder(least_docs), _ENCODED), "chunks")

    kept = encoded.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    groups = stored(counted.where(F.length("term") == 0).select("lang", "source").join(kept, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    terms = encoded.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("v"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.sum("total").alias("n_lang")).join(terms, "lang")
    dealt = groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.ceil(F.col("_n") / BLOCK)))
    blocks = dealt.groupBy("lang", "v", "n_lang", "block").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("g"))
    side = lambda s: [F.col("g.source").alias(f"sources_{s}"), F.col("g.total").alias(f"totals_{s}")]
    pairs = blocks.select("lang", "v", "n_lang", "block", *side("l")).join(blocks.select("lang", F.col("block").alias("other"), *side("r")), "lang")
    # A language may hold most chunks: each pair of blocks goes once to each salt.
    # Their number follows kept terms and counts, not chunks, which are small where there are many partitions.
    full = F.sum(F.greatest(F.size("terms") / CHUNK_TERMS, F.size("counts") / CHUNK_COUNTS))
    salts = math.ceil((encoded.agg(full).first()[0] or 0) / CHUNKS_A_TASK) or 1
    pairs = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = encoded.drop("totals").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")).join(pairs, ["lang", "salt"]).drop("salt")
    found = both.sortWithinPartitions("lang", "block", "other").mapInArrow(_comparer(top), "lang binary, source binary, part string, item binary, value long")

    # Each pair once with nothing, for languages without kept terms.
    none = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = found.unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "part", F.col("item").cast("string").alias("item"), "value", "rank")
