"""Operator 1: benchmark decontamination.

Word n-grams of the test items that are rare in the corpus are seeds.  A document that
holds a seed is aligned with the seed's item around it by Smith-Waterman over words, so
that edited and paraphrased copies score as well as exact ones.

Rarity is a document frequency over the whole corpus, in powers of two, but no item loses
its seeds by being copied often: besides all rare n-grams, the rarest of every window of
consecutive n-grams is a seed, so any run of ``window + n - 1`` unchanged words meets one.

Documents are never shuffled or gathered.  The items go to the tasks in blocks of bounded
size, a few flat arrays each; more items than fit in a block mean more passes.  Around its
seeds a text is aligned window by window, each of a few times the item's length, with one
row of the table in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import small_batches

#: Words of test items in one pass, and of an item aligned at once; longer items are taken in parts.
BLOCK_WORDS, ITEM_WORDS = 2_000_000, 50_000
MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass(frozen=True)
class Leaks:
    """What counts as a leak, and how it is looked for.

    A leak has ``min_score`` of its item's best possible score and ``min_matches`` equal words
    (all of a shorter item's); or ``long_matches`` equal words with ``min_score`` of what the
    span that they were found in could have had, whatever the item's length.
    """

    n: int = 3
    window: int = 2
    #: An n-gram in at most this share of the documents (or in five) is rare.
    rare_share: float = 1e-4
    min_score: float = 0.5
    min_matches: int = 8
    long_matches: int = 50

    def is_leak(self, item_words: int, score: int, matches: int, span: int) -> bool:
        if score >= self.min_score * MATCH * item_words and matches >= min(self.min_matches, item_words):
            return True
        return matches >= self.long_matches and score >= self.min_score * MATCH * span


DEFAULT = Leaks()

#: Bytes that words are made of: ASCII letters and digits, and whatever isn't ASCII once marks are gone.
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_MARKS = re.compile(r"[^\w\x00-\x7f]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {True: np.ones(1, dtype=np.uint64), False: np.ones(1, dtype=np.uint64)}


def _powers_of_base(n: int, inverse: bool) -> np.ndarray:
    """The first ``n`` powers, modulo 2 to the 64, of an odd number or of its inverse."""
    known = _powers[inverse]
    if len(known) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        known = _powers[inverse] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, base, dtype=np.uint64)])
    return known[:n]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: runs of letters and digits in lower case.

    Prefix sums of a polynomial give the hashes of all words at once.
    """
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_of_base(len(data), False), out=sums[1:])
    hashes = (sums[end] - sums[start]) * _powers_of_base(len(data), True)[start]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(29))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; a shorter text is one run."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    u, n = hashes, min(n, len(hashes))
    out = np.full(len(u) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ u[k : len(u) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


#: A cell of the table is one number: its score, then the equal words, then where the alignment starts.
_START, _EQUAL = 24, 18
_SCORE = _START + _EQUAL


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: score, equal words, and its first and past-the-end word in ``text``.

    A row of the table at a time, and only one is kept: each cell carries the equal words and
    the start of its alignment along.  Gaps in ``text`` direction come from a running maximum.
    Of alignments of equal score one with the most equal words is taken.
    """
    width = len(text)
    none = np.arange(width + 1, dtype=np.int64)
    steps = none << _SCORE
    match, mismatch, gap = (MATCH << _SCORE) + (1 << _START), MISMATCH * (1 << _SCORE), GAP * (1 << _SCORE)
    row, best, end = none.copy(), 0, 0
    for word in item:
        own = np.maximum(row[:-1] + np.where(text == word, match, mismatch), row[1:] + gap)
        row[1:] = np.where(own >> _SCORE > 0, own, none[1:])
        row = np.maximum.accumulate(row - GAP * steps) + GAP * steps
        row = np.where(row >> _SCORE > 0, row, none)
        at = int(row.argmax())
        if row[at] >> _SCORE and row[at] > best:
            best, end = int(row[at]), at
    if not best:
        return 0, 0, 0, 0
    return best >> _SCORE, (best >> _START) & ((1 << _EQUAL) - 1), best & ((1 << _START) - 1), end


class _Block:
    """Items of one pass, and the sorted n-grams that find them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], how: Leaks):
        self.items, self.how = items, how
        self.grams = [ngrams(w, how.n) for _, w in items]
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *self.grams]))

    def seed(self, frequency: np.ndarray, documents: int) -> None:
        """Keep the rare n-grams, and the rarest of each window, with the places in items that hold them."""
        limit, window = max(5, documents * self.how.rare_share), self.how.window
        grams, items, places = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for k, own in enumerate(self.grams):
            if not len(own):
                continue
            often = frequency[np.searchsorted(self.known, own)]
            rank = np.empty(len(own), dtype=np.int64)
            rank[np.lexsort((own, np.log2(often + 1).astype(int)))] = np.arange(len(own))
            views = np.lib.stride_tricks.sliding_window_view(rank, min(window, len(own)))
            chosen = np.unique(np.r_[np.flatnonzero(often <= limit), np.arange(len(views)) + views.argmin(axis=1)])
            grams.append(own[chosen])
            items.append(np.full(len(chosen), k, dtype=np.int32))
            places.append(chosen.astype(np.int32))
        gram = np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        self.seeds, first = np.unique(gram[order], return_index=True)
        self.first = np.r_[first, len(gram)]
        self.item, self.place = np.concatenate(items)[order], np.concatenate(places)[order]
        self.sieve = _sieve(self.seeds)
        del self.grams, self.known


def _positions(grams: np.ndarray, sorted_known: np.ndarray) -> np.ndarray:
    """Index in ``sorted_known`` for each of ``grams``, -1 where it isn't there."""
    if not len(sorted_known):
        return np.full(len(grams), -1)
    at = np.minimum(np.searchsorted(sorted_known, grams), len(sorted_known) - 1)
    return np.where(sorted_known[at] == grams, at, -1)


def _sieve(known: np.ndarray) -> np.ndarray:
    """A table by the lowest 20 bits that lets few other n-grams through, to spare searches."""
    table = np.zeros(1 << 20, dtype=bool)
    table[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return table


def _windows(starts: np.ndarray, reach: int, words: int) -> Iterator[tuple[int, int]]:
    """Windows of a text that hold every alignment around ``starts`` (sorted): at most six times ``reach`` words each.

    An alignment of at least half of the best score takes up less than twice the item's
    length, so windows that overlap by that much lose none.
    """
    cuts = np.flatnonzero(np.diff(starts) > reach)
    for low, high in zip(starts[np.r_[0, cuts + 1]].tolist(), starts[np.r_[cuts, len(starts) - 1]].tolist(), strict=True):
        a, b = max(0, low - reach), min(words, high + 2 * reach)
        while b - a > 6 * reach:
            yield a, a + 6 * reach
            a += 4 * reach
        yield a, b


def _leaks(text: str | None, block: _Block) -> list[tuple[int, float, int, int, int]]:
    """``(item, score, matches, first word, past-the-end word)`` of the best alignment with each item that the text leaks."""
    words = word_hashes(text)
    grams = ngrams(words, block.how.n)
    if not len(grams):
        return []
    likely = np.flatnonzero(block.sieve[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
    seed = _positions(grams[likely], block.seeds)
    likely, seed = likely[seed >= 0], seed[seed >= 0]
    if not len(seed):
        return []
    times = block.first[seed + 1] - block.first[seed]
    where = np.repeat(block.first[seed], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, start = block.item[where], np.repeat(likely, times) - block.place[where]
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    found: dict[int, tuple] = {}
    edges = np.r_[0, np.flatnonzero(np.diff(item)) + 1, len(item)]
    for begin, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        item_id, own = block.items[item[begin]]
        for a, b in _windows(start[begin:stop], len(own), len(words)):
            score, matches, first, end = align(own, words[a:b])
            if block.how.is_leak(len(own), score, matches, end - first):
                new = (score / (MATCH * len(own)), matches, a + first, a + end)
                if item_id not in found or new[0] > found[item_id][0]:
                    found[item_id] = new
    return [(item_id, *best) for item_id, best in found.items()]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    held, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy("i").toLocalIterator():
        words = word_hashes(r["t"])
        if r["i"] is None or not len(words):
            continue
        held += [(r["i"], words[k : k + ITEM_WORDS]) for k in range(0, len(words), ITEM_WORDS)]
        size += len(words)
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _frequencies(docs: DataFrame, block: _Block) -> tuple[np.ndarray, int]:
    """Documents that hold each known n-gram, over the whole corpus, and documents in all."""
    known, sieve, n = block.known, _sieve(block.known), block.how.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(len(known), dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                documents += 1
                grams = ngrams(word_hashes(text), n)
                grams = grams[sieve[(grams & np.uint64(0xFFFFF)).astype(np.int64)]]
                if len(grams):
                    at = _positions(grams, known)
                    total[np.unique(at[at >= 0])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([documents, *total[some].tolist()], pa.int64())], ["gram", "n"])

    counts = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out, documents = np.zeros(len(known), dtype=np.int64), 0
    for r in counts.toLocalIterator():  # at most the n-grams of a block
        if r["gram"] < 0:
            documents = r["n"]
        else:
            out[r["gram"]] = r["n"]
    return out, documents


def _ready(docs: DataFrame, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str, how: Leaks) -> Iterator:
    """A broadcast block of items with their seeds for each pass."""
    texts = docs.select(F.col(text_col).alias("text"))
    for some in _blocks(items, item_id_col, item_text_col):
        block = _Block(some, how)
        block.seed(*_frequencies(texts, block))
        yield docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_WORDS bounds it


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", how: Leaks = DEFAULT) -> DataFrame:
    """``id, item_id, score, matches, first_word, end_word`` for each document and test item it leaks.

    ``score`` is the alignment's share of the item's best possible score.  Words are runs of
    letters and digits of any script, so quotation marks, dashes and the like part them.
    Null, empty and word-less texts leak nothing, and items without words or id are left out.
    An item of fewer than ``how.n`` words leaks only into a text of just these words.
    Rows of equal text or id are judged one by one.  An item of more than ``ITEM_WORDS`` words
    is taken in parts, and the best part counts.  Without documents or items there are no
    rows.  Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item_id long, score double, matches int, first_word int, end_word int"
    out = None
    for sent in _ready(docs, text_col, items, item_id_col, item_text_col, how):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *leak) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in _leaks(t, sent.value)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "item_id", "score", "matches", "first_word", "end_word"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item_id": item_id_col})


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", how: Leaks = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; each row is judged by its own text, and none is shuffled."""
    small_batches(docs.sparkSession)
    out = docs
    for sent in _ready(docs, text_col, items, item_id_col, item_text_col, how):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not _leaks(t, sent.value) for t in batch.column("text").to_pylist()]
                yield batch.select(["row"]).filter(pa.array(clean, pa.bool_()))

        row: Column = F.struct(*out.columns).alias("row")
        schema = StructType([StructField("row", StructType(docs.schema.fields))])
        out = out.select(row, F.col(text_col).alias("text")).mapInArrow(run, schema).select("row.*")
    return out
