"""Operator 4: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (one to three letters of the lower-cased
text, anything but letters being one boundary), hashed to a fixed number of buckets.
Document frequencies come from all training rows.  Weights are learned from a bounded
sample of them by follow-the-regularised-leader with an elastic-net penalty, which leaves
most at zero, and a temperature fitted on sampled rows that were kept apart makes the
softmax of the scores a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, training_fold, with_row

BUCKETS = 1 << 15
#: About so many training rows of each language are sampled to fit the weights.
SAMPLE_PER_LANGUAGE = 1_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.2, 0.0005
UNDECIDED = "und"

_lower: np.ndarray | None = None


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one 0 for each run of other characters than letters, and at both ends."""
    global _lower
    if _lower is None:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _lower = table
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    points = np.concatenate(([0], np.where(_lower[points], points, 0), [0])).astype(np.uint32)
    return points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams; none without letters."""
    c = _letters(text) if text else np.zeros(1, np.uint32)
    if len(c) < 2:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[1:] * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
    mixed = np.concatenate((one, two, three))
    mixed = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x7FEB352D)
    counts = np.bincount((mixed >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found].astype(np.int32)


def weights(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    w = (1 + np.log(counts)) * idf[found]
    norm = np.sqrt(w @ w)
    return w / norm if norm else w


class Regression:
    """Softmax regression trained by FTRL-proximal, one row at a time."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def at(self, found: np.ndarray) -> np.ndarray:
        z, n = self.z[found], self.n[found]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, found: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.at(found)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[found]
        more = n + g * g
        self.z[found] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[found] = more

    def weights(self) -> np.ndarray:
        return self.at(np.arange(BUCKETS))


def _nll(scores: np.ndarray, labels: np.ndarray, temperature: float) -> float:
    s = scores / temperature
    s = s - s.max(axis=1, keepdims=True)
    return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, classes: int) -> tuple[np.ndarray, float]:
    """Weights and temperature from sampled ``(buckets, counts, label)``; each fifth row is kept for the temperature."""
    data = [(f, weights(f, c, idf), y) for f, c, y in rows if len(f)]
    order = np.random.default_rng(0).permutation(len(data))
    held, used = order[: len(data) // 5], order[len(data) // 5 :]
    model = Regression(classes)
    for _ in range(EPOCHS):
        for k in used:
            model.learn(*data[k])
    w = model.weights()
    temperature = 1.0
    if len(held):
        scores = np.array([data[k][1] @ w[data[k][0]] for k in held])
        labels = np.array([data[k][2] for k in held])
        temperature = min(np.geomspace(0.02, 5, 60), key=lambda t: _nll(scores, labels, t))
    return w, float(temperature)


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[ngram_counts(text)[0]] += 1
                n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *total[some].tolist()], pa.int64())], ["bucket", "n"])

    out, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for r in rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # BUCKETS rows at most
        if r["bucket"] < 0:
            n = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, n


def _sampled(training: DataFrame, shares: dict[str, float], most: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """N-gram counts and language of the rows that hash below their language's share; ``most`` bounds them where rows repeat."""
    share = F.lit(0.0)
    for lang, s in shares.items():
        share = F.when(F.col("lang") == lang, F.lit(s)).otherwise(share)
    picked = training.withColumn("order", F.xxhash64("id", "text")).where(F.pmod("order", F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [ngram_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.tobytes() for f, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary()), batch.column(3)], ["id", "lang", "found", "counts", "order"])

    rows = picked.select("id", "text", "lang", "order").mapInArrow(run, "id long, lang string, found binary, counts binary, order long").orderBy("order").limit(most).collect()
    return [(np.frombuffer(r["found"], np.int32), np.frombuffer(r["counts"], np.int32), r["lang"]) for r in sorted(rows, key=lambda r: (r["id"], r["lang"], r["found"]))]


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, carry: bool = False) -> DataFrame:
    """``id, held_out, lang_pred, score`` for each row of ``docs``; with ``carry`` also the row itself, as a struct ``row``.

    Learns from rows of the training fold with a language; ``lang_pred`` is one of theirs, or
    ``und`` with score 0 for null texts, texts without a letter, and where there is nothing
    to learn from.  Rows with a null id count as held out.  Rows with equal ids or texts each
    keep a row, equal texts with equal results.  Of ``docs``, only these three columns are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    training = rows.where(training_fold("id") & F.col("lang").isNotNull())
    # One row for each language.
    sizes = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    schema = with_row("id long, held_out boolean, lang_pred string, score double", docs, carry)
    model = None
    if names:
        frequency, n = _document_frequencies(training)
        idf = np.log((1 + n) / (1 + frequency)) + 1
        picked = _sampled(training, {lang: min(1.0, sample / sizes[lang]) for lang in names}, 2 * sample * len(names))
        w, temperature = fit([(f, c, names.index(lang)) for f, c, lang in picked], idf, len(names))
        model = spark.sparkContext.broadcast((w / temperature, idf))  # buckets times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, idf = model.value if model else (None, None)
        for batch in batches:
            best, score = [], []
            for text in batch.column(1).to_pylist():
                found, counts = ngram_counts(text)
                if w is None or not len(found):
                    best.append(UNDECIDED)
                    score.append(0.0)
                    continue
                s = weights(found, counts, idf) @ w[found]
                k = int(s.argmax())
                best.append(names[k])
                score.append(float(1 / np.exp(s - s[k]).sum()))
            carried = [batch.column("row")] if carry else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best, pa.string()), pa.array(score, pa.float64()), *carried], ["id", "held_out", "lang_pred", "score", "row"][: 4 + carry])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    return given.select("id", "text", (~training_fold("id")).alias("held_out"), *(["row"] if carry else [])).mapInArrow(run, schema).withColumnRenamed("id", id_col)
