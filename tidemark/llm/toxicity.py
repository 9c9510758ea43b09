"""Operator 6: toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two strings sums over the subsequences of ``ORDER`` characters that they
share, each weighted by ``DECAY`` to the power of the lengths it spans in both, so gaps and
inserted characters weaken a match without breaking it.  Landmarks are strings that toxic
training texts hold at a multiple of the rate of clean ones; each next one is that which
most adds to the toxic texts that few others are in, so no language or kind of insult is
left without.  A sentence's features are the greatest normalised kernel that a window of its
words has with each landmark (characters that aren't letters count as gaps, not in the
window's own kernel), made orthogonal by the inverse root of the landmarks' own kernel
matrix.  A squared-hinge support vector machine is fitted on sampled, labelled sentences.
A text's score is a sigmoid, fitted like Platt's, of the margin of its worst sentence, of the
margins that its different words have alone (a word that clean texts hold too says less), and
of its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, training_fold, with_row

ORDER, DECAY = 3, 0.95
LANDMARKS = 64
#: Weight of a toxic text's worst sentence, taken as a text, beside whole texts when scores are fitted.
SENTENCE_WEIGHT = 0.1
#: Put before each word, so that a landmark can tell a word's start.
START = "^"
#: About so many training rows of each label are sampled to fit the model.
SAMPLE = {1: 1_500, 0: 3_000}
#: Of a longer sampled text a window of so many characters, at a place that its hash gives.
SAMPLE_CHARS = 20_000
#: Toxic texts, in one of three ways of putting characters into landmarks each, that are learned from besides.
GAPPED = 1_500
#: A landmark's rate in toxic texts is so many times that in clean ones.
RATIO = 4.0
#: Likelihood ratio statistic of a landmark; of millions of strings hardly one reaches it by chance.
SURPRISE = 36.0
#: Normalised kernels below this, and those with words that hold under this share of a landmark's
#: neighbouring letters (with at most two other letters and any number of other characters
#: between), count as none.
LEAST, NEIGHBOURS = 0.3, 0.75
#: Letters of a word looked at at once; longer words are read in windows that overlap by half.
WORD = 24
MEMO_WORDS = 400_000
#: Words whose parts are held at once while their features are learned.
WORDS_AT_ONCE = 16_384
#: Strings are first counted in so many bins, and one by one only those whose bin is full enough.
STRING_BINS = 1 << 20

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_SPACED = re.compile(r" \S(?: \S){2,}(?= )")
_EDGES = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "“”‘’«»¿¡…–—·"


def _codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    padded = "".join([s.ljust(width, "\0") for s in strings])
    out = np.frombuffer(padded.encode("utf-32-le", "replace"), dtype=np.int32).reshape(len(strings), width).copy()
    out[np.arange(width) >= np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))[:, None]] = pad
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Subsequence kernel of each pair ``a[k], b[k]``."""
    if not a:
        return np.zeros(0)
    x, y = _codes(a, max(1, max(map(len, a))), -1).T, _codes(b, max(1, max(map(len, b))), -2).T
    n, m = len(a), len(y)
    total = np.zeros(n)
    # inner[i][j]: weight of shared subsequences of i characters in the part of a so far and b[:j], up to both ends
    inner = [np.ones((m + 1, n))] + [np.zeros((m + 1, n)) for _ in range(ORDER - 1)]
    for letter in x:
        same = y == letter
        for j in range(m):
            total += same[j] * inner[ORDER - 1][j] * DECAY**2
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(n)
            for j in range(m):
                run = DECAY * run + same[j] * inner[i - 1][j] * DECAY**2
                inner[i][j + 1] = DECAY * inner[i][j + 1] + run
    return total


def normalised(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel of each pair, divided by the root of both strings' kernels with themselves."""
    return kernel(a, b) / np.sqrt(np.maximum(kernel(a, a) * kernel(b, b), 1e-300))


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A place among 512 for each two letters."""
    return ((first * 0x9E37 + second * 0x85EB) >> 3) & 511


def _windows(word: str, places: list[int], n: int) -> set[tuple[str, str]]:
    """Parts of a word with about as many letters as a landmark of ``n``, or so many others between them; and their letters.

    ``places`` are those of the word's letters; what stands between them takes no part in a window's size.
    """
    out = set()
    for size in (n, n + 1, n + 2, 2 * n - 1):
        for k in range(max(1, len(places) - size + 1)):
            own = places[k : k + size]
            out.add((word[own[0] : own[-1] + 1], "".join([word[p] for p in own])))
    return out


def _words(sentence: str) -> list[str]:
    """Words in lower case, and runs of single characters as one word."""
    text = sentence.lower()
    found = text.split()
    if spaced := _SPACED.findall(f" {text} "):
        found += [s.replace(" ", "") for s in spaced]
    return found


def _marked(text: str) -> str:
    return " ".join(START + w.strip(_EDGES) for w in text.lower().split())


class Matcher:
    """Features of words: the normalised kernel with each landmark, or None where all are under ``LEAST``."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.neighbours = []
        for s in landmarks:
            codes = _codes([s], len(s), 0)[0]
            self.neighbours.append(_pairs(codes[:-1], codes[1:]))
        #: Characters of landmarks count as letters.
        self.kept = set("".join([START, *landmarks]))
        odd = "".join(re.escape(c) for c in sorted(self.kept - {START}) if not c.isalpha())
        self.pieces = re.compile(rf"(?:[^\W\d_]|[{odd}]){{{ORDER},}}" if odd else rf"[^\W\d_]{{{ORDER},}}")
        self.own = dict(zip(landmarks, np.sqrt(kernel(landmarks, landmarks)), strict=True))
        self.memo: dict[str, np.ndarray | None] = {}

    def _likely(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of parts and landmarks that have most of the landmark's neighbouring letters in common."""
        codes = _codes(parts, max(4, max(map(len, parts))), -1)
        seen = np.zeros((len(parts), 512), dtype=bool)
        rows = np.arange(len(parts))[:, None]
        for gap in (1, 2, 3):
            there = codes[:, gap:] >= 0
            seen[np.broadcast_to(rows, there.shape)[there], _pairs(codes[:, :-gap], codes[:, gap:])[there]] = True
        common = np.stack([seen[:, n].mean(axis=1) >= NEIGHBOURS for n in self.neighbours], axis=1)
        return np.nonzero(common)

    def _shares(self, texts: list[str], letters: list[str], marks: list[str]) -> np.ndarray:
        """Kernel of each text with its landmark, divided by the roots of the landmark's and the text's letters' own.

        Characters put between the letters thus weaken a match by the kernel's decay alone,
        while other letters make a text another word.
        """
        distinct = list(dict.fromkeys(letters))
        own = dict(zip(distinct, np.sqrt(np.maximum(kernel(distinct, distinct), 1e-300)), strict=True))
        return kernel(texts, marks) / np.array([own[w] * self.own[s] for w, s in zip(letters, marks, strict=True)])

    def learn(self, words: set[str]) -> None:
        """Put features of words not seen before into the memo."""
        new = [w for w in words if w not in self.memo]
        if not new:
            return
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        self.memo.update(dict.fromkeys(new))
        for begin in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[begin : begin + WORDS_AT_ONCE])

    def _learn(self, new: list[str]) -> None:
        """Put the features that some words have into the memo, which holds None for each."""
        parts = []  # letters of a part, the word, their places in it, the word's number
        for k, w in enumerate(new):
            bare = START + w.strip(_EDGES)
            places = range(len(bare)) if bare[1:].isalpha() else [p for p, c in enumerate(bare) if c in self.kept or c.isalpha()]
            letters = bare if len(places) == len(bare) else "".join([bare[p] for p in places])
            for at in range(0, max(1, len(places) - WORD // 2), WORD // 2):
                if len(part := letters[at : at + WORD]) > ORDER:
                    parts.append((part, bare, places[at : at + WORD], k))
            if letters is not bare:  # words joined by hyphens and the like, each with its own start
                for piece in self.pieces.findall(bare):
                    for at in range(0, max(1, len(piece) + 1 - WORD // 2), WORD // 2):
                        part = (START + piece)[at : at + WORD]
                        parts.append((part, part, range(len(part)), k))
        parts.sort(key=lambda part: len(part[0]))  # Likely pairs are looked for in arrays as wide as the longest part.
        for begin in range(0, len(parts), 4096):
            some = parts[begin : begin + 4096]
            left, right = self._likely([part[0] for part in some])
            texts, letters, where = [], [], []
            for k, mark in zip(left.tolist(), right.tolist(), strict=True):
                _, bare, places, owner = some[k]
                for text, own in _windows(bare, list(places), len(self.landmarks[mark])):
                    texts.append(text)
                    letters.append(own)
                    where.append((owner, mark))
            if not texts:
                continue
            share = self._shares(texts, letters, [self.landmarks[mark] for _, mark in where])
            for k in np.flatnonzero(share >= LEAST):
                word, mark = new[where[k][0]], where[k][1]
                f = self.memo[word]
                if f is None:
                    f = self.memo[word] = np.zeros(len(self.landmarks))
                f[mark] = max(f[mark], share[k])

    def sentences(self, text: str | None, words: list[str] | None = None) -> list[np.ndarray]:
        """Features of the sentences of a text that have any; its words must have been learned."""
        if not text:
            return []
        hit = {w for w in set(words or _words(text)) if self.memo[w] is not None}
        if not hit:
            return []
        out = []
        for s in _SENTENCE.split(text):
            if some := [self.memo[w] for w in _words(s) if w in hit]:
                out.append(np.max(some, axis=0))
        # A run of single characters may go over sentence ends.
        return out or [np.max([self.memo[w] for w in hit], axis=0)]


def _substrings(word: str) -> set[str]:
    return {word[a:b] for a in range(len(word) - 4) for b in range(a + 5, min(len(word), a + 9) + 1)}


def _different(text: str) -> set[str]:
    """Different words of a text in lower case, without marks at their ends."""
    return {w.strip(_EDGES) for w in text.lower().split()}


def _counted(texts: list[str], words: set[str], floor: int) -> dict[str, int]:
    """How many texts hold each substring of some words, of those that at least ``floor`` of them hold.

    Words and substrings of one text at a time are in memory, and the substrings in full bins.
    """

    def held(text: str) -> set[str]:
        return set().union(*[_substrings(START + w) for w in _different(text) & words])

    bins, last = np.zeros(STRING_BINS, dtype=np.int32), STRING_BINS - 1
    for t in texts:
        own = held(t)
        bins[np.fromiter(map(hash, own), dtype=np.int64, count=len(own)) & last] += 1
    full = (bins >= floor).tobytes()
    count: Counter[str] = Counter()
    for t in texts:
        count.update(s for s in held(t) if full[hash(s) & last])
    return {s: n for s, n in count.items() if n >= floor}


def _surprise(t: int, c: int, toxic: int, clean: int) -> float:
    """Likelihood ratio statistic of a string in ``t`` of the toxic and ``c`` of the clean texts."""
    part = toxic / (toxic + clean)
    return 2 * (t * np.log(t / ((t + c) * part)) + (c * np.log(c / ((t + c) * (1 - part))) if c else 0.0))


def choose_landmarks(toxic: list[str], clean: list[str], most: int = LANDMARKS) -> dict[str, float]:
    """Strings of five to nine characters that toxic texts hold far more often than clean ones, and the logarithms of how much more."""
    often_toxic, often_clean = (Counter(w for t in texts for w in _different(t)) for texts in (toxic, clean))
    share = len(toxic) / max(1, len(clean))
    telling = {w for w, n in often_toxic.items() if n > 2 * share * often_clean[w]}
    del often_toxic
    count = _counted(toxic, telling, max(3, len(toxic) // 200))
    in_clean: Counter[str] = Counter()  # how often words of clean texts hold them, counted word by word
    for w, n in often_clean.items():
        for s in _substrings(START + w) & count.keys():
            in_clean[s] += n
    del often_clean, telling
    likely = sorted((s for s, n in count.items() if n >= RATIO / 2 * share * in_clean[s]), key=lambda s: (-count[s], -len(s), s))[:1000]
    whole = sorted({max((x for x in likely if s in x and count[x] >= 0.75 * count[s]), key=lambda x: (len(x), x)) for s in likely})
    low_toxic, low_clean = [_marked(t) for t in toxic], [_marked(t) for t in clean]
    where: dict[str, np.ndarray] = {}
    odds: dict[str, float] = {}
    for s in whole:
        held = np.array([s in t for t in low_toxic])
        t, c = int(held.sum()), sum(s in t for t in low_clean)
        ratio = (t + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (c + 0.5)
        if ratio >= RATIO and _surprise(t, c, len(toxic), len(clean)) >= SURPRISE:
            where[s], odds[s] = held, float(np.log(ratio))
    chosen: list[str] = []
    weight = np.ones(len(toxic))  # halved by each landmark that a text has
    while where and len(chosen) < most:
        best = max(where, key=lambda s: (float(weight[where[s]].sum()), len(s), s))
        held = where.pop(best)
        if weight[held].sum() < 0.5:
            break
        thirds = {best[k : k + 3] for k in range(len(best) - 2)}
        weight[held] *= 0.5
        chosen.append(best)
        for s in [x for x, other in where.items() if (other & held).sum() >= 0.9 * other.sum() and any(c in x for c in thirds)]:
            del where[s]
    return {s: odds[s] for s in chosen}


def _support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge machine, by Newton steps on the rows inside the margin."""
    x = np.c_[x, np.ones(len(x))]
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-8
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _sigmoid_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the last is the offset) of the sigmoid, on Platt's smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[x, np.ones(len(x))]
    v = np.zeros(x.shape[1])
    ridge = np.diag(np.r_[np.ones(len(v) - 1), 1e-2])  # one odd row mustn't bend the weights
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (weight * (p - target)) + ridge @ v)
        v -= step * min(1, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return v


class Model:
    """A fitted scorer; each worker builds its own memo."""

    def __init__(self, rows: list[tuple[str, int]]):
        toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
        found = choose_landmarks(toxic, clean)
        self.landmarks, self.odds = list(found), np.array(list(found.values()))
        self.matcher: Matcher | None = None
        if not self.landmarks:
            return
        m = self.ready()
        gram = np.array([normalised([s] * len(self.landmarks), self.landmarks) for s in self.landmarks])
        values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 0.1 * np.eye(len(gram)))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        rng = np.random.default_rng(0)
        # Toxic texts are learned from once more in each way of putting characters into landmarks.
        turns = [(t, (k + turn) % 3) for turn in range(3) for k, t in enumerate(toxic)][:GAPPED]
        gapped = [(self._gapped(t, rng, way), way) for t, way in turns]
        m.learn({w for t in [*toxic, *clean, *[t for t, _ in gapped]] for w in _words(t)})
        worst = [f for t in toxic for f in m.sentences(t) if f.max() > 0.95] + [f for t, _ in gapped for f in m.sentences(t) if f.max() > 0.5]
        other = [np.zeros(len(self.landmarks))] + [f for t in clean for f in m.sentences(t)]
        x = np.array(worst + other) @ self.root
        y = np.r_[np.ones(len(worst)), -np.ones(len(other))]
        cost = np.where(y > 0, 1 / max(1, len(worst)), 4 / len(other))
        cost[len(worst)] = 1.0  # sentences without any feature are the most common of all
        self.w = _support_vectors(x, y, cost)
        self.margins: dict[str, float] = {}
        self.length = 0.0
        # The worst sentence of each toxic text is learned from as a text of its own, with less weight.
        all_gaps = [t for t, way in gapped if way == 2]
        texts = [*toxic, *all_gaps, *[self._worst(t) for t in toxic], *clean]
        evidence = np.array([self._evidence(t) for t in texts])
        shown = evidence[:, 2] > 0
        self.length = float(evidence[shown, 2].mean()) if shown.any() else 0.0
        evidence[shown, 2] -= self.length
        self.sigmoid = _sigmoid_fit(evidence, np.r_[np.ones(len(texts) - len(clean)), -np.ones(len(clean))], np.repeat([1, SENTENCE_WEIGHT, 1], [len(toxic) + len(all_gaps), len(toxic), len(clean)]))
        self.matcher, self.margins = None, {}

    def _gapped(self, text: str, rng, way: int) -> str:
        """The text with one character in each landmark, with two at different places, or with one or two marks in every gap."""
        low = text.lower()
        for s in (mark.removeprefix(START) for mark in self.landmarks):
            if s in low:
                if way == 2:
                    new = ("*-._"[int(rng.integers(4))] * int(rng.integers(1, 3))).join(s)
                else:
                    new = s
                    for at in sorted(rng.choice(np.arange(1, len(s)), way + 1, replace=False).tolist(), reverse=True):
                        new = new[:at] + "*-._x"[int(rng.integers(5))] + new[at:]
                low = low.replace(s, new)
        return low

    def ready(self) -> Matcher:
        if self.matcher is None:
            self.matcher = Matcher(self.landmarks)
        return self.matcher

    def _worst(self, text: str) -> str:
        """The sentence of the greatest margin, or the whole text if none has any."""
        found = [(float((np.array(f) @ self.root @ self.w[:-1]).max()), s) for s in _SENTENCE.split(text) if (f := self.matcher.sentences(s))]
        return max(found)[1] if found else text

    def _evidence(self, text: str | None) -> tuple[float, float, float]:
        """Margin of the worst sentence, and logarithms of two sums: the cubes of different words' margins, each times the log odds of its landmark, and all words beside their usual number."""
        m, bias = self.ready(), float(self.w[-1])
        words = _words(text) if text else []
        found = m.sentences(text, words)
        if not found:
            return bias, 0.0, 0.0
        best = max(bias, float((np.array(found) @ self.root @ self.w[:-1]).max() + bias))
        hit = 0.0
        for w in set(words):
            if (f := m.memo[w]) is not None:
                if w not in self.margins:
                    self.margins[w] = max(0.0, float(f @ self.root @ self.w[:-1])) ** 3 * float(self.odds[f.argmax()])
                hit += self.margins[w]
        return best, float(np.log1p(hit)), float(np.log1p(len(words))) - self.length

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.landmarks:
            return [0.0] * len(texts)
        if len(self.margins) > MEMO_WORDS:
            self.margins.clear()
        self.ready().learn(set().union(*(_words(t) for t in texts if t)))
        return [float(1 / (1 + np.exp(-(np.dot(self._evidence(t), self.sigmoid[:-1]) + self.sigmoid[-1])))) for t in texts]


def _window(text: str, chars: int) -> str:
    """The text, or a part of it from a word's start on, at a place that the text's hash gives."""
    if len(text) <= chars:
        return text
    at = zlib.crc32(text.encode()) % (len(text) - chars + 1)
    at = text.find(" ", at) + 1 if at else 0
    return text[at : at + chars]


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None, sample_chars: int = SAMPLE_CHARS, carry: bool = False) -> DataFrame:
    """``id, held_out, score, predicted`` for each row of ``docs``; with ``carry`` also the row itself, as a struct ``row``.

    Learns from about ``sample`` labelled rows of the training fold (of several labels of an id
    the greatest counts; null labels are none), of texts longer than ``sample_chars`` from a
    window.  Null and empty texts get the score of a text without
    features.  Where there is nothing to learn from, all scores are 0.  Rows with a null id
    count as held out; rows with equal ids or texts each keep a row.  Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = sample or SAMPLE
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & training_fold(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect() if r["y"] in sample}
    picked = None
    for y, n in sizes.items():
        part = known.where((F.col("y") == y) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1.0, sample[y] / n) * (1 << 20)))
        picked = part if picked is None else picked.unionByName(part)
    model = None
    if picked is not None and len(sizes) == 2:
        # `sample` bounds the rows, also where ids repeat, and `sample_chars` what is kept of each.
        found = rows.join(F.broadcast(picked), "id").where("text IS NOT NULL").withColumn("order", F.xxhash64("id", "text"))
        cut = F.udf(lambda t: _window(t, sample_chars), "string")
        got = found.select("order", "id", cut("text").alias("text"), "y").orderBy("order", "text").limit(2 * sum(sample.values())).collect()
        if len({r["y"] for r in got}) == 2:
            model = spark.sparkContext.broadcast(Model([(r["text"], r["y"]) for r in sorted(got, key=lambda r: (r["id"], r["text"]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = model.value.scores(texts) if model else [0.0] * len(texts)
            carried = [batch.column("row")] if carry else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), *carried], ["id", "held_out", "score", "predicted", "row"][: 4 + carry])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    schema = with_row("id long, held_out boolean, score double, predicted int", docs, carry)
    return given.select("id", "text", (~training_fold("id")).alias("held_out"), *(["row"] if carry else [])).mapInArrow(run, schema).withColumnRenamed("id", id_col)
