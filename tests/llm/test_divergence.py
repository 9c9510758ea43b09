import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tidemark.llm import divergence as d

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plainly(rows, least=3, top=200):
    """Rows of the contract from ``(lang, source, text)``, a fraction at a time."""
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(words)
        in_docs[lang or ""].update(set(words))
    out = []
    for lang in in_docs:
        kept = sorted((t for t, n in in_docs[lang].items() if n >= least), key=str.encode)
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(mine.values(), Counter())

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + floor(Fraction(10**9 * (counts[t] + 1), total)) for t in kept}

        apart = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        for s in mine:
            parts = {"pair": [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s], "term": [(t, apart(p[s][t], q[t])) for t in kept if mine[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def fixture():
    words = "the and of \u00e9t\u00e9 na\u00efve \u6f22\u5b57 Zeta zeta ALPHA beta \u00c9T\u00c9 \U0001f600 x y z \uffee \U00010000".split()
    rows = []
    for i in range(400):
        text = " ".join(words[(i * 7 + j * j) % len(words)] + ("" if j % 5 else str(j)) for j in range(i % 30))
        rows.append((["en", "de", None][i % 3], None if i % 11 == 0 else f"s{i % 3 if i % 2 else i % 7}", text))
    rows += [("one", "only", "a a a"), ("one", "only", "a b"), ("one", "only", "a")]
    rows += [("none", "p", "rare words here"), ("none", "q", None), ("none", "r", "")]
    return rows + [("en", "s1", "again again")] * 5 + [("en", "long", "lorem ipsum " * 40_000)]


@pytest.mark.parametrize("sizes", [None, (3, 7, 2, 5, 2)])
def test_rows(spark, monkeypatch, sizes):
    """As exact fractions have it: nulls, empty and long texts, repeated rows, ties, groups without terms, clashing columns; also with chunks and blocks of a few."""
    if sizes:
        for name, value in zip(("CHUNK_TERMS", "CHUNK_COUNTS", "BLOCK", "HELD_TERMS", "CHUNKS_A_TASK"), sizes, strict=True):
            monkeypatch.setattr(d, name, value)
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, value int, term int")
    got = sorted(tuple(r) for r in d.divergence(df).collect())
    assert got == plainly(rows)
    assert {r[2] for r in got if r[0] == "none"} == {"pair"} and all(r[2] == "term" for r in got if r[0] == "one")


def test_parameters_and_empty_table(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in d.divergence(df, least_docs=20, top=2).collect()) == plainly(rows, 20, 2)
    assert d.divergence(df.limit(0)).count() == 0


def test_exact_arithmetic():
    counts = np.array([0, 5, 1 << 40, (1 << 61) + 1, 3])
    assert d._exact_bincount(np.array([0, 2, 1, 3, 5]), counts, 6).tolist() == [0, 1 << 40, 5, (1 << 61) + 1, 0, 3]
    counts = np.array([7_000_000_000_000, 8_999_999_999, 0])
    assert d.shares(counts, 8_123_456_789_012_345).tolist() == [1 + 10**9 * (int(c) + 1) // 8_123_456_789_012_345 for c in counts]


def test_long_texts_in_slabs(monkeypatch):
    text = "ab  CD1\u00e9f ".encode() * 50 + b"q" * 40
    whole = [w for part in d._slabs(text) for w in part]
    monkeypatch.setattr(d, "SLAB", 7)
    assert [w for part in d._slabs(text) for w in part] == whole and whole[:3] == [b"ab", b"cd", "\u00e9f".encode()]
