import random

import numpy as np
import pytest

from tidemark.llm.decontamination import DEFAULT, GAP, MATCH, MISMATCH, Leaks, _windows, align, contaminated, decontaminated, word_hashes


def plain_score(a, b):
    """The textbook table, cell by cell."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = max(0, table[i][j] + (MATCH if a[i] == b[j] else MISMATCH), table[i][j + 1] + GAP, table[i + 1][j] + GAP)
    return max(map(max, table))


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    rng = random.Random(seed)
    a = np.array(rng.choices(range(6), k=rng.randrange(1, 12)))
    b = np.array(rng.choices(range(6), k=rng.randrange(1, 25)))
    score, matches, begin, end = align(a, b)
    assert score == plain_score(a.tolist(), b.tolist())
    assert 0 <= begin <= end <= len(b) and matches <= end - begin
    if score:
        assert plain_score(a.tolist(), b[begin:end].tolist()) == score


def brute(docs, items, how=DEFAULT):
    """Every document aligned as a whole with every item."""
    out = set()
    for d, text in docs:
        words = word_hashes(text)
        for i, item in items:
            own = word_hashes(item)
            if i is not None and 0 < len(own) < how.n:
                if words.tolist() == own.tolist():
                    out.add((d, i))
            elif i is not None and len(own) and len(words):
                score, matches, first, end = align(own, words)
                if how.is_leak(len(own), score, matches, end - first):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("how", [DEFAULT, Leaks(min_score=0.8, min_matches=12), Leaks(long_matches=30)])
def test_against_brute_force(spark, how):
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 9, 25, 60, 200])))) for k in range(12)]
    docs = [(1000, items[0][1]), (1001, "  ".join(items[5][1].upper().split()))]
    for k in range(150):
        words = rng.choices(vocabulary, k=rng.choice([0, 20, 300]))
        part = items[k % 12][1].split()
        a, b = sorted(rng.choices(range(len(part) + 1), k=2)) if k % 2 else (0, len(part))
        part = [w if rng.random() > 0.15 else rng.choice(vocabulary) for w in part[a:b] if rng.random() > 0.1]
        docs.append((k, " ".join(words + part + words[:7])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    item_df = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, how)
    assert 5 < len(want) < 120
    assert {(r.doc_id, r.item_id) for r in contaminated(df, item_df, how=how).collect()} == want
    assert {r.doc_id for r in decontaminated(df, item_df, how=how).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_long_texts_and_marks(spark):
    rng = random.Random(9)
    item = [f"term{k}" for k in range(40)]
    repeated = " ".join(item[:20]) + " "
    other = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    docs = [(1, repeated * 15_000), (2, other), (3, other + " " + " ".join(item) + " " + other[:1000]), (4, "“" + "” — «".join(item) + "»"), (5, None)]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: round(r.score, 3) for r in got} == {1: 0.5, 3: 1.0, 4: 1.0}
    assert all(b - a <= 240 for a, b in _windows(np.arange(0, 100_000, 3), 40, 100_000))


def test_long_run_of_a_longer_item(spark):
    item = [f"term{k}" for k in range(200)]
    docs = [(1, "a b c " + " ".join(item[50:140]) + " d e f"), (2, "a b c " + " ".join(item[50:90]) + " d e f")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.matches, r.first_word, r.end_word) for r in got] == [(1, 90, 3, 93)]


def test_columns_are_carried(spark):
    df = spark.createDataFrame([(1, "a b", 5), (None, None, None)], "text_id long, text string, row int")
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert sorted(map(tuple, decontaminated(df, items).collect()), key=str) == sorted([(1, "a b", 5), (None, None, None)], key=str)
    assert decontaminated(df, items).columns == df.columns and decontaminated(df.limit(0), items).count() == 0


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"word{k}" for k in range(4000)]
    common = ["the", "of", "and", "to"]
    item = [rng.choice(vocabulary) if k % 3 else rng.choice(common) for k in range(40)]
    other = rng.choices(vocabulary, k=25)

    def around(part):
        return " ".join(rng.choices(vocabulary, k=60) + part + rng.choices(vocabulary, k=60))

    edited = [w if k % 6 else "changed" for k, w in enumerate(item)]
    shortened = [w for k, w in enumerate(item) if k % 7]
    lengthened = [x for k, w in enumerate(item) for x in ([w, "really"] if k % 6 == 0 else [w])]
    docs = [(1, around(item)), (2, around(edited)), (3, around(shortened)), (4, around(lengthened)), (5, around(rng.choices(vocabulary, k=40))), (6, around(item[:8])), (7, None), (8, ""), (9, "... !!"), (10, " ".join(item).upper() + "."), (11, around(item) + " " + around(other)), (11, around(item))]
    docs += [(100 + k, around(item)) for k in range(50)]
    docs += [(1000 + k, around(["the", "of", "and"] * 5)) for k in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "..."), (None, "a b c")], "item_id long, text string")
    got = contaminated(df, items).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == {(d, 1) for d in (1, 2, 3, 4, 10, 11)} | {(11, 2)} | {(100 + k, 1) for k in range(50)}
    assert all(0.5 <= r.score <= 1 for r in got)
    assert all(r.score == 1 for r in got if r.doc_id in (1, 10))
    assert contaminated(df.limit(0), items).count() == 0
    assert contaminated(df, items.limit(0)).count() == 0
