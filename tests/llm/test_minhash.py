import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.components import components
from tidemark.llm import minhash
from tidemark.llm.minhash import common_counts, near_duplicates, shingles, sketch


def word_sets(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows):
    sets = {i: word_sets(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = [i for i in sets if sets[i]]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([30, 150, 600]))
        for _ in range(rng.choice([1, 3, 40])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    chain = rng.choices(vocabulary, k=200)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[3:] + rng.choices(vocabulary, k=3)
    passage = rng.choices(vocabulary, k=80)
    texts += [" ".join(passage + rng.choices(vocabulary, k=40)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[5], "one two", "One  TWO", "one two three four five", "", "  \n", None, "solo", " a\tb ", "\xa0"]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_shingles():
    for text in ["a b c d e f", "A b c d e f", "a b", "x", "é É ß x y z", "a a a a a a a a"]:
        assert len(shingles(text)) == len(word_sets(text))
    assert np.array_equal(shingles("A B C D E F"), shingles("a\tb\nc d  e f"))
    assert not np.array_equal(shingles("É"), shingles("é"))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300))
def test_sketch_takes_from_the_set(n):
    s = shingles(" ".join(map(str, range(n))))
    assert set(sketch(s, 256).tolist()) <= set(s.tolist())


def test_against_brute_force(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, kept string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_family_about_the_threshold(spark):
    """Copies of an absent text, most of them a little less similar to each other than linked ones."""
    rng = random.Random(1)
    base, rows = [f"w{k}" for k in range(600)], []
    for i in range(1500):
        copy = list(base)
        for at in rng.sample(range(600), 6):
            copy[at] = f"x{i}y{at}"
        rows.append((i, " ".join(copy)))
    # Shingles with an edited word are in one text alone.
    kept = np.array([[all(w[0] == "w" for w in words[k : k + 5]) for k in range(596)] for _, t in rows for words in [t.split()]], dtype=np.float32)
    both = (kept @ kept.T).astype(int)
    linked = 100 * both >= 85 * (2 * 596 - both)
    want = np.arange(len(rows))
    while True:
        new = np.where(linked, want[None, :], len(rows)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert 10 < len(set(want.tolist())) < len(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in got if got[i] != want[i]] == []


def test_edge_cases(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)], key=str)


def test_shared_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = near_duplicates(spark.createDataFrame([(5, a), (5, b), (3, b), (7, a), (7, None), (None, a)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, 2, 5, True), (5, 2, 3, False), (3, 2, 3, True), (7, 2, 5, False), (7, 0, 7, True), (None, 2, None, True)], key=str)


def test_long_texts(spark):
    words = [f"w{k}" for k in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[:100_000])), (4, "x" * 3_000_000), (5, "y " * 400_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (149_996, 1), 2: (139_996, 1), 3: (99_996, 3), 4: (1, 4), 5: (1, 5)}


def test_common_counts():
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, hi, rng.integers(1, 60))) for hi in rng.choice([40, 500, 10**6], n)] for n in (170, 150))
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert common_counts(left, right).tolist() == want
    assert common_counts([], right).shape == (0, 150) and common_counts([np.empty(0, np.int64)], right[:2]).tolist() == [[0, 0]]


def test_link_between_members_that_are_no_hubs(spark, monkeypatch):
    """A bucket of 100 whose only link the hubs don't see: the comparison in full finds it, in blocks of a few members."""
    monkeypatch.setattr(minhash, "MORE_HUBS", 1)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    rng = random.Random(4)
    sets = {i: sorted({*range(1000)} - {*rng.sample(range(1000), 120)}) for i in range(100)}
    sets[71] = sorted({*sets[38]} - {sets[38][5]})
    members = spark.createDataFrame([(1, i, 100, i) for i in sets], "key long, id long, n long, component long")
    frame = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, shingles array<long>")
    assert [tuple(r) for r in minhash._in_full(members, frame, 85).collect()] in ([(38, 71)], [(71, 38)])
    shared = spark.createDataFrame([(1, i, 100) for i in sets], "key long, id long, n long")
    assert {tuple(r) for r in minhash._linked(shared, frame, 85).collect()} == {(38, 38), (71, 38)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 150), (130, 129)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100), 150: 150, 200: 150}
