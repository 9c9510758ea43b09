import itertools
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import toxicity
from tidemark.llm.toxicity import DECAY, ORDER, Model, _window, kernel, normalised, scored


def plain_kernel(a, b):
    """Sum over all pairs of index tuples that spell the same string."""
    def parts(s):
        out = {}
        for at in itertools.combinations(range(len(s)), ORDER):
            key = "".join(s[k] for k in at)
            out[key] = out.get(key, 0) + DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = parts(a), parts(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


@pytest.mark.parametrize("a,b", [("idiot", "idiot"), ("id-iot", "idiot"), ("aaaa", "aaa"), ("abcabc", "cba"), ("ab", "abc"), ("", "abc"), ("stupid", "stooped")])
def test_kernel(a, b):
    assert kernel([a], [b])[0] == pytest.approx(plain_kernel(a, b))


def test_kernel_of_many():
    a, b = ["clown", "xx", "moron", "m.o.r.o.n"], ["clown", "moron", "clown", "moron"]
    assert kernel(a, b) == pytest.approx([plain_kernel(x, y) for x, y in zip(a, b, strict=True)])
    assert normalised(["clown"], ["clown"])[0] == pytest.approx(1)


def rows():
    rng = np.random.default_rng(0)
    plain = ["river", "stone", "walks", "under", "bright", "seven", "garden", "letter", "wooden", "quiet"]
    bad = ["moron", "scumbag", "pathetic"]
    out = []
    for k in range(300):
        words = rng.choice(plain, 30).tolist()
        if k % 3 == 0:
            words.insert(int(rng.integers(30)), str(rng.choice(bad)))
        out.append((" ".join(words) + ".", int(k % 3 == 0)))
    return out


def test_gaps_and_inserted_characters():
    model = Model(rows())
    clean, toxic, gapped = model.scores(["the quiet garden under the bright stone", "what a moron", "what a mor-on"])
    spaced = model.scores(["you m o r o n sit"])[0]
    assert clean < 0.1 and toxic > 0.9 and gapped > 0.5 and spaced > 0.5
    assert model.scores([None, ""])[0] < 0.5


def test_characters_in_every_gap():
    model = Model(rows())
    forms = ["m.o.r.o.n", "m--o--r--o--n", "m*or*on", "mo***ron", "p-a-t-h-e-t-i-c", "p*a.t-h_e+t~i:c", "s..c..u..m..b..a..g", "s*cu*mbag", "river-moron"]
    assert [f for f, v in zip(forms, model.scores([f"the quiet {f} under" for f in forms]), strict=True) if v <= 0.5] == []
    assert max(model.scores(["r.i.v.e.r", "g--a--r--d--e--n", "more rain", "a scarf", "well-worn path"])) < 0.5


def test_held_out_in_each_language(spark):
    """Recall and clean texts left alone, on held-out rows; languages are read for this report only."""
    where = "/root/testdata/sf0.1/"
    docs, labels = (spark.read.parquet(f"{where}{t}.parquet") for t in ("documents", "labels"))
    got = scored(docs, labels).toPandas().set_index("doc_id")
    truth = pq.read_table(f"{where}labels.parquet").to_pandas().set_index("doc_id").toxic
    lang = pq.read_table(f"{where}documents.parquet", columns=["doc_id", "lang"]).to_pandas().set_index("doc_id").lang
    both = got.join(truth, how="inner").join(lang)
    held = both[both.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (held.predicted == held.toxic).mean() > 0.97
    for _, rows in held.groupby("lang"):
        toxic, clean = rows[rows.toxic == 1].predicted, rows[rows.toxic == 0].predicted
        assert toxic.mean() >= 0.85 and clean.mean() <= 0.04
    assert held[held.toxic == 1].predicted.mean() >= 0.9


def test_window():
    text = " ".join(f"w{k}" for k in range(5000))
    part = _window(text, 1000)
    assert part in text and len(part) == 1000 and part[0] == "w" and _window("short", 1000) == "short"


def test_edges(spark):
    data = [(k, t) for k, (t, _) in enumerate(rows())]
    df = spark.createDataFrame([(*r, "x") for r in [*data, (9000, None), (9001, ""), (None, "a moron"), (9002, "river " * 20000), (9002, "what a moron")]], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([(k, y, 1) for k, (_, y) in enumerate(rows())] + [(0, 0, 1), (5, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    got = scored(df, marks).collect()
    assert len(got) == 305
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[9000][0].score == by[9001][0].score < 0.5 and by[None][0].held_out and by[None][0].predicted == 1
    assert sorted(r.predicted for r in by[9002]) == [0, 1]
    assert {r.score for r in scored(df, marks.limit(0)).collect()} == {0.0}
    assert scored(df.limit(0), marks).count() == 0


def test_fit_holds_words_of_one_text_at_a_time():
    """The driver's memory follows different words, not all words of all sampled texts and their substrings."""
    rng = random.Random(5)
    common = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(5000)]
    texts = [" ".join(rng.choices(common, k=300) + ["".join(rng.choices("klmnopqrst", k=10)) for _ in range(60)]) for _ in range(600)]
    tracemalloc.start()
    try:
        toxicity.choose_landmarks(texts[:300], texts[300:])
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()


def test_counts_in_few_bins_and_words_in_parts(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=8)).title() + "!" for _ in range(40)]
    some = set(words[:40])
    brute = Counter(s for t in texts for s in set().union(*[toxicity._substrings("^" + w) for w in {x.strip("!").lower() for x in t.split()} & some]))
    marks = ["^abcab", "cabca", "bbacc"]
    whole = toxicity.Matcher(marks)
    whole.learn(set(words))
    monkeypatch.setattr(toxicity, "STRING_BINS", 16)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    assert toxicity._counted(texts, some, 4) == {s: n for s, n in brute.items() if n >= 4}
    parts = toxicity.Matcher(marks)
    parts.learn(set(words))
    assert any(f is not None for f in whole.memo.values())
    assert {w: None if f is None else f.tolist() for w, f in parts.memo.items()} == {w: None if f is None else f.tolist() for w, f in whole.memo.items()}
