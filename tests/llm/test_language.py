import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm.language import ALPHA, BETA, BUCKETS, L1, L2, UNDECIDED, Regression, _nll, fit, identified, ngram_counts


def test_ngram_counts():
    assert len(ngram_counts(None)[0]) == len(ngram_counts("")[0]) == len(ngram_counts("12 .-")[0]) == 0
    found, counts = ngram_counts("ab")
    # one: boundary twice, a, b; two: three pairs; three: two triples
    assert counts.sum() == 4 + 3 + 2
    for a, b in [("Ab, c!", "aB -- C"), ("été", "ÉTÉ")]:
        assert all(np.array_equal(x, y) for x, y in zip(ngram_counts(a), ngram_counts(b), strict=True))


def plain_ftrl(rows, classes):
    """Follow-the-regularised-leader one weight at a time, as it is published."""
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= L1:
            return 0.0
        return -(z[key] - math.copysign(L1, z[key])) / ((BETA + math.sqrt(n[key])) / ALPHA + L2)

    for found, x, label in rows:
        w = {(f, c): weight((f, c)) for f in found for c in range(classes)}
        score = [sum(v * w[f, c] for f, v in zip(found, x, strict=True)) for c in range(classes)]
        total = sum(math.exp(s) for s in score)
        for f, v in zip(found, x, strict=True):
            for c in range(classes):
                g = v * (math.exp(score[c]) / total - (c == label))
                old = n.get((f, c), 0.0)
                z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / ALPHA * w[f, c]
                n[f, c] = old + g * g
    return {key: weight(key) for key in z}


def test_against_plain_ftrl():
    rng = random.Random(6)
    rows = [(sorted(rng.sample(range(40), 6)), [rng.random() for _ in range(6)], rng.randrange(3)) for _ in range(120)]
    model = Regression(3)
    for found, x, label in rows:
        model.learn(np.array(found), np.array(x), label)
    want = plain_ftrl(rows, 3)
    got = model.weights()
    assert {key: got[key] for key in want} == pytest.approx(want)
    assert np.count_nonzero(got) == sum(v != 0 for v in want.values())


def test_sparse_weights_and_temperature():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    names = sorted({d["lang"] for d in docs if d["lang"]})
    rows = [(*ngram_counts(d["text"]), names.index(d["lang"])) for d in docs if d["lang"] and d["text"]][:600]
    seen = np.zeros(BUCKETS)
    for found, _, _ in rows:
        seen[found] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    w, temperature = fit(rows, idf, len(names))
    known = seen > 0
    assert np.count_nonzero(w[~known]) == 0
    assert np.count_nonzero(w[known]) < 0.5 * w[known].size  # the penalty leaves most weights at nothing
    scores, labels = np.array([[2.0, 0.0], [0.0, 1.0], [3.0, 0.0], [0.5, 0.0]]), np.array([0, 1, 0, 1])
    best = min(np.geomspace(0.02, 5, 60), key=lambda t: _nll(scores, labels, t))
    assert _nll(scores, labels, best) <= _nll(scores, labels, 1.0) and 0.02 <= temperature <= 5
    assert _nll(scores, labels, 1.0) == pytest.approx(np.mean([math.log(sum(math.exp(v - s[y]) for v in s)) for s, y in zip(scores.tolist(), labels, strict=True)]))


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identified(docs).toPandas()
    truth = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas().set_index("doc_id").lang
    held = got[got.held_out]
    assert len(got) == len(truth) and 100 < len(held) < 300
    assert (held.lang_pred.values == truth[held.doc_id].values).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_edges(spark):
    df = spark.createDataFrame([(i, w * 5, lang, "x") for i in range(60) for w, lang in [(f"the cat {i} sat ", "en"), (f"der hund {i} lief ", "de")]] + [(900, None, "en", "y"), (901, "12 34", "en", "y"), (902, "the cat", None, "z"), (None, "der hund", "de", None), (903, "the cat " * 20000, "en", "z")], "doc_id long, text string, lang string, score string")
    got = identified(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 125
    assert by[900].lang_pred == by[901].lang_pred == UNDECIDED and by[900].score == 0
    assert by[902].lang_pred == by[903].lang_pred == "en" and by[None].lang_pred == "de" and by[None].held_out
    assert identified(df.limit(0)).count() == 0
    bare = identified(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in bare} == {UNDECIDED}
