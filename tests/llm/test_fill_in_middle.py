import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.fill_in_middle import cut_places, digests, fill_in_middle

TOKEN = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")


def plainly(doc_id, text, rate=50):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = TOKEN.findall(text)
    assert "".join(units) == text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate else "spm" if h[3] % 100 < 80 else "psm"
    output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    lengths = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, len(units), form, *lengths, output)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\u00a0\u2003ab\u00e9\U0001f600<P>", max_size=40)), max_size=6), st.integers(1, 9), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cut_places(texts, size, x, y):
    """Whatever the chunks, cuts are where joined tokens end."""
    n, places = cut_places(pa.array(texts, pa.string()), [np.full(len(texts), x), np.full(len(texts), y)], size)
    for k, text in enumerate(texts):
        units = TOKEN.findall(text or "")
        assert n[k] == len(units)
        assert [*places[:, k]] == [len("".join(units[: d % (len(units) + 1)])) for d in (x, y)]


def test_slices_of_arrays():
    whole = pa.array(["zz zz", "a b", None, "", "c d  "])
    n, places = cut_places(whole.slice(1), [np.array([1, 1, 1, 2])])
    assert n.tolist() == [2, 0, 0, 3] and places.tolist() == [[1, 0, 0, 3]]


def docs(spark):
    texts = ["", None, " ", "one", "a b c", "tail \n", "\u00e9t\u00e9 \U0001f600 x", "has <S> inside", "x" * 50_000, "word " * 40_000, "<", "a<P b>"]
    rows = [(i, texts[i % len(texts)], "n") for i in range(240)]
    return spark.createDataFrame([*rows, (7, "one", "again"), (7, "one", "again"), (None, "no id at all", None), (None, None, None)], "doc_id long, text string, n string")


def test_rows(spark):
    """As brute force has it, with nulls, empty and long texts, markers, shared ids, repeated rows and a column of a result's name."""
    df = docs(spark)
    got = sorted(map(repr, map(tuple, fill_in_middle(df).collect())))
    assert got == sorted(repr(plainly(r.doc_id, r.text)) for r in df.collect())
    assert {r.form for r in fill_in_middle(df).collect()} == {"plain", "psm", "spm"}


def test_digests(spark):
    df = docs(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(repr((r.doc_id, r.output_sha256, r.restored_sha256)) for r in digests(fill_in_middle(df)).collect())
    assert got == sorted(repr((r.doc_id, sha(plainly(r.doc_id, r.text)[-1]), sha(r.text or ""))) for r in df.collect())


def test_parameters_and_empty_table(spark):
    df = docs(spark)
    changed = fill_in_middle(df.where("text = 'a b c'"), rate=100, spm_rate=0, markers=("{p}", "{s}", "{m}")).collect()
    assert changed and all(r.form == "psm" and r.output.startswith("{p}") for r in changed)
    assert digests(fill_in_middle(df.limit(0))).count() == 0
