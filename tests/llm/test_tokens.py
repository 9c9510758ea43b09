import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.token_counts import longest_prefix, prefix_table, tokens_at, truncated, with_prefix_counts, PrefixCounter
from tidemark.llm.tokens import PieceWise, default_tokenizer, id_encoder

PATH = default_tokenizer()
TK = Tokenizer.from_file(PATH)
ODD = ["", " ", "a", "\n", "a b", " a", "a ", "a  b", "a\n\nb c", "it's we're  x'r", "we'll' 's", "x\t y  z", "<|endoftext|>", "a <|endoftext|> b<|endoft", "a  <|endoftext|>", "日本<|endoftext|><|endoftext|>語<|endof", "x <|endoftext|>  <|endoftext|> y", "naïve — “quote”", "日本語 テキスト", "🙂🙂 a", "=====----    ----", "1234 5678.90", "\r\n a", "a\x1c b", "　 a b", " \n \n x"]


def whole(text):
    return TK.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_odd(text):
    assert np.frombuffer(id_encoder(PATH)(text), dtype="<u4").tolist() == whole(text)


@pytest.mark.parametrize("text", ODD)
def test_prefix_counts_odd(text):
    assert prefix_table(text).tolist() == [len(whole(text[:k])) for k in range(1, len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdetrsl's  \n\t.,!-12é日🙂 <|>")), max_size=60))
def test_both_random(text):
    assert np.frombuffer(id_encoder(PATH)(text), dtype="<u4").tolist() == whole(text)
    assert prefix_table(text).tolist() == [len(whole(text[:k])) for k in range(1, len(text) + 1)]


def test_real_texts():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:80]
    for text in texts:
        assert np.frombuffer(id_encoder(PATH)(text), dtype="<u4").tolist() == whole(text)
        counts = prefix_table(text)
        assert counts[-1] == len(whole(text))
        for k in range(1, min(len(text), 4000), 97):
            assert counts[k - 1] == len(whole(text[:k]))


def test_long_white_space_run():
    text = "a" + " " * 5000 + "b"
    assert prefix_table(text)[-1] == len(whole(text))
    assert prefix_table(text)[3000] == len(whole(text[:3001]))


def test_long_text_without_spaces_but_with_specials():
    rng = np.random.default_rng(3)
    letters = "".join(map(chr, rng.integers(0x4E00, 0x9000, 1_000_000)))
    cuts = sorted(rng.integers(0, len(letters), 50).tolist())
    text = "<|endoftext|>".join(letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)) + "<|endoftext|><|endoftext|><|endof"
    began = time.perf_counter()
    counts = prefix_table(text)
    assert time.perf_counter() - began < 120
    at = text.index("<|endoftext|>")
    for k in [1, at - 1, at, at + 1, at + 12, at + 13, at + 14, 5000]:
        assert counts[k - 1] == len(whole(text[:k])), k
    assert counts[-1] == len(whole(text))


def test_questions():
    text = "the budget of a text is counted in tokens, not in characters"
    deltas = np.diff(prefix_table(text), prepend=0).astype("<i2").tobytes()
    k = longest_prefix(deltas, 5)
    assert tokens_at(deltas, k) <= 5 < tokens_at(deltas, k + 1)
    assert longest_prefix(deltas, 0) == 0 and longest_prefix(deltas, 10**6) == len(text)


def test_dataframe(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (2, "", None), (None, "é", "z")], "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in with_prefix_counts(df).collect()}
    assert got == {(1, 3, 2), (2, 0, 0), (None, 2, len(whole("é")))}
    assert with_prefix_counts(df.limit(0)).count() == 0
    assert {r.text for r in truncated(with_prefix_counts(df, with_text=True), 1).collect()} == {"a", None, "", "é"}
