import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import closest_filling, minimum_slack_plan, packed
from tidemark.llm.token_files import pack, read_ids, read_packed, round_trip, unpack, width_for, write_packed
from tidemark.llm.tokens import default_tokenizer

TK = Tokenizer.from_file(default_tokenizer())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8), st.integers(0, 60))
def test_closest_filling(lengths, room):
    left = {n: lengths.count(n) for n in lengths}
    got = closest_filling(sorted(left, reverse=True), left, room)
    assert all(got[n] <= left[n] for n in got)
    best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= room)
    assert sum(n * c for n, c in got.items()) == best


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 9), max_size=20))
def test_plan_uses_each_piece_once(histogram):
    rows, sequences = minimum_slack_plan(histogram, 64)
    used, fill = dict.fromkeys(histogram, 0), {}
    for n, first, copies, repeats, sequence, offset in rows:
        assert first == used[n]
        used[n] += copies * repeats
        for k in range(repeats):
            fill.setdefault(sequence + k, []).extend((offset + n * c, n) for c in range(copies))
    assert used == histogram and sorted(fill) == list(range(sequences))
    for parts in fill.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64


def docs(spark):
    rows = [(i, " ".join(f"word{j % 7}" for j in range(i * 37 % 900)), "x") for i in range(120)]
    return spark.createDataFrame([*rows, (7, None, None), (7, "again", "y"), (None, "no id", "z"), (500, "long " * 9000, "w")], "doc_id long, text string, start string")


def expected(row, end):
    return np.array([*TK.encode(row.text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_packed(spark):
    df = docs(spark)
    got = packed(df).collect()
    sequences, per_doc = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    rows = [r for r in df.collect() if r.doc_id != 7]
    for r in rows:
        ids = expected(r, 1)
        pieces = sorted(per_doc[r.doc_id], key=lambda p: p.start)
        assert [p.start for p in pieces] == list(itertools.accumulate([0, *(p.length for p in pieces[:-1])]))
        assert sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    total = sum(r.length for r in got)
    assert total > 0.9 * 2048 * len(sequences)
    assert packed(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.data())
def test_pack_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=50)), dtype=np.uint32)
    stored = pack(ids, bits)
    assert len(stored) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert unpack(stored, bits, a, b - a).tolist() == ids[a:b].tolist()


def test_width():
    assert [width_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_files(spark, tmp_path):
    df = docs(spark)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(round_trip(df).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert [r.start for r in got] == list(itertools.accumulate([0, *(r.n_tokens for r in got[:-1])]))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(zlib.crc32(expected(r, 0).tobytes()))
    for r in got:
        assert r.ids_crc32 in by[r.doc_id]
    path = f"file://{tmp_path}/ids"
    write_packed(df, path)
    first = min(read_packed(spark, path).collect(), key=lambda r: r.start)
    assert read_ids(spark, path, 0, 0, first.n_tokens).tobytes() == first.ids
    assert round_trip(df.limit(0)).count() == 0
