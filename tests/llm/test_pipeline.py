import random
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import brute
from tidemark.llm.common import stored
from tidemark.llm.tokens import default_tokenizer

WORDS = {
    "en": [f"the{a}{b}" for a in "abcdefgh" for b in ("ing", "tion", "er", "ly", "ness")],
    "de": [f"ge{a}{b}" for a in "abcdefgh" for b in ("ung", "keit", "schaft", "lich", "über")],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)

    def text(lang, n=60):
        return " ".join(rng.choices(WORDS[lang], k=n))

    docs, labels = [], []
    for k in range(240):
        lang = "en" if k % 2 else "de"
        t = text(lang)
        toxic = int(k % 4 == 0)
        if toxic:
            t += " what a moron " + text(lang, 5)
        docs.append((k, t, lang))
        labels.append((k, 1, toxic))
    items = [(1, text("en", 30)), (2, text("de", 25))]
    base = text("en", 200).split()
    copies = [list(base) for _ in range(5)]
    for c in copies[1:]:
        c[rng.randrange(200)] = "changed"
    docs += [(300 + k, " ".join(c), "en") for k, c in enumerate(copies)]
    docs += [(310, docs[1][1], "en"), (311, docs[3][1].upper(), "en")]
    docs += [(320, text("en") + " " + items[0][1] + " " + text("en"), "en"), (321, items[1][1], "de")]
    docs += [(330, None, "en"), (331, "", None), (332, "12 34 -- 56", "en"), (333, docs[5][1] + " extra", None)]
    docs += [(334, text("de", 40), "de")] * 2 + [(None, text("en", 50), "en")]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs, {i for i, _, y in labels if y}


def test_against_brute_force(spark, tables):
    where, docs, toxic = tables
    got = corpus_pipeline.run(spark, where).collect()
    left = [(i, t) for i, t, _ in docs if any(c.isalpha() for c in t or "") and i not in toxic]
    named = {i: t for i, t in left if i is not None}
    kept = {i for i, _, _, keep in brute(list(named.items())) if keep} - {320, 321}
    assert {r.doc_id for r in got} == kept | {None}
    encode = Tokenizer.from_file(default_tokenizer()).encode
    texts = {**named, None: docs[-1][1]}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, parts in pieces.items():
        ids = [*encode(texts[i], add_special_tokens=False).ids, 1]
        at = 0
        for start, n, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[start : start + n]))
            at += n
        assert at == len(ids)


def test_rows_are_judged_one_by_one(spark, tables, tmp_path):
    """Of rows that share an id, or have none, only the bad ones go."""
    where, docs, _ = tables
    rng = random.Random(12)
    good = [" ".join(rng.choices(WORDS["en"], k=60)) for _ in range(7)]
    bad = good[0] + " what a moron " + good[0]
    item = next(t for i, t, _ in docs if i == 320)
    rows = [(2, good[1]), (2, bad), (None, good[2]), (None, bad), (3, good[3]), (3, None), (4, good[4]), (4, item), (5, good[5]), (6, good[5] + " more"), (6, good[6]), (6, good[6]), (None, good[6])]
    frame = spark.createDataFrame([(i, t, "en", f"s{k}", 1, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row_number long")
    table = frame.unionByName(spark.read.parquet(f"{where}/documents.parquet").withColumn("row_number", F.lit(-1).cast("long")))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stored(stage(spark, table, where), name)
        left[name] = {r.row_number for r in table.where("row_number >= 0").collect()}
    every = set(range(len(rows)))
    assert left["language"] == every - {5}
    assert left["toxicity"] == every - {5, 1, 3}
    assert len(left["near_dedup"] & {10, 11}) == 1
    assert left["near_dedup"] - {10, 11} == {0, 2, 4, 6, 7, 8}
    assert left["decontamination"] - {10, 11} == {0, 2, 4, 6, 8}


def test_stages_keep_the_columns(spark, tables):
    where, _, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns, name
        assert stage(spark, docs.limit(0), where).count() == 0, name
