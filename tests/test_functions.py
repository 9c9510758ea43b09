import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import checksums, scripts, sqltext, types, versions

PAIRS = [(None, None, 0), (None, "3.1", -1), ("3.1", None, 1), ("4.0.7", "4.0.7", 0), ("4.0.7", "4.0.8", -1), ("2.11", "2.9.5", 1), ("5_0_1", "5_0_2", -1), ("5_0_1", "5.0.1", 0), ("Vx", "Vy", -1), ("Vy", "Vx", 1), ("6c", "7", -1), ("6c", "60", -1), ("7", "7.0", 0), ("7.0.0", "7", 0), ("", "0", 0), ("7a", "7", 1), ("B", "99", 1), (" 3 ", "3", 0), ("0", "0.0", 0), ("007", "7", 0)]


def test_version_pairs(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string, want int")
    assert df.where(versions.compare_versions(F.col("a"), F.col("b")) != F.col("want")).collect() == []


def plain_parts(v):
    import re

    out = []
    for x in re.split("[._]", v.strip()):
        m = re.fullmatch("([0-9]+)([A-Za-z]*)", x)
        out.append((0, 0, "") if not x else (0, int(m[1]), m[2].lower()) if m else (1, 0, x.lower()))
    return out


def plain_compare(a, b):
    x, y = plain_parts(a), plain_parts(b)
    n = max(len(x), len(y))
    x, y = (p + [(0, 0, "")] * (n - len(p)) for p in (x, y))
    return (x > y) - (x < y)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.text(alphabet="019aBZ._", max_size=6)] * 2), min_size=40, max_size=60))
def test_versions_random(spark, pairs):
    df = spark.createDataFrame([(a, b, plain_compare(a, b)) for a, b in pairs], "a string, b string, want int")
    assert df.where(versions.compare_versions(F.col("a"), F.col("b")) != F.col("want")).collect() == []


def signed(n):
    return n - (1 << 32) if n >= 1 << 31 else n


@pytest.mark.parametrize("text", ["", "SELECT 1;", "line1\nline2\n", "line1\r\nline2\r\n", "é ü ß", "Hello", "a\x0bb\x0cc\x1cd\x85e f"])
def test_script_checksum(spark, text):
    want = 0
    for line in text.splitlines():
        want = zlib.crc32(line.encode(), want)
    got = spark.createDataFrame([(text,)], "t string").select(checksums.script_checksum(F.col("t"))).first()[0]
    assert got == signed(want)


def test_stored_checksum(spark):
    high, low = next(c for c in (zlib.crc32(bytes([k])) for k in range(256)) if c >= 1 << 31), next(c for c in (zlib.crc32(bytes([k])) for k in range(256)) if c < 1 << 31)
    rows = [(str(high), signed(high)), (str(low), low), (None, None), (str(signed(high)), signed(high)), (f"{low}.0", low), ("x", None)]
    df = spark.createDataFrame(rows, "raw string, want int")
    assert df.where(~checksums.stored_checksum(F.col("raw")).eqNullSafe(F.col("want"))).collect() == []


NAMES = [
    ("V4.07__add_boats.sql", "SQL", "4.07", "add_boats", [], "SQL"),
    ("R__all_harbours.sql", "REPEATABLE", None, "all_harbours", [], "REPEATABLE"),
    ("U4.07__take_boats_away.sql", "UNDO_SQL", "4.07", "take_boats_away", [], "UNDO_SQL"),
    ("V5__tides[north, south].sql", "SQL", "5", "tides", ["north", "south"], "SQL"),
    ("V1__a[x][y].sql", "SQL", "1", "a[y]", ["x"], "SQL"),
    ("V1__a[x]b[x].sql", "SQL", "1", "ab", ["x"], "SQL"),
    ("VA__x.sql", "SQL", "A", "x", [], "UNKNOWN"),
    ("V1_0_0__x.py", "SQL", "1.0.0", "x", [], "SQL"),
    ("V__.sql", "SQL", None, "", [], "UNKNOWN"),
    ("beforeEachMigrate__x.sql", "CALLBACK", None, "beforeEachMigrate__x", [], "CALLBACK"),
    ("notes.txt", "UNKNOWN", None, "notes.txt", [], "UNKNOWN"),
    ("B3__base.sql", "UNKNOWN", None, "B3__base", [], "BASELINE"),
]


def test_script_names(spark):
    df = spark.createDataFrame([(n[0],) for n in NAMES], "name string")
    got = {r.name: r for r in df.select("name", scripts.parsed_name(F.col("name")).alias("p"), scripts.tags(F.col("name")).alias("tags"), scripts.quick_kind(F.col("name")).alias("quick")).collect()}
    for name, kind, version, description, tags, quick in NAMES:
        r = got[name]
        assert (r.p.kind, r.p.version, r.p.description, r.tags, r.quick) == (kind, version, description, tags, quick), name


DML = [
    ("UPDATE users SET name = 'x', u.age = 3 WHERE id = 1", "users", ["UPDATE"], ["name", "age"], False),
    ("DELETE FROM s.users", "s.users", ["DELETE"], [], True),
    ('INSERT INTO "Users" (id) VALUES (1)', "Users", ["INSERT"], [], False),
    ("TRUNCATE TABLE t", "t", None, [], False),
    ("insert into t (a) values (1) on conflict (a) do update set a = 2", "t", ["INSERT", "UPDATE"], [], False),
    ("INSERT INTO t (a) VALUES (1) ON DUPLICATE KEY UPDATE a = 2", "t", ["INSERT", "UPDATE"], [], False),
    ("MERGE INTO users u USING s ON u.id = s.id WHEN MATCHED THEN UPDATE SET a = 1 WHEN NOT MATCHED THEN INSERT (id) VALUES (1)", "users", ["INSERT", "UPDATE"], [], False),
    ("-- note\nUPDATE t SET a = 'where'", "t", ["UPDATE"], ["a"], True),
]


def test_dml(spark):
    df = spark.createDataFrame([(d[0],) for d in DML], "s string")
    s = F.col("s")
    got = {r.s: r for r in df.select("s", sqltext.dml_target(s).alias("t"), sqltext.dml_events(s).alias("e"), sqltext.updated_columns(s).alias("c"), sqltext.changes_all_rows(s).alias("all")).collect()}
    for text, *want in DML:
        r = got[text]
        assert [r.t, r.e, r.c, r["all"]] == want, text


def test_placeholders(spark):
    df = spark.createDataFrame([("a ${x} ${y:dflt} ${z} ${x:no}",)], "s string")
    assert df.select(sqltext.substituted(F.col("s"), {"x": "$1\\"})).first()[0] == "a $1\\ dflt ${z} $1\\"


def test_types(spark):
    rows = [("INT", "INTEGER"), ("INT4", "INTEGER"), ("VARCHAR2(100)", "VARCHAR"), ("NUMBER(10,0)", "INTEGER"), ("DECIMAL(10,2)", "NUMERIC"), ("geometry", "GEOMETRY")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(types.canonical_type(F.col("t")) != F.col("want")).collect() == []


def test_version_order_is_that_of_keys(spark):
    texts = ["", "0", "1", "1.0", "1.0.1", "01", "1a", "1A", "1b", "A", "b", "10", "1.10", "1.9", "100000", "1.100000", "0.0.1", "x.0", "1..2", " 1 ", "é", "12345678901234567890.1"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    keys, orders = ([f(F.col(c)) for c in "ab"] for f in (versions.version_key, versions.version_order))
    assert df.where(((keys[0] < keys[1]) != (orders[0] < orders[1])) | ((keys[0] == keys[1]) != (orders[0] == orders[1]))).count() == 0


def test_canonical_types(spark):
    rows = [("INT", "INTEGER"), ("VARCHAR2(100)", "VARCHAR"), ("NUMBER(10,0)", "INTEGER"), ("NUMBER(10)", "INTEGER"), ("NUMBER(19)", "NUMERIC"), ("NUMERIC(18, 0)", "NUMERIC"), ("TINYINT", "SMALLINT"), ("DECIMAL(10,2)", "NUMERIC"), ("odd thing", "ODD THING"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(~types.canonical_type(F.col("t")).eqNullSafe(F.col("want"))).collect() == []


def test_quotes(spark):
    rows = [("plain", False), ("1abc", False), ("", False), ("a b", True), ("Select", True), ("a$", True)]
    df = spark.createDataFrame(rows, "n string, want boolean")
    assert df.where(types.needs_quotes(F.col("n")) != F.col("want")).collect() == []


#: In the order of PEP 440; versions of one row are equal.
PEP440_ROWS = [
    ("1.dev1", "1.0.dev1", " 1.DEV-1 "), ("1a0.dev3",), ("1a0", "1.0alpha", "1_a_0", "v1.0.0-a"), ("1a2",), ("1a10",), ("1b1.dev2",), ("1b1", "1beta1"), ("1rc1", "1c1", "1-pre1", "1.preview.1"), ("1rc1.post1",),
    ("1", "1.0", "1.0.0"), ("1+abc", "1.0+ABC"), ("1+abc.1", "1+abc-1"), ("1+abd",), ("1+2",), ("1+2.x",), ("1+2.3",), ("1+10",), ("1.post0.dev1",), ("1.post0", "1-0", "1post", "1.r0"), ("1.post2", "1-2", "1.rev2"),
    ("1.0.1",), ("1.2",), ("1.10",), ("1.10.0.1",), ("2",), ("10.0",), ("1!0.1", "1!0.1.0"), ("2!0",),
]


def test_pep440_order(spark):
    flat = [(k, v) for k, row in enumerate(PEP440_ROWS) for v in row]
    got = {v: o for v, o in spark.createDataFrame(flat, "k int, v string").select("v", versions.pep440_order(F.col("v"))).collect()}
    for k, v in flat:
        for j, w in flat:
            assert (got[v] < got[w]) == (k < j) and (got[v] == got[w]) == (k == j), (v, w)
    bad = ["", "x", "1_0", "1..2", "1!", "1+", "1.0-", "a1", "1.0.post1.post2", None]
    assert all(r[0] is None for r in spark.createDataFrame([(v,) for v in bad], "v string").select(versions.pep440_order(F.col("v"))).collect())


def test_content_format(spark):
    texts = {"": "UNKNOWN", "  select 1": "SQL", "Match (n) return n": "CYPHER", "drop table t": "SQL", "def f(): pass": "PYTHON", "x = 1\nimport os": "PYTHON", "function f() {}": "JAVASCRIPT", "let a; var b": "JAVASCRIPT", '{"a": 1}': "JSON", "a: 1\nb: 2": "YAML", "two words: 1": "UNKNOWN", "{a: 1}": "UNKNOWN", "x" * 300 + "\na: 1": "UNKNOWN"}
    rows = spark.createDataFrame([(t, f) for t, f in texts.items()] + [(None, "UNKNOWN")], "t string, f string")
    assert [r for r in rows.select("t", "f", scripts.content_format(F.col("t")).alias("g")).collect() if r.f != r.g] == []
    assert scripts_format(spark, "a.PY", "select 1") == "PYTHON" and scripts_format(spark, "a.txt", "select 1") == "SQL"


def scripts_format(spark, name, content):
    return spark.createDataFrame([(name, content)], "n string, c string").select(scripts.format_of(F.col("n"), F.col("c"))).first()[0]
