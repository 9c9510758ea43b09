import pytest
from pyspark.sql import functions as F

from tidemark.functions import textdiff
from tidemark.operators import graph, history, journal, state, undo
from tidemark.sources import tables
from tidemark.streaming.journal import read_journal, running_times


def rows(spark, *some):
    """History rows (rank, version, type, success) of one database."""
    data = [("d", r, v, t, ok, f"V{v}__t.sql", 1, "x") for r, v, t, ok in some]
    return spark.createDataFrame(data, "db string, installed_rank long, version string, type string, success boolean, script string, checksum int, description string")


def versions(df):
    return {r.version for r in df.collect()}


def test_undone(spark):
    assert versions(history.undone_versions(rows(spark, (1, "1", "SQL", True), (2, "1", "UNDO_SQL", True)))) == {"1"}
    assert versions(history.undone_versions(rows(spark, (2, "1", "UNDO_SQL", False)))) == set()


def test_reapplied(spark):
    again = rows(spark, (1, "1", "SQL", True), (2, "1", "UNDO_SQL", True), (3, "1", "SQL", True))
    assert versions(history.reapplied_after_first_undo(again)) == versions(history.reapplied_after_last_undo(again)) == {"1"}
    twice = rows(spark, (1, "1", "SQL", True), (2, "1", "UNDO_SQL", True), (3, "1", "SQL", True), (4, "1", "UNDO_SQL", True))
    assert versions(history.reapplied_after_first_undo(twice)) == {"1"} and versions(history.reapplied_after_last_undo(twice)) == set()
    assert versions(history.effectively_undone(twice)) == {"1"} and versions(history.effectively_undone(again)) == set()


@pytest.mark.parametrize("order,late", [(["1", "2", "3"], set()), (["1", "3", "2"], {"2"}), (["1_1", "2_0", "1_2"], {"1_2"})])
def test_out_of_order(spark, order, late):
    h = rows(spark, *[(k, v, "SQL", True) for k, v in enumerate(order, 1)])
    assert versions(history.out_of_order_adjacent(h)) == late == versions(history.out_of_order_global(h))


def test_current(spark):
    h = rows(spark, (1, "1.9", "SQL", True), (2, "1.10", "PYTHON", True), (3, "2", "SQL", False), (4, "1.10.0", "SQL", True))
    assert history.current_version(h).first().current_version == "1.10"
    assert history.current_version(h.limit(0)).count() == 0


def shown(spark, some, names):
    """States of history rows (rank, version, type, success, script, checksum) with script files of these names."""
    h = spark.createDataFrame([("d", r, v, t, ok, s, c, "x", "me", 1) for r, v, t, ok, s, c in some], "db string, installed_rank long, version string, type string, success boolean, script string, checksum int, description string, installed_by string, execution_time int")
    s = spark.createDataFrame([("d", k, n, "select 1") for k, n in enumerate(names)], "db string, script_id long, name string, content string")
    return h, s, {r.installed_rank: r.state for r in state.history_states(h, s).collect()}


def test_states(spark):
    some = [
        (1, "1", "SQL", True, "V1__a.sql", 1), (2, "3", "SQL", True, "V3__a.sql", 1), (3, "2", "SQL", True, "V2__a.sql", 1),
        (4, "1", "UNDO_SQL", True, "U1__a.sql", 1), (5, "4", "SQL", True, "V4__a.sql", 1), (6, "4", "UNDO_SQL", True, "U4__a.sql", 1), (7, "4", "SQL", True, "V4__a.sql", 1),
        (8, None, "REPEATABLE", True, "R__v.sql", 5), (9, None, "REPEATABLE", True, "R__v.sql", 5), (10, None, "REPEATABLE", True, "R__w.sql", 5), (11, None, "REPEATABLE", True, "R__w.sql", 6),
        (12, "9", "SQL", False, "V9__gone.sql", 1), (13, "0.5", "SQL", False, "V0.5__gone.sql", 1), (14, "9", "OTHER", True, "X9__gone.sql", 1), (15, "3.5", "SQL", True, "V3.5__gone.sql", 1),
        (16, "1", "DELETE", True, "V1__a.sql", 1), (17, "7", "BASELINE", True, "B7__b.sql", 1), (18, "8", "SQL", None, "V8__a.sql", 1), (19, "8", "SQL", False, "V8__a.sql", 1),
    ]
    _, _, got = shown(spark, some, ["V1__a.sql", "V2__a.sql", "V3__a.sql", "V4__a.sql", "V8__a.sql", "R__v.sql", "R__w.sql"])
    assert got == {
        1: "Undone", 2: "Success", 3: "Out of Order", 4: "Success", 5: "Success", 6: "Success", 7: "Success", 8: "Success", 9: "Success", 10: "Outdated", 11: "Success",
        12: "Failed (Future)", 13: "Failed (Missing)", 14: "Future", 15: "Missing", 16: "Deleted", 17: "Baseline", 18: "Needs repair", 19: "Failed",
    }


def test_info_and_older_info(spark):
    """Applied, undone, applied, undone, applied: the older report calls each run before an undo undone, the newer none."""
    some = [(k, "1", "UNDO_SQL" if k % 2 == 0 else "SQL", True, "V1__a.sql", 1) for k in range(1, 6)]
    h, s, _ = shown(spark, some, ["V1__a.sql", "V2_0__b.sql", "U1__x.sql", "R__z.sql"])
    newer = {r.installed_rank: (r.state, r.undoable) for r in state.info(h, s).where("installed_rank IS NOT NULL").collect()}
    older = {r.installed_rank: r.state for r in state.info(h, s, need_undone=False).where("installed_rank IS NOT NULL").collect()}
    assert newer == {k: ("Success", True) for k in range(1, 6)}
    assert older == {1: "Undone", 2: "Success", 3: "Undone", 4: "Success", 5: "Success"}
    assert [(r.script, r.version, r.place) for r in state.info(h, s).where("place IS NOT NULL").orderBy("place").collect()] == [("V2_0__b.sql", "2.0", 1), ("R__z.sql", "", 2)]


def test_blocks_of_ranks(spark, monkeypatch):
    """Order questions give the same however small the blocks are that a history is dealt out in."""
    h = rows(spark, *[(k, f"{k * 7919 % 101}.{k % 3}", "SQL", True) for k in range(1, 200) if k % 7])
    want = [sorted(map(tuple, f(h).collect())) for f in (history.out_of_order_adjacent, history.out_of_order_scripts, history.out_of_order_global)]
    monkeypatch.setattr(history, "BLOCK", 4)
    assert [sorted(map(tuple, f(h).collect())) for f in (history.out_of_order_adjacent, history.out_of_order_scripts, history.out_of_order_global)] == want
    assert all(want)


def test_numbers_and_closure(spark):
    df = spark.createDataFrame([(k * 37 % 101, "x") for k in range(101)], "k long, t string")
    assert [(r.k, r.place) for r in tables.numbered(df, "k").orderBy("place").collect()] == [(k, k + 1) for k in range(101)]
    edges = [(f"n{k}", f"n{k + 1}") for k in range(20)] + [("n20", "n18"), ("n3", "n3")]
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    for _ in range(25):
        reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
    frame = spark.createDataFrame(edges, "src string, dst string")
    assert {tuple(r) for r in graph.closure(frame).collect()} == {(a, b) for a, bs in reach.items() for b in bs}
    assert {r.node for r in graph.in_cycles(frame).collect()} == {"n3", "n18", "n19", "n20"}


def test_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Session)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")], "src string, dst string")
    assert {r.node for r in graph.in_cycles(edges).collect()} == {"x", "y", "s"}
    assert {(r.node, r.depth) for r in graph.depths(edges).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    assert [r.node for r in graph.creation_order(edges).orderBy("place").collect()] == ["c", "b", "a"]


def test_scripts_and_history_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "V1__a.sql").write_bytes("é".encode())
    (tmp_path / "V2__b.sql").write_bytes("é".encode("latin-1"))
    (tmp_path / "V3__c.sql").write_bytes(b"\xff\xfe" + "é".encode("utf-16-le"))
    (tmp_path / "V4__d.sql").write_bytes("select 1".encode("utf-16-le"))
    (tmp_path / "deep" / "V5__e.sql").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "notes.txt").write_text("no")
    got = {r.name: r.content for r in tables.read_scripts(spark, {str(tmp_path): True, str(tmp_path / "deep"): False}, "*.sql").collect()}
    assert got == {"V1__a.sql": "é", "V2__b.sql": "é", "V3__c.sql": "é", "V4__d.sql": "select 1", "V5__e.sql": "x"}
    path = str(tmp_path / "history")
    raw = spark.createDataFrame([("1", "x.sql", "12", "T", "no"), ("2", "a.sql", None, "f", "7")], "Version string, SCRIPT string, checksum string, success string, execution_time string")
    rows = tables.coerced_history(raw)
    tables.append_history(rows, path)
    tables.append_history(rows, path)
    got = [(r.installed_rank, r.script, r.checksum, r.success, r.execution_time) for r in tables.read_history(spark, path).orderBy("installed_rank").collect()]
    assert got == [(1, "a.sql", None, False, 7), (2, "x.sql", 12, True, 0), (3, "a.sql", None, False, 7), (4, "x.sql", 12, True, 0)]


def test_streaming_agrees_with_batch(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 5).alias("migration_id"), (F.col("id") * 7 % 31).alias("execution_time"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = running_times(read_journal(spark, f"{tmp_path}/in", rows.schema))
    query = stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("running").collect()}
    want = rows.groupBy(F.window("ts", "1 hour").alias("w"), "migration_id").agg(F.count("*"), F.sum("execution_time"), F.max("execution_time"))
    assert got == {(r[0].start, *r[1:]) for r in want.collect()}


def test_reversed_statements_are_dealt_out(spark):
    """One small file is no single task; each statement is still there once, with its own reverse."""
    rows = spark.range(40).select(F.col("id").alias("stmt_id"), F.concat(F.lit("CREATE TABLE t"), F.col("id").cast("string"), F.lit(" (a INT)")).alias("sql_text")).coalesce(1)
    got = undo.reversed_statements(rows)
    assert {(r.stmt_id, r.undo_sql) for r in got.collect()} == {(k, f"DROP TABLE t{k}") for k in range(40)}
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    script = undo.reversed_script(rows.withColumn("script", F.col("stmt_id") % 3), ["script"])
    assert {(r.script, r.undo_order, r.undo_sql) for r in script.collect()} == {(k % 3, -k, f"DROP TABLE t{k}") for k in range(40)}


def test_frequent_names_and_many_runs_are_dealt_out(spark):
    """A name of all statements is shared out, and so are runs; results are those of the plain way."""
    texts = spark.range(300).select(F.col("id").alias("stmt_id"), F.lit("SELECT * FROM Tab1").alias("sql_text"))
    got = graph.mentions(texts, spark.createDataFrame([("TAB1",), ("tab1",), ("other",), (None,)], "name string"))
    assert sorted(tuple(r) for r in got.collect()) == [(k, "tab1") for k in range(300)]
    runs = spark.range(100).selectExpr("id % 50 AS migration_id", "'t' AS object_type", "concat('o', id % 4) AS object_name", "id AS execution_time").coalesce(1)
    assert {(r.migration_id, r.n, r.total, r.longest, r.objects) for r in journal.times_by_kind(runs).collect()} == {(k, 2, 2 * k + 50, k + 50, 2) for k in range(50)}


def test_line_differences_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, None, "x")], "script_id long, old string, new string")
        got = {tuple(r) for r in textdiff.counted_lines(rows, F.col("old"), F.col("new")).collect()}
        assert got == {(1, "equal", 1), (1, "removed", 1), (1, "added", 1), (2, "added", 1)} and int(spark.conf.get(key)) <= 512
    finally:
        spark.conf.set(key, before)
