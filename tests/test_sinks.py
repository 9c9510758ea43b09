"""Sinks over files: repair of touched databases only, appended histories, and what release deletes."""

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.sources import tables
from tidemark.sources.tables import read_scripts, written_scripts


def local(path):
    return Path(path.removeprefix("file://").removeprefix("file:"))


def files(path):
    return {str(f.relative_to(local(path))): f.stat().st_mtime_ns for f in sorted(local(path).rglob("*.parquet"))}


SCHEMA = "db long, installed_rank long, version string, description string, type string, script string, checksum int, installed_by string, execution_time int, success boolean"


def history(spark):
    rows = [
        (1, 1, "1", "one", "SQL", "V1__a.sql", 5, "u", 1, True),
        (1, 2, "2", "two", "SQL", "V2__gone.sql", 5, "u", 1, True),
        (1, 3, "3", "three", "SQL", "V3__bad.sql", 5, "u", 1, False),
        (2, 1, "1", "one", "SQL", "V1__a.sql", None, "u", 1, True),
        (3, 1, "1", "bad", "SQL", "V1__a.sql", 5, "u", 1, False),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def scripts(spark):
    return spark.createDataFrame([(db, 10 + db, "V1__a.sql", "select 1") for db in (1, 2, 3)], "db long, script_id long, name string, content string")


def test_repair_in_place(spark):
    path = tables.new_path(spark, "test")
    tables.write_history(history(spark), path, ["db"])
    before = files(path)
    state.apply_repair(path, scripts(spark))
    after = files(path)
    same = lambda db: {k: v for k, v in before.items() if k.startswith(f"db={db}")} == {k: v for k, v in after.items() if k.startswith(f"db={db}")}
    assert same(2) and not same(1)  # nothing to mend in 2: its files stay
    assert not any(k.startswith("db=3") for k in after)  # only failed rows: nothing is left
    new = state.resolved_scripts(scripts(spark)).first()["file_checksum"]
    got = {tuple(r) for r in spark.read.parquet(path).select("db", "installed_rank", "version", "type", "description", "script", "checksum", "success").collect()}
    assert got == {(1, 1, "1", "SQL", "one", "V1__a.sql", new, True), (1, 2, "2", "SQL", "two", "V2__gone.sql", 5, True), (1, 4, "2", "DELETE", "[DELETE:SQL] two", "V2__gone.sql", None, True), (2, 1, "1", "SQL", "one", "V1__a.sql", None, True)}
    state.apply_repair(path, scripts(spark))  # a second time changes nothing
    assert files(path) == after


def test_release(spark):
    kept = tables.stored(spark.range(3))
    path = local(tables._written[-1][1])
    tables._written.append(("another application", "file:///nowhere"))
    assert path.exists() and kept.count() == 3
    tables.release(spark)
    assert not path.exists() and tables._written == [("another application", "file:///nowhere")]
    tables._written.clear()


def test_scratch(spark):
    tables.release(spark)
    with tables.scratch(spark) as keep:
        step = tables.stored(spark.range(5))
        with tables.scratch(spark) as keep_step:
            inner = keep_step(tables.stored(step.where("id > 1")), "inner")
        inner_path = local(tables._scope.get()[-1][1])
        assert inner.count() == 3 and inner_path.exists()
        kept = keep(inner, "kept")
    assert kept.count() == 3 and not inner_path.exists() and len(tables._written) == 1
    tables.release(spark)
    assert not tables._written


def test_undo_files_by_prefix(spark):
    versions = spark.createDataFrame([(1, "1"), (1, "10"), (1, "2"), (2, "1")], "db long, version string")
    names = spark.createDataFrame([(1, "x/U10__a.sql"), (1, "U3.sql"), (2, "U1__b.py"), (2, "V1__b.sql")], "db long, name string")
    assert {tuple(r) for r in state.with_undo_file(versions, names).collect()} == {(1, "1"), (1, "10")}


def test_script_files_are_bounded(spark, tmp_path):
    """Many scripts make many files; a file that two roots reach is read once, and no content is shuffled to find that out."""
    rows = spark.range(1000).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("content")).coalesce(1)
    written_scripts(rows, f"{tmp_path}/a/b", "UTF-8")
    files = read_scripts(spark, {f"{tmp_path}/a": True, f"{tmp_path}/a/b": False}, "*.csv")
    got = files.select(F.explode(F.split("content", "\n")).alias("l")).where("l <> ''").collect()
    assert sorted(r.l for r in got) == sorted(f"line {k}" for k in range(1000)) and files.count() == 4
