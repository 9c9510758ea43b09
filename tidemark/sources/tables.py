"""Reading and writing histories, scripts and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("installed_rank", T.LongType()),
        T.StructField("version", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("script", T.StringType()),
        T.StructField("checksum", T.IntegerType()),
        T.StructField("installed_by", T.StringType()),
        T.StructField("installed_on", T.TimestampType()),
        T.StructField("execution_time", T.IntegerType()),
        T.StructField("success", T.BooleanType()),
    ]
)


#: What was written outside of any :func:`scratch`: application and path.
_written: list[tuple[str, str]] = []
_local: list[str] = []
#: What the innermost :func:`scratch` of this call has written.
_scope: ContextVar[list[tuple[str, str]] | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it a folder of this machine where there is no other one, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidemark-"))
    return "file://" + _local[0]


def new_path(spark: SparkSession, what: str = "step") -> str:
    """A path of its own in the shared folder; :func:`release`, or the end of the :func:`scratch` around, deletes it."""
    path = f"{shared_folder(spark)}/tidemark-{what}-{uuid.uuid4().hex}"
    scope = _scope.get()
    (_written if scope is None else scope).append((spark.sparkContext.applicationId, path))
    return path


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; this cuts its lineage.

    A lost executor costs at most the stage that was running.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete_all(spark: SparkSession, entries: list[tuple[str, str]]) -> None:
    app = spark.sparkContext.applicationId
    for entry in [e for e in entries if e[0] == app]:
        entries.remove(entry)
        _delete(spark, entry[1])


def release(spark: SparkSession) -> None:
    """Delete what was written for this application outside of any :func:`scratch`; frames over it can't be read any more."""
    _delete_all(spark, _written)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables that are written inside belong to this call and are deleted at its end.

    What is to stay goes through the function that it gives: it writes a frame outside.
    """
    outer, mine = _scope.get(), []
    token = _scope.set(mine)

    def keep(df: DataFrame, what: str = "step") -> DataFrame:
        inner = _scope.set(outer)
        try:
            return stored(df, what)
        finally:
            _scope.reset(inner)

    try:
        yield keep
    finally:
        _scope.reset(token)
        _delete_all(spark, mine)


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` with numbers from 1 on in the order of some columns: sorted by ranges, a range's numbers follow those before it.

    No more than a row for each range goes through one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_range": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n") + 1).alias("_start"))
    return rows.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_nth")).drop("_id", "_range", "_nth", "_start")


def numbered_within(df: DataFrame, by: Sequence[str], *order: Column | str, name: str = "place") -> DataFrame:
    """``df`` with numbers from 1 on in each group, in some order: one sort by group and order, dealt out by ranges.

    A group may span many ranges: its number in a range follows those of the ranges before,
    of which there is one row for each range and group, so the largest group is no single task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c) for c in by], *[F.col(c) if isinstance(c, str) else c for c in order]]
    rows = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_id", 33))
    parts = rows.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    starts = parts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return rows.join(starts, same).withColumn(name, F.col("_id") + F.col("_shift")).select(*df.columns, name)


#: Rows of text in one Arrow batch.  Texts differ in length by five orders of
#: magnitude, so the default of 10,000 rows could put gigabytes in one batch.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in this session, unless ``tidemark.batchRows`` or the session sets another bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get("tidemark.batchRows", None)
    if own or spark.conf.get(key) == "10000":
        spark.conf.set(key, own or str(BATCH_ROWS))


#: Rows that one task takes where work or memory grows with its rows.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, *by: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt out (by some columns, else evenly), so that no task gets many more than ``rows`` rows, however few files there are."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(n, *by)


def read_scripts(spark: SparkSession, roots: dict[str, bool], pattern: str = "*") -> DataFrame:
    """Whole script files below several folders: ``path, name, content, size``.

    ``roots`` says for each folder whether to look into those below it.  A file that several
    roots reach is read once: paths are compared, contents aren't shuffled for it.
    """
    files = [spark.read.option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", pattern).format("binaryFile").load(root) for root, deep in roots.items()]
    first = reduce(DataFrame.unionByName, [f.select("path", F.lit(k).alias("_root")) for k, f in enumerate(files)]).groupBy("path").agg(F.min("_root").alias("_root"))
    parts = [f.join(first.where(F.col("_root") == k), "path", "left_semi") for k, f in enumerate(files)]
    out = reduce(DataFrame.unionByName, [f.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", F.col("length").alias("size")) for f in parts])
    return out.withColumn("encoding", encoding(F.col("content"))).withColumn("content", decoded(F.col("content")))


def encoding(content):
    """Encoding of a file's bytes: by its byte order mark, by zero bytes at odd places, else UTF-8 if it reads as such, else Latin-1."""
    start = F.hex(F.substring(content, 1, 3))
    zero_at_odd = F.hex(F.substring(content, 1, 64)).rlike("^(?:[0-9A-F]{2}00){2,}$")
    return F.when(start == "EFBBBF", "utf-8-sig").when(start.startswith("FFFE"), "utf-16-le").when(start.startswith("FEFF"), "utf-16-be").when(zero_at_odd, "utf-16-le").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("iso-8859-1")


def decoded(content):
    """Text of a file's bytes by :func:`encoding`, without a byte order mark."""
    name = encoding(content)
    text = F.when(name == "utf-16-le", F.decode(content, "UTF-16LE")).when(name == "utf-16-be", F.decode(content, "UTF-16BE")).when(name == "iso-8859-1", F.decode(content, "ISO-8859-1")).otherwise(F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "^﻿", "")


def coerced_history(raw: DataFrame) -> DataFrame:
    """Rows of another tool or engine as a history: names in any case, numbers or 0, unknown truth is false."""
    names = {c.lower(): c for c in raw.columns}
    columns = []
    for field in HISTORY_SCHEMA:
        c = F.col(f"`{names[field.name]}`") if field.name in names else F.lit(None)
        kind = field.dataType.simpleString()
        if kind in ("bigint", "int") and field.name != "checksum":
            c = F.coalesce(c.cast("string").try_cast(kind), F.lit(0).cast(kind))
        elif kind == "boolean":
            c = F.coalesce(F.lower(c.cast("string")).isin("true", "1", "t", "yes"), F.lit(False))
        else:
            c = c.cast("string").try_cast(kind)
        columns.append(c.alias(field.name))
    return raw.select(*columns)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def append_history(new: DataFrame, path: str) -> None:
    """Append rows to the history at ``path``, ranked behind what is there in the order of their scripts.

    One writer at a time: two that append at once would give the same ranks (``duplicate_ranks`` finds
    them, ``reranked`` mends them).
    """
    spark = new.sparkSession
    top = spark.read.schema(HISTORY_SCHEMA).parquet(path).agg(F.coalesce(F.max("installed_rank"), F.lit(0))).first()[0] if _exists(spark, path) else 0
    ranked = numbered(new.drop("installed_rank"), "script", name="_place").withColumn("installed_rank", F.col("_place") + F.lit(top))
    ranked.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY_SCHEMA]).write.mode("append").parquet(path)


def write_history(history: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write the histories of many databases, a folder for each."""
    history.repartition(*by).write.mode("error").partitionBy(*by).parquet(path)


def overwrite_touched(new: DataFrame, touched: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the folders of ``touched (by)`` at ``path`` with the rows of ``new``; others keep their files.

    ``new`` may come from ``path`` itself: it is written aside in full before anything there changes.  A
    touched folder without new rows is removed.
    """
    spark = new.sparkSession
    staged, touched = stored(new), stored(touched.select(*by).distinct())
    gone = touched.join(staged.select(*by).distinct(), list(by), "left_anti")
    folders = [r["folder"] for r in spark.read.parquet(path).select(*by, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).join(gone, list(by), "left_semi").select("folder").distinct().toLocalIterator()]
    staged.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for folder in folders:
        _delete(spark, folder)


#: Rows of one script file.
ROWS_A_FILE = 256


def written_scripts(scripts: DataFrame, path: str, charset: str) -> None:
    """Write ``scripts (content)`` as text files in a character set, a line for each row; a row holds no line end and no zero byte.

    A file has at most ``ROWS_A_FILE`` rows, as files are read back whole.
    """
    plain = {"quote": "\0", "escape": "\0", "sep": "\1", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    scripts.select("content").write.options(encoding=charset, maxRecordsPerFile=ROWS_A_FILE, **plain).csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def queried(text: str, **relations: DataFrame) -> DataFrame:
    """Rows of a query in SQL over DataFrames, named in braces: ``SELECT * FROM {history}``."""
    return next(iter(relations.values())).sparkSession.sql(text, **relations)
