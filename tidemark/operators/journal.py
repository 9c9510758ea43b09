"""Execution journals: statement times for each run and kind of object, and errors by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import spread

# Patterns of error messages, the first that matches counts.
ERRORS = (
    (r"(?i)connection\s+(reset|refused|closed|lost|timed\s*out)", "NETWORK"),
    (r"(?i)broken\s+pipe", "NETWORK"),
    (r"(?i)socket\s+(error|closed|timeout|exception)", "NETWORK"),
    (r"(?i)network\s+(error|unreachable)", "NETWORK"),
    (r"(?i)insufficient\s+data", "NETWORK"),
    (r"(?i)timeout|timed\s*out", "TIMEOUT"),
    (r"(?i)deadlock", "LOCKING"),
    (r"(?i)authentication\s+fail", "AUTHENTICATION"),
    (r"(?i)permission\s+denied", "AUTHORIZATION"),
)
# The same for messages of a dialect.
DIALECT_ERRORS = {
    "postgresql": (
        (r"(?i)SQLSTATE\s*08\w{3}", "NETWORK"), (r"(?i)SQLSTATE\s*57P01", "NETWORK"), (r"(?i)SQLSTATE\s*40\w{3}", "LOCKING"), (r"(?i)SQLSTATE\s*23\w{3}", "CONSTRAINT"), (r"(?i)SQLSTATE\s*42\w{3}", "SQL_SYNTAX"),
        (r"(?i)SQLSTATE\s*28\w{3}", "AUTHENTICATION"), (r"(?i)SQLSTATE\s*3D\w{3}", "SCHEMA"), (r"(?i)SQLSTATE\s*3F\w{3}", "SCHEMA"), (r"(?i)SQLSTATE\s*53\w{3}", "RESOURCE"), (r"(?i)SQLSTATE\s*57\w{3}", "INTERNAL"),
    ),
    "mysql": (
        (r"(?i)\b2003\b.*Can't connect", "NETWORK"), (r"(?i)\b2013\b.*Lost connection", "NETWORK"), (r"(?i)\b2006\b.*server has gone away", "NETWORK"), (r"(?i)\b2002\b.*Can't connect", "NETWORK"),
        (r"(?i)\b1205\b.*Lock wait timeout", "LOCKING"), (r"(?i)\b1213\b.*Deadlock", "LOCKING"), (r"(?i)\b1045\b.*Access denied", "AUTHENTICATION"), (r"(?i)\b1146\b.*doesn't exist", "SCHEMA"),
        (r"(?i)\b1054\b.*Unknown column", "SCHEMA"), (r"(?i)\b1062\b.*Duplicate entry", "CONSTRAINT"), (r"(?i)\b1452\b.*foreign key constraint", "CONSTRAINT"), (r"(?i)\b1064\b.*syntax", "SQL_SYNTAX"),
    ),
    "oracle": (
        (r"(?i)ORA-17800", "NETWORK"), (r"(?i)ORA-17002", "NETWORK"), (r"(?i)ORA-12541", "NETWORK"), (r"(?i)ORA-12514", "NETWORK"), (r"(?i)ORA-12170", "TIMEOUT"), (r"(?i)ORA-12571", "NETWORK"),
        (r"(?i)ORA-03113", "NETWORK"), (r"(?i)ORA-03114", "NETWORK"), (r"(?i)ORA-00060", "LOCKING"), (r"(?i)ORA-00054", "LOCKING"), (r"(?i)ORA-01017", "AUTHENTICATION"), (r"(?i)ORA-01031", "AUTHORIZATION"),
        (r"(?i)ORA-01045", "AUTHENTICATION"), (r"(?i)ORA-00942", "SCHEMA"), (r"(?i)ORA-00904", "SCHEMA"), (r"(?i)ORA-00001", "CONSTRAINT"), (r"(?i)ORA-02291", "CONSTRAINT"), (r"(?i)ORA-02292", "CONSTRAINT"),
        (r"(?i)ORA-00900", "SQL_SYNTAX"), (r"(?i)ORA-00933", "SQL_SYNTAX"), (r"(?i)ORA-04031", "RESOURCE"), (r"(?i)ORA-01653", "RESOURCE"),
    ),
    "db2": (
        (r"(?i)errorcode=-4499", "NETWORK"), (r"(?i)sqlstate=08\w{3}", "NETWORK"), (r"(?i)disconnectnontransientconnectionexception", "NETWORK"), (r"(?i)disconnectexception", "NETWORK"), (r"(?i)communication\s+error", "NETWORK"),
        (r"(?i)sql0911n", "LOCKING"), (r"(?i)sqlstate=40001", "LOCKING"), (r"(?i)sqlstate=28000", "AUTHENTICATION"), (r"(?i)sqlstate=42\w{3}", "SQL_SYNTAX"), (r"(?i)sqlstate=23\w{3}", "CONSTRAINT"), (r"(?i)sqlstate=57\w{3}", "RESOURCE"),
    ),
}
RETRYABLE = ("NETWORK", "TIMEOUT", "LOCKING")


def statement_times(journal: DataFrame) -> DataFrame:
    """Statements of each run: count, times, and the slowest (of equal ones the first, none if all took no time)."""
    t = F.col("execution_time")
    return journal.groupBy("migration_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(t), F.lit(0)).alias("total"),
        F.round(F.coalesce(F.avg(t), F.lit(0.0)), 6).alias("mean"),
        F.coalesce(F.max(t), F.lit(0)).alias("longest"),
        F.coalesce(F.min(t), F.lit(0)).alias("shortest"),
        F.max_by(F.when(t > 0, F.col("statement_index")), F.when(t > 0, F.struct(t, -F.col("statement_index")))).alias("slowest_index"),
    )


def times_by_kind(journal: DataFrame) -> DataFrame:
    """Times and distinct objects of each run and kind of object.

    Runs are dealt out first, as nearly every row is a group of its own with its object: a task's groups are as many as its rows.
    """
    t = F.col("execution_time")
    dealt = spread(journal.select("migration_id", "object_type", "object_name", "execution_time"), "migration_id")
    return dealt.groupBy("migration_id", "object_type").agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("total"), F.max(t).alias("longest"), F.count_distinct("object_name").alias("objects"), F.round(F.avg(t), 6).alias("mean"))


def changes_with_times(changes: DataFrame, completions: DataFrame) -> DataFrame:
    """Object changes with the time of the statement that made them (its first completion)."""
    first = completions.groupBy("migration_id", "statement_index").agg(F.min_by("execution_time", F.struct("execution_time", "statement")).alias("execution_time"))
    return changes.select("migration_id", "statement_index", "object_type", "object_name").join(first, ["migration_id", "statement_index"])


def outcome_counts(journal: DataFrame) -> DataFrame:
    return journal.groupBy("success").agg(F.count(F.lit(1)).alias("n"))


def error_category(message: Column, dialect: str | None = None, exception: Column | None = None) -> Column:
    """Category of the first pattern that fits a message, or the name of its exception; those of the dialect come first."""
    text = message if exception is None else F.concat(message, F.lit(" "), F.coalesce(exception, F.lit("")))
    out = F.lit("UNKNOWN")
    for pattern, category in reversed((*DIALECT_ERRORS.get(dialect or "", ()), *ERRORS)):
        out = F.when(text.rlike(pattern), category).otherwise(out)
    return out


def retryable(category: Column, tries: Column, most: int = 3) -> Column:
    return category.isin(*RETRYABLE) & (tries < most)
