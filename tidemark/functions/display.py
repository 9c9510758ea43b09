"""How values are shown: durations, descriptions, addresses with secrets masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(ms: Column) -> Column:
    """Milliseconds as ``12ms``, ``3.40s`` (half hundredths go up) or ``2m 5s``."""
    hundredths = F.floor((ms + 5) / 10)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), F.floor(ms % 60_000 / 1000).cast("string"), F.lit("s")))
    )


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut ones ending in three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def masked(url: Column) -> Column:
    """A database address with its password replaced."""
    inside = F.regexp_replace(url, r"^([A-Za-z][\w+.:-]*://[^:/@]*):[^@/]*@", "$1:***@")
    return F.regexp_replace(inside, r"(?i)\b(password|pwd|token|secret)=[^&;]*", "$1=***")


def reversed_comment(sql: Column) -> Column:
    """``COMMENT ON ... IS 'text'`` as the statement that takes it back; null for others."""
    return F.when(sql.rlike(r"(?i)^\s*COMMENT\s+ON\s"), F.regexp_replace(sql, r"(?is)\s+IS\s+('(?:[^']|'')*'|NULL)\s*;?\s*$", " IS NULL"))
