"""Checksums of scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a line.
LINE_ENDS = "[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def signed(unsigned: Column) -> Column:
    """A 32-bit value as a signed integer."""
    return F.when(unsigned >= 2147483648, unsigned - 4294967296).otherwise(unsigned).cast("int")


def script_checksum(content: Column) -> Column:
    """Signed CRC-32 of a script's lines without their ends, so line endings don't matter."""
    return signed(F.crc32(F.encode(F.regexp_replace(content, LINE_ENDS, ""), "UTF-8")))


def stored_checksum(raw: Column) -> Column:
    """A stored checksum as a signed 32-bit integer: whole and decimal numbers, signed or not; null if it is none."""
    number = F.coalesce(raw.try_cast("bigint"), F.floor(F.abs(raw.try_cast("double"))).cast("bigint") * F.signum(raw.try_cast("double")).cast("bigint"))
    return signed(number.bitwiseAND(F.lit(4294967295)))
