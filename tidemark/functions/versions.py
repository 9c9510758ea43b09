"""Version algebra: versions as comparable keys.

A version is split at dots and underscores.  A part of digits and optional letters compares
by number and then by lower-case letters; any other part comes after all of those.  Missing
parts count as zero, so 1 equals 1.0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(38,0)"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def version_key(version: Column) -> Column:
    """Array of (kind, number, text) parts without trailing zero parts; null for a null version."""

    def part(x: Column) -> Column:
        numbered = x.rlike("^[0-9]+[A-Za-z]*$")
        return F.struct(
            F.when((x == "") | numbered, 0).otherwise(1).alias("k"),
            F.when(numbered, F.regexp_extract(x, "^([0-9]+)", 1)).otherwise("0").cast(NUMBER).alias("n"),
            F.when(numbered, F.lower(F.regexp_extract(x, "^[0-9]+([A-Za-z]*)$", 1))).otherwise(F.lower(x)).alias("t"),
        )

    parts = F.transform(F.split(stripped(version), "[._]"), part)
    filled = F.transform(F.reverse(parts), lambda e: ~((e["k"] == 0) & (e["n"] == 0) & (e["t"] == "")))
    return F.slice(parts, 1, F.size(parts) - F.coalesce(F.nullif(F.array_position(filled, True), F.lit(0)), F.size(parts) + 1).cast("int") + 1)


def version_order(version: Column) -> Column:
    """A text that sorts as :func:`version_key` does: one comparison of bytes in place of nested arrays.

    Each part is its kind, the number of its digits, the digits and the letters, and ends with
    a zero byte.  Null for a null version.
    """

    def part(x: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(x, "^([0-9]+)[A-Za-z]*$", 1), "^0+", "")
        numbered = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits, F.lower(F.regexp_extract(x, "^[0-9]+([A-Za-z]*)$", 1)))
        return F.concat(F.when((x == "") | x.rlike("^[0-9]+[A-Za-z]*$"), numbered).otherwise(F.concat(F.lit("10000"), F.lower(x))), F.lit("\0"))

    joined = F.array_join(F.transform(F.split(stripped(version), "[._]"), part), "")
    return F.regexp_replace(joined, r"(?<=^|\x00)(?:00000\x00)+$", "")


# Fixed value: the grammar of PEP 440 versions, and its spellings of pre-releases.
_PEP440 = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?([0-9]+)?)?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?(?:[-_.]?(dev)[-_.]?([0-9]+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
_PRE = {"a": "a", "alpha": "a", "b": "b", "beta": "b", "c": "c", "rc": "c", "pre": "c", "preview": "c"}


def pep440_order(version: Column) -> Column:
    """A text that sorts as PEP 440 orders versions; null for a null version and for one that isn't of its grammar.

    In this order: epoch, release without zeros at its end, pre-release (a development release
    of none comes before all of them, a final one after), post-release, development
    release (none comes last), local part (numbers after words).
    """
    text = F.lower(stripped(version))
    group = lambda k: F.regexp_extract(text, _PEP440, k)

    def number(digits: Column) -> Column:
        bare = F.regexp_replace(digits, "^0+", "")
        return F.concat(F.lpad(F.length(bare).cast("string"), 4, "0"), bare)

    parts = F.transform(F.split(group(2), r"\."), lambda x: F.concat(F.lit("\x02"), number(x)))
    release = F.concat(F.regexp_replace(F.array_join(parts, ""), "(?:\x020000)+$", ""), F.lit("\x01"))
    letter = F.coalesce(*[F.when(group(3) == k, v) for k, v in _PRE.items()])
    has_post, has_dev = (group(5) != "") | (group(6) != ""), group(8) != ""
    pre = F.when(group(3) != "", F.concat(F.lit("1"), letter, number(group(4)))).when(~has_post & has_dev, "0").otherwise("2")
    post = F.when(has_post, F.concat(F.lit("1"), number(F.concat(group(5), group(7))))).otherwise("0")
    dev = F.when(has_dev, F.concat(F.lit("0"), number(group(9)))).otherwise("1")
    local = F.transform(F.split(group(10), "[-_.]"), lambda x: F.when(x == "", "").when(x.rlike("^[0-9]+$"), F.concat(F.lit("\x03"), number(x), F.lit("\x01"))).otherwise(F.concat(F.lit("\x02"), x, F.lit("\x01"))))
    return F.when(text.rlike(_PEP440), F.concat(number(group(1)), F.lit("\x01"), release, pre, post, dev, F.array_join(local, "")))


def or_empty(version: Column) -> Column:
    """A null version counts as empty when it is compared."""
    return F.coalesce(version, F.lit(""))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null counts as the empty version."""
    x, y = version_order(or_empty(a)), version_order(or_empty(b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def numeric_parts(version: Column) -> Column:
    """The parts as integers, without zeros at the end; whatever isn't a number counts as 0."""
    parts = F.transform(F.split(version, "[._]"), lambda x: F.when(x.rlike("^[0-9]+$"), x).otherwise("0").cast(NUMBER))
    filled = F.transform(F.reverse(parts), lambda x: x != 0)
    return F.slice(parts, 1, F.size(parts) - F.coalesce(F.nullif(F.array_position(filled, True), F.lit(0)), F.size(parts) + 1).cast("int") + 1)


def product_at_least(version: Column, least: Column) -> Column:
    """Is a product version at least major.minor.patch of a pattern such as ``9.4+``? Missing numbers are 0."""

    def numbers(c: Column) -> Column:
        part = lambda k: F.coalesce(F.regexp_extract(c, rf"^\D*(\d+)(?:\.(\d+))?(?:\.(\d+))?", k).try_cast("int"), F.lit(0))
        return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))

    return numbers(version) >= numbers(least)
