"""What a script's file name says: kind, version, description, tags and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of callback scripts, and formats by extension.
CALLBACKS = (
    "beforeMigrate", "afterMigrate", "afterMigrateError", "beforeEach", "afterEach", "beforeValidate", "afterValidate", "beforeClean", "afterClean", "afterCleanError",
    "beforeUndo", "afterUndo", "afterUndoError", "beforeEachMigrate", "afterEachMigrate", "beforeVersioned", "afterVersioned", "beforeRepeatable", "afterRepeatable",
)
FORMATS = {"sql": "SQL", "py": "PYTHON", "js": "JAVASCRIPT", "cypher": "CYPHER", "cql": "CQL", "gremlin": "GREMLIN", "json": "JSON", "yaml": "YAML", "yml": "YAML"}
SUPPORTED = ("SQL", "PYTHON")

_TAGS = r"\[([^\]]*)\]"
_ENDING = r"(?i)\.(" + "|".join(FORMATS) + ")$"
# Fixed value: what comes between a V or U and the description.
_NAMED = r"^{}([A-Za-z0-9]+(?:[._][A-Za-z0-9]+)*)__(.+)$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def tags(name: Column) -> Column:
    """Tags of the first bracket group: parted by commas, trimmed, without empty ones."""
    found = F.transform(F.split(F.regexp_extract(name, _TAGS, 1), ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.filter(found, lambda t: t != "")


def script_format(name: Column) -> Column:
    """Format by extension, UNKNOWN for others."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    out = F.lit("UNKNOWN")
    for key, value in FORMATS.items():
        out = F.when(extension == key, value).otherwise(out)
    return out


# What tells a format by content, the first that holds; (prefixes, words near the start, how near).
_CYPHER, _SQL_STARTS = r"CREATE \(|MATCH \(|MERGE \(|RETURN", "^(?:CREATE|ALTER|DROP|INSERT|UPDATE|DELETE|SELECT)"
_PAIR_OF_YAML = r"(?m)^\s*\w[\w-]*:\s+\S"


def content_format(content: Column) -> Column:
    """Format by content, for scripts whose extension says nothing; null and empty contents are UNKNOWN.

    Cypher comes before SQL, as both create; then SQL, Python and JavaScript by words at or near the
    start, JSON by a brace and a quote, and YAML by a key with a value.
    """
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    upper, lower = F.upper(text), F.lower(text)
    near = lambda c, n: F.substring(c, 1, n)
    return (
        F.when(F.coalesce(content, F.lit("")) == "", "UNKNOWN")
        .when(near(upper, 200).rlike(_CYPHER), "CYPHER")
        .when(upper.rlike(_SQL_STARTS), "SQL")
        .when(lower.startswith("def ") | F.contains(near(lower, 100), F.lit("import ")), "PYTHON")
        .when(lower.startswith("function ") | F.contains(near(lower, 100), F.lit("var ")), "JAVASCRIPT")
        .when(text.startswith("{") & F.contains(near(content, 50), F.lit('"')), "JSON")
        .when(near(content, 300).rlike(_PAIR_OF_YAML) & ~text.startswith("{"), "YAML")
        .otherwise("UNKNOWN")
    )


def format_of(name: Column, content: Column) -> Column:
    """Format by extension; by content where that is unknown."""
    by_name = script_format(name)
    return F.when(by_name != "UNKNOWN", by_name).otherwise(content_format(content))


def _bare(name: Column) -> Column:
    group = F.regexp_extract(name, _TAGS, 0)
    return F.when(group == "", name).otherwise(F.replace(name, group, F.lit("")))


def _kind(bare: Column, stem: Column) -> Column:
    return (
        F.when(~bare.rlike(_ENDING), "UNKNOWN")
        .when(F.lower(stem).rlike("^(" + "|".join(c.lower() for c in CALLBACKS) + ")"), "CALLBACK")
        .when(stem.rlike(_NAMED.format("V")) | (stem == "V__"), "SQL")
        .when(stem.rlike(_NAMED.format("U")), "UNDO_SQL")
        .when(stem.rlike("^R__."), "REPEATABLE")
        .otherwise("UNKNOWN")
    )


def _version(kind: Column, stem: Column) -> Column:
    raw = F.nullif(F.regexp_extract(stem, _NAMED.format("[VU]"), 1), F.lit(""))
    return F.when(kind.isin("SQL", "UNDO_SQL"), F.when(raw.rlike("^[0-9_.]+$"), F.replace(raw, F.lit("_"), F.lit("."))).otherwise(raw))


def _description(kind: Column, stem: Column) -> Column:
    return F.when(kind.isin("SQL", "UNDO_SQL"), F.regexp_extract(stem, _NAMED.format("[VU]"), 2)).when(kind == "REPEATABLE", F.regexp_extract(stem, "^R__(.*)$", 1)).otherwise(stem)


def parsed_name(name: Column) -> Column:
    """(kind, version, description) of a script name, the first bracket group (its tags) left out.

    In this order: another extension than those of scripts is UNKNOWN; then callbacks, V and U
    with a version, R, a V with nothing at all, and UNKNOWN.  In versions of digits alone an
    underscore is a dot.
    """
    bare = _bare(name)
    stem = F.regexp_replace(bare, _ENDING, "")
    kind = _kind(bare, stem)
    return F.struct(kind.alias("kind"), _version(kind, stem).alias("version"), _description(kind, stem).alias("description"))


def with_parsed_names(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``named_kind, version, description`` as :func:`parsed_name` has them, each part computed once."""
    rows = rows.withColumn("_bare", _bare(F.col(name))).withColumn("_stem", F.regexp_replace("_bare", _ENDING, ""))
    rows = rows.withColumn("named_kind", _kind(F.col("_bare"), F.col("_stem")))
    return rows.withColumns({"version": _version(F.col("named_kind"), F.col("_stem")), "description": _description(F.col("named_kind"), F.col("_stem"))}).drop("_bare", "_stem")


def quick_kind(name: Column) -> Column:
    """A guess by the first characters, case aside; knows baselines, and takes only digits after V, U and B."""
    low = F.lower(name)
    return (
        F.when(low.rlike("^(" + "|".join(c.lower() for c in CALLBACKS) + ")"), "CALLBACK")
        .when(low.rlike("^v[0-9]"), "SQL")
        .when(low.rlike("^r__"), "REPEATABLE")
        .when(low.rlike("^b[0-9]"), "BASELINE")
        .when(low.rlike("^u[0-9]"), "UNDO_SQL")
        .otherwise("UNKNOWN")
    )


def is_callback_for(name: Column, event: str) -> Column:
    """Scripts whose name starts with an event; ``beforeEach`` takes in ``beforeEachMigrate``."""
    return F.lower(base_name(name)).startswith(event.lower())


def filter_list(text: Column) -> Column:
    """Items of a list given as text: parted by commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")


def filter_items(items: Column, trimmed: bool) -> Column:
    """Items of a list given as such: as they are, or trimmed and without empty ones."""
    return F.filter(F.transform(items, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "") if trimmed else items
