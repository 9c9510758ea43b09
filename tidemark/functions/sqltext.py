"""What SQL text says: statement class, verb, target, events, and placeholders.

These are expressions over a text column, by patterns that Java and RE2 read alike.  They
look at heads and key words; nested or quoted trickery is beyond them, as said at each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMENTS = r"(?s)^(\s*(--[^\n]*(\n|$)|/\*.*?\*/))*\s*"
_NAME = r"([\[\"`]?[A-Za-z_][\w$]*[\]\"`]?(?:\.[\[\"`]?[A-Za-z_][\w$]*[\]\"`]?)*)"

# Words that begin a statement of each class.
_DDL = ("CREATE", "ALTER", "DROP", "TRUNCATE", "COMMENT", "GRANT", "REVOKE", "RENAME")
_DML = ("INSERT", "UPDATE", "DELETE", "MERGE", "UPSERT", r"EXEC\s", "EXECUTE ")
_QUERY = ("SELECT", "WITH", "SHOW", "DESC", "EXPLAIN")
_VERBS = ("CREATE", "ALTER", "DROP", "INSERT", "UPDATE", "DELETE", "COMMENT", "TRUNCATE", "GRANT", "REVOKE")


def without_comments(sql: Column) -> Column:
    """Without comments and white space before the first word."""
    return F.regexp_replace(F.regexp_replace(sql, "^﻿", ""), _COMMENTS, "")


def statement_class(sql: Column) -> Column:
    """DDL, DML, QUERY or UNKNOWN by the first letters (prefixes, not words)."""
    head = F.upper(without_comments(sql))
    out = F.lit("UNKNOWN")
    for kind, words in (("QUERY", _QUERY), ("DML", _DML), ("DDL", _DDL)):
        out = F.when(head.rlike("^(" + "|".join(words) + ")"), kind).otherwise(out)
    return out


def verb(sql: Column) -> Column:
    """One of ten verbs by prefix, comments not looked through."""
    head = F.upper(F.regexp_replace(sql, r"^\s+", ""))
    out = F.lit("UNKNOWN")
    for word in _VERBS:
        out = F.when(head.startswith(word), word).otherwise(out)
    return out


def is_executable(sql: Column) -> Column:
    """Not empty, not a batch end, not comments alone."""
    rest = F.regexp_replace(without_comments(sql), r"[\s;]+$", "")
    return (rest != "") & ~F.upper(rest).isin("GO", "/")


def batches(content: Column) -> Column:
    """Parts between lines that say GO, trimmed, without empty ones."""
    parts = F.transform(F.split(content, r"(?im)^[ \t]*GO[ \t]*(?:--[^\n]*)?$"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def simple_statements(content: Column) -> Column:
    """Parts between semicolons and GO lines, quotes not looked at."""
    parts = F.transform(F.split(F.regexp_replace(content, r"(?im)^[ \t]*GO[ \t]*(?:--[^\n]*)?$", ";"), ";"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def quoted_statements(content: Column) -> Column:
    """Statements of a script: semicolons in quotes or comments don't end one; comments are left out."""
    bare = F.regexp_replace(content, r"(?s)('(?:[^']|'')*'|\"[^\"]*\")|--[^\n]*|/\*.*?\*/", "$1")
    parts = F.regexp_extract_all(bare, F.lit(r"(?:[^;'\"]|'(?:[^']|'')*'|\"[^\"]*\")+;?"), F.lit(0))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.regexp_replace(x, r"[;\s]", "") != "")


def structural_problem(sql: Column) -> Column:
    """empty, parentheses, quotes, or null."""
    count = lambda c: F.length(sql) - F.length(F.replace(sql, F.lit(c), F.lit("")))
    return F.when(F.regexp_replace(sql, r"\s", "") == "", "empty").when(count("(") != count(")"), "parentheses").when(count("'") % 2 == 1, "quotes")


def returns_rows(sql: Column) -> Column:
    """Does the first word, after comments and opening parentheses, begin a query?"""
    head = F.upper(F.regexp_replace(without_comments(sql), r"^[(\s]+", ""))
    return head.rlike("^(SELECT|WITH|SHOW|VALUES|EXPLAIN|DESC)")


def substituted(content: Column, values: dict[str, str | Column]) -> Column:
    """``${name}`` and ``${name:default}`` replaced; names without value keep their default, or stay as they are."""
    out = content
    for name, value in values.items():
        quoted = F.regexp_replace(value if isinstance(value, Column) else F.lit(value), r"([\\$])", r"\\$1")
        out = F.regexp_replace(out, F.lit(rf"\$\{{{name}(:[^}}]*)?\}}"), quoted)
    return F.regexp_replace(out, r"\$\{\w+:([^}]*)\}", "$1")


def unquoted(name: Column) -> Column:
    return F.regexp_replace(name, r"[\[\]\"`]", "")


def _head(sql: Column) -> Column:
    return without_comments(sql)


def dml_target(sql: Column) -> Column:
    """Table that an INSERT, UPDATE, DELETE, MERGE or TRUNCATE changes, without quotes; null for others."""
    head = _head(sql)
    found = F.regexp_extract(head, r"(?i)^(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO|TRUNCATE(?:\s+TABLE)?)\s+" + _NAME, 1)
    return F.nullif(unquoted(found), F.lit(""))


def is_upsert(sql: Column) -> Column:
    return sql.rlike(r"(?is)ON\s+DUPLICATE\s+KEY\s+UPDATE|ON\s+CONFLICT.*DO\s+UPDATE")


def dml_events(sql: Column) -> Column:
    """Sorted events that fire: null where they can't be told (TRUNCATE) or the text is no DML."""
    head = F.upper(_head(sql))
    merged = F.array_sort(F.array_distinct(F.regexp_extract_all(head, F.lit(r"THEN\s+(INSERT|UPDATE|DELETE)"), F.lit(1))))
    return (
        F.when(head.rlike("^INSERT"), F.when(is_upsert(sql), F.array(F.lit("INSERT"), F.lit("UPDATE"))).otherwise(F.array(F.lit("INSERT"))))
        .when(head.rlike("^UPDATE"), F.array(F.lit("UPDATE")))
        .when(head.rlike("^DELETE"), F.array(F.lit("DELETE")))
        .when(head.rlike("^MERGE"), merged)
    )


def updated_columns(sql: Column) -> Column:
    """Columns of an UPDATE's SET list in lower case, without qualifiers and quotes; values with commas in parentheses are beyond it."""
    assigned = F.regexp_extract(_head(sql), r"(?is)^UPDATE\s+.*?\s+SET\s+(.*?)(?:\s+WHERE\s.*)?$", 1)
    names = F.transform(F.split(assigned, ","), lambda x: F.lower(F.regexp_extract(unquoted(x), r"(?:\w+\.)?(\w+)\s*=", 1)))
    return F.filter(names, lambda x: x != "")


def where_text(sql: Column) -> Column:
    return F.nullif(F.regexp_extract(_head(sql), r"(?is)^(?:UPDATE|DELETE)\s.*?\sWHERE\s+(.*)$", 1), F.lit(""))


def changes_all_rows(sql: Column) -> Column:
    """An UPDATE or DELETE without WHERE outside quotes, comments and parentheses."""
    head = F.upper(_head(sql))
    bare = F.regexp_replace(F.regexp_replace(head, r"(?s)'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " "), r"\([^()]*\)", " ")
    return head.rlike("^(UPDATE|DELETE)") & ~bare.rlike(r"\bWHERE\b")


def inserted_literals(sql: Column) -> Column:
    """Column and literal of the first row of a single-row INSERT, as ``column=literal`` texts."""
    columns = F.transform(F.split(F.regexp_extract(_head(sql), r"(?is)^INSERT\s+INTO\s+[^\s(]+\s*\(([^)]*)\)\s*VALUES", 1), ","), lambda x: F.trim(x))
    values = F.regexp_extract_all(F.regexp_extract(_head(sql), r"(?is)\bVALUES\s*\((.*?)\)(?:\s+ON\s.*|\s*)$", 1), F.lit(r"\s*('(?:[^']|'')*'|[^,']+)\s*(?:,|$)"), F.lit(1))
    pairs = F.transform(F.arrays_zip(columns.alias("c"), values.alias("v")), lambda z: F.concat(z["c"], F.lit("="), F.trim(z["v"])))
    return F.filter(pairs, lambda x: F.coalesce(x.rlike(r"^[^=]+=('.*'|-?[0-9.]+|(?i)NULL|TRUE|FALSE)$"), F.lit(False)))


def touches(sql: Column, keys: list[str]) -> Column:
    """Does an UPDATE change any of the keys, case aside?"""
    return F.arrays_overlap(updated_columns(sql), F.array(*[F.lit(k.lower()) for k in keys]))


def dml_analysis(sql: Column) -> Column:
    """(target, events, updated_columns) of a statement that changes rows; null for others. Columns are those of an UPDATE, else null."""
    target = dml_target(sql)
    columns = updated_columns(sql)
    return F.when(target.isNotNull(), F.struct(target.alias("target"), dml_events(sql).alias("events"), F.when(F.size(columns) > 0, columns).alias("updated_columns")))


def object_of(sql: Column) -> Column:
    """(object_type, schema_name, object_name) that a CREATE, ALTER or DROP is about; nulls for others."""
    pattern = r"(?i)^(?:CREATE|ALTER|DROP)\s+(?:OR\s+REPLACE\s+)?(?:UNIQUE\s+|TEMPORARY\s+|MATERIALIZED\s+)?(TABLE|VIEW|INDEX|SEQUENCE|TRIGGER|PROCEDURE|FUNCTION|SCHEMA|TYPE)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?" + _NAME
    kind = F.nullif(F.upper(F.regexp_extract(_head(sql), pattern, 1)), F.lit(""))
    name = unquoted(F.regexp_extract(_head(sql), pattern, 2))
    return F.struct(kind.alias("object_type"), F.nullif(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lit("")).alias("schema_name"), F.nullif(F.regexp_extract(name, r"([^.]*)$", 1), F.lit("")).alias("object_name"))
