"""Type names across dialects, and identifiers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import product_at_least

# Aliases of each dialect, families of canonical types, preferred names, quoting and case.
_MYSQL = {"INT": "INTEGER", "BOOL": "BOOLEAN", "BOOLEAN": "TINYINT", "BIT": "BOOLEAN", "CHARACTER VARYING": "VARCHAR", "CHARACTER": "CHAR", "LONG": "MEDIUMTEXT", "LONG VARCHAR": "MEDIUMTEXT", "DOUBLE PRECISION": "DOUBLE"}
ALIASES = {
    "postgresql": {"INT": "INTEGER", "INT2": "SMALLINT", "INT4": "INTEGER", "INT8": "BIGINT", "SERIAL": "INTEGER", "SERIAL2": "SMALLINT", "SERIAL4": "INTEGER", "SERIAL8": "BIGINT", "BIGSERIAL": "BIGINT", "SMALLSERIAL": "SMALLINT", "CHARACTER VARYING": "VARCHAR", "CHARACTER": "CHAR", "DECIMAL": "NUMERIC", "FLOAT4": "REAL", "FLOAT8": "DOUBLE PRECISION", "DOUBLE": "DOUBLE PRECISION", "BOOL": "BOOLEAN", "TIMESTAMPTZ": "TIMESTAMP WITH TIME ZONE", "TIMETZ": "TIME WITH TIME ZONE"},
    "oracle": {"VARCHAR2": "VARCHAR", "NVARCHAR2": "NVARCHAR", "INTEGER": "NUMBER", "INT": "NUMBER", "SMALLINT": "NUMBER", "BIGINT": "NUMBER", "FLOAT": "NUMBER", "DOUBLE PRECISION": "NUMBER", "REAL": "NUMBER", "LONG": "CLOB", "LONG RAW": "BLOB"},
    "mysql": _MYSQL,
    "mariadb": _MYSQL,
    "sqlserver": {"INT": "INTEGER", "CHARACTER VARYING": "VARCHAR", "CHARACTER": "CHAR", "NATIONAL CHARACTER VARYING": "NVARCHAR", "NATIONAL CHARACTER": "NCHAR", "NATIONAL CHAR VARYING": "NVARCHAR", "SMALLDATETIME": "DATETIME", "TEXT": "VARCHAR", "NTEXT": "NVARCHAR", "IMAGE": "VARBINARY"},
    "db2": {"INT": "INTEGER", "CHARACTER VARYING": "VARCHAR", "CHARACTER": "CHAR", "LONG VARCHAR": "VARCHAR", "LONG VARGRAPHIC": "DBCLOB", "DOUBLE PRECISION": "DOUBLE"},
    "sqlite": {"INT": "INTEGER", "CHARACTER VARYING": "VARCHAR", "DOUBLE PRECISION": "REAL", "DOUBLE": "REAL"},
}
FAMILY = {
    "INTEGER": "INTEGER", "INT": "INTEGER", "INT4": "INTEGER", "INTEGER4": "INTEGER", "MEDIUMINT": "INTEGER", "SMALLINT": "SMALLINT", "INT2": "SMALLINT", "INTEGER2": "SMALLINT", "TINYINT": "SMALLINT", "SHORT": "SMALLINT",
    "BIGINT": "BIGINT", "INT8": "BIGINT", "INTEGER8": "BIGINT", "VARCHAR": "VARCHAR", "VARCHAR2": "VARCHAR", "NVARCHAR": "VARCHAR", "NVARCHAR2": "VARCHAR", "CHARACTER VARYING": "VARCHAR", "CHAR VARYING": "VARCHAR",
    "NATIONAL VARCHAR": "VARCHAR", "VARCHARACTER": "VARCHAR", "CHAR": "CHAR", "CHARACTER": "CHAR", "NCHAR": "CHAR", "NATIONAL CHAR": "CHAR", "NATIONAL CHARACTER": "CHAR", "TEXT": "TEXT", "CLOB": "TEXT", "NCLOB": "TEXT",
    "LONGTEXT": "TEXT", "MEDIUMTEXT": "TEXT", "TINYTEXT": "TEXT", "NTEXT": "TEXT", "STRING": "TEXT", "LONG": "TEXT", "BLOB": "BLOB", "BYTEA": "BLOB", "RAW": "BLOB", "VARBINARY": "BLOB", "BINARY VARYING": "BLOB", "IMAGE": "BLOB",
    "LONG RAW": "BLOB", "BINARY LARGE OBJECT": "BLOB", "NUMERIC": "NUMERIC", "DECIMAL": "NUMERIC", "NUMBER": "NUMERIC", "DEC": "NUMERIC", "REAL": "REAL", "FLOAT4": "REAL", "SINGLE": "REAL", "DOUBLE": "DOUBLE",
    "DOUBLE PRECISION": "DOUBLE", "FLOAT8": "DOUBLE", "FLOAT": "DOUBLE", "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "BIT": "BOOLEAN", "DATE": "DATE", "TIME": "TIME", "TIME WITHOUT TIME ZONE": "TIME", "TIME WITH TIME ZONE": "TIME",
    "TIMETZ": "TIME", "TIMESTAMP": "TIMESTAMP", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP", "DATETIME": "TIMESTAMP", "DATETIME2": "TIMESTAMP",
    "SMALLDATETIME": "TIMESTAMP", "INTERVAL": "INTERVAL", "INTERVAL YEAR TO MONTH": "INTERVAL", "INTERVAL DAY TO SECOND": "INTERVAL", "UUID": "UUID", "UNIQUEIDENTIFIER": "UUID", "GUID": "UUID", "JSON": "JSON", "JSONB": "JSON",
    "XML": "XML", "XMLTYPE": "XML",
}
PREFERRED = {
    "postgresql": {"INTEGER": "INTEGER", "VARCHAR": "VARCHAR", "TIMESTAMP": "TIMESTAMP"}, "oracle": {"INTEGER": "NUMBER", "VARCHAR": "VARCHAR2", "TIMESTAMP": "TIMESTAMP"},
    "mysql": {"INTEGER": "INT", "VARCHAR": "VARCHAR", "TIMESTAMP": "DATETIME"}, "mariadb": {"INTEGER": "INT", "VARCHAR": "VARCHAR", "TIMESTAMP": "DATETIME"}, "sqlserver": {"INTEGER": "INT", "VARCHAR": "VARCHAR", "TIMESTAMP": "DATETIME2"},
    "db2": {"INTEGER": "INTEGER", "VARCHAR": "VARCHAR", "TIMESTAMP": "TIMESTAMP"}, "sqlite": {"INTEGER": "INTEGER", "VARCHAR": "TEXT", "TIMESTAMP": "DATETIME"},
}
#: Types that a dialect has from a version on, and their families.
SINCE = (("postgresql", "9.4+", "JSONB", "JSON"), ("mysql", "5.7+", "JSON", "JSON"), ("sqlserver", "13.0+", "JSON", "JSON"), ("oracle", "12.2+", "JSON", "JSON"))
UPPER_CASE = ("oracle", "db2")
RESERVED = ("SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "TABLE", "VIEW", "INDEX", "SCHEMA", "DATABASE", "USER", "ORDER", "GROUP", "BY")
_TIMES = ("TIMESTAMP", "TIME", "DATETIME", "DATE")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key] if table else F.lit(None).cast("string")


def type_base(name: Column) -> Column:
    """Upper-case name without its parameters."""
    return F.trim(F.upper(F.regexp_replace(name, r"\s*\(.*$", "")))


def type_parameters(name: Column) -> Column:
    """(precision, scale) of the first parentheses, nulls where there are none."""
    pattern = r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit("")).try_cast("bigint")
    return F.struct(part(1).alias("precision"), part(2).alias("scale"))


def normalised_type(name: Column, dialect: str) -> Column:
    """A dialect's usual spelling: aliases resolved, parameters kept except for times; TINYINT(1) is BOOLEAN for MySQL."""
    base = type_base(name)
    parameters = F.replace(F.regexp_extract(name, r"(\(.*\))\s*$", 1), F.lit(" "), F.lit(""))
    known = F.when(base.isin("DATETIME2", "SMALLDATETIME"), "DATETIME").otherwise(F.coalesce(_lookup(ALIASES.get(dialect, {}), base), base))
    out = F.when(known.isin(*_TIMES), known).otherwise(F.concat(known, parameters))
    return F.when((base == "TINYINT") & (parameters == "(1)") & F.lit(dialect in ("mysql", "mariadb")), "BOOLEAN").otherwise(out)


def canonical_type(name: Column, dialect: str | None = None, version: Column | None = None) -> Column:
    """Family of a type name; whole numbers of up to 18 digits are INTEGER; unknown names are their own family.

    Parameters count as given without spaces (``NUMERIC(18,0)`` is a whole number,
    ``NUMERIC(18, 0)`` isn't); a number without a scale has scale 0.  With a dialect its
    aliases help where the name alone is unknown, with its version also the types that came
    with that.
    """
    base = type_base(name)
    part = lambda k: F.nullif(F.regexp_extract(name, r"\((\d+)(?:,(\d+))?\)", k), F.lit("")).try_cast("bigint")
    whole = F.coalesce(base.isin("NUMBER", "NUMERIC", "DECIMAL") & (F.coalesce(part(2), F.lit(0)) == 0) & (part(1) <= 18), F.lit(False))
    known = [_lookup(FAMILY, base)]
    if dialect:
        known.append(_lookup(FAMILY, type_base(normalised_type(name, dialect))))
    out = F.coalesce(*known, base)
    if dialect and version is not None:
        for own, since, type_name, family in SINCE:
            if own == dialect:
                out = F.when((base == type_name) & product_at_least(version, F.lit(since)), family).otherwise(out)
    return F.when(whole, "INTEGER").otherwise(out)


def preferred_type(name: Column, dialect: str) -> Column:
    family = canonical_type(name)
    return F.coalesce(_lookup(PREFERRED.get(dialect, {}), family), family)


def normalised_identifier(name: Column, dialect: str) -> Column:
    """Quoted names keep their case, others fold as the dialect does."""
    quoted = name.rlike(r"^(\".*\"|`.*`|\[.*\])$")
    inner = F.regexp_replace(name, r"^[\"`\[]|[\"`\]]$", "")
    return F.when(quoted, inner).otherwise(F.upper(name) if dialect in UPPER_CASE else F.lower(name))


def qualified_name(name: Column) -> Column:
    """(object_name, schema_name), parted at the first dot."""
    schema = F.nullif(F.regexp_extract(name, r"^([^.]*)\.", 1), F.lit(""))
    return F.struct(F.regexp_replace(name, r"^[^.]*\.", "").alias("object_name"), schema.alias("schema_name"))


def needs_quotes(name: Column) -> Column:
    """Names with other characters than letters, digits and underscores, and reserved words; the empty name needs none."""
    return name.rlike("[^A-Za-z0-9_]") | F.upper(name).isin(*RESERVED)


def equivalent_types(a: Column, dialect_a: str, b: Column, dialect_b: str) -> Column:
    """Do two type names mean the same? In one dialect they must be spelled alike once normalised; across dialects a common family suffices."""
    same = normalised_type(a, dialect_a) == normalised_type(b, dialect_b)
    return same if dialect_a == dialect_b else same | (canonical_type(a, dialect_a) == canonical_type(b, dialect_b))
