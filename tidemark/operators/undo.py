"""Undo scripts: the reverse of each statement, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sqltext import dml_target, inserted_literals, object_of, verb, without_comments
from tidemark.sources.tables import spread, stored

#: Statements that one task reverses.
STATEMENTS_A_TASK = 50_000

_DROPPABLE = ("TABLE", "INDEX", "VIEW", "SEQUENCE", "TRIGGER", "PROCEDURE", "FUNCTION")


def reverse_alter(sql: Column) -> Column:
    """(undo_sql, warning) of an ALTER of a table: what was added is dropped; what was dropped, changed or renamed needs a look.

    The first that holds of: a column, a constraint or key added (an unnamed one can't be named), a
    column or constraint dropped, a column changed, the table or a column renamed (which is
    taken back), any other form.
    """
    head = without_comments(sql)
    text = F.upper(head)
    what = object_of(sql)
    table = F.concat_ws(".", what["schema_name"], what["object_name"])
    name = r'["`\[]?(\w+)["`\]]?'
    part = lambda pattern, k=1: F.nullif(F.regexp_extract(head, r"(?is)" + pattern, k), F.lit(""))
    column, constraint = part(rf"\bADD\s+COLUMN\s+(?:IF\s+NOT\s+EXISTS\s+)?{name}"), part(rf"\bADD\s+CONSTRAINT\s+{name}")
    holds = lambda *words: F.greatest(*[text.rlike(w.replace(" ", r"\s+")) for w in words], F.lit(False))
    alter = lambda *rest: F.concat(F.lit("ALTER TABLE "), table, *[F.lit(x) if isinstance(x, str) else x for x in rest])
    renamed, renamed_column = part(rf"\bRENAME\s+TO\s+{name}"), part(rf"\bRENAME\s+COLUMN\s+{name}\s+TO\s+{name}")
    gone = "cannot be reversed without the original definition"
    cases = (
        (holds("ADD COLUMN"), alter(" DROP COLUMN ", column), F.when(column.isNull(), "no column name found")),
        (holds("ADD CONSTRAINT", "ADD PRIMARY KEY", "ADD FOREIGN KEY") & constraint.isNull(), None, F.lit("no constraint name found")),
        (constraint.isNotNull() & holds("PRIMARY KEY"), alter(" DROP PRIMARY KEY"), None),
        (constraint.isNotNull() & holds("FOREIGN KEY"), alter(" DROP FOREIGN KEY ", constraint), None),
        (constraint.isNotNull(), alter(" DROP CONSTRAINT ", constraint), None),
        (holds("DROP COLUMN"), None, F.lit(f"DROP COLUMN {gone}")),
        (holds("DROP CONSTRAINT", "DROP PRIMARY KEY", "DROP FOREIGN KEY"), None, F.lit(f"DROP CONSTRAINT {gone}")),
        (holds("MODIFY COLUMN", "ALTER COLUMN"), None, F.lit(f"a changed column {gone}")),
        (renamed_column.isNotNull(), alter(" RENAME COLUMN ", part(rf"\bRENAME\s+COLUMN\s+{name}\s+TO\s+{name}", 2), " TO ", renamed_column), None),
        (renamed.isNotNull(), F.concat(F.lit("ALTER TABLE "), F.concat_ws(".", what["schema_name"], renamed), F.lit(" RENAME TO "), what["object_name"]), None),
    )
    undo, warning = F.lit(None).cast("string"), F.lit("cannot reverse ALTER")
    for holds_here, sql_here, warning_here in reversed(cases):
        undo = F.when(holds_here, sql_here if sql_here is not None else F.lit(None)).otherwise(undo)
        warning = F.when(holds_here, warning_here if warning_here is not None else F.lit(None)).otherwise(warning)
    return F.struct(undo.alias("undo_sql"), warning.alias("warning"))


def reverse_statement(sql: Column) -> Column:
    """(undo_sql, warning): a statement that takes ``sql`` back, or why there is none."""
    what = object_of(sql)
    action = verb(without_comments(sql))
    name = F.concat_ws(".", what["schema_name"], what["object_name"])
    altered = reverse_alter(sql)
    where = F.array_join(F.transform(inserted_literals(sql), lambda x: F.regexp_replace(x, "^([^=]*)=", "$1 = ")), " AND ")
    undo = (
        F.when((action == "CREATE") & what["object_type"].isin(*_DROPPABLE), F.concat(F.lit("DROP "), what["object_type"], F.lit(" "), name))
        .when((action == "ALTER") & (what["object_type"] == "TABLE"), altered["undo_sql"])
        .when((action == "INSERT") & (where != ""), F.concat(F.lit("DELETE FROM "), dml_target(sql), F.lit(" WHERE "), where))
    )
    warning = F.when((action == "ALTER") & (what["object_type"] == "TABLE"), altered["warning"]).when(undo.isNull(), F.concat(F.lit("cannot reverse "), action)).when(action == "INSERT", "review: deletes by equality")
    return F.struct(undo.alias("undo_sql"), warning.alias("warning"))


def reversed_statements(statements: DataFrame) -> DataFrame:
    """``stmt_id, undo_sql, warning`` of statements ``(stmt_id, sql_text)``, dealt out evenly: patterns take long, and a few files would be a few tasks."""
    rows = spread(statements.select("stmt_id", "sql_text"), rows=STATEMENTS_A_TASK)
    return rows.select("stmt_id", reverse_statement(F.col("sql_text")).alias("r")).select("stmt_id", "r.*")


def reversed_script(statements: DataFrame, by: list[str]) -> DataFrame:
    """Reverse of each script's statements ``(..., stmt_id, sql_text)``, newest first; rows of tables that the script itself made go with them.

    Each statement is read by patterns once, in a step whose rows are written.
    """
    sql = F.col("sql_text")
    what = object_of(sql)
    created = F.when((verb(without_comments(sql)) == "CREATE") & (what["object_type"] == "TABLE"), F.lower(F.concat_ws(".", what["schema_name"], what["object_name"])))
    dealt = spread(statements.select(*by, "stmt_id", "sql_text"), rows=STATEMENTS_A_TASK)
    rows = stored(dealt.select(*by, "stmt_id", reverse_statement(sql).alias("_r"), F.lower(dml_target(sql)).alias("_table"), created.alias("_created")))
    made = rows.where("_created IS NOT NULL").select(*by, F.col("_created").alias("_table")).distinct()
    kept = rows.where("_table IS NULL").select(*by, "stmt_id", "_r").unionByName(rows.where("_table IS NOT NULL").join(made, [*by, "_table"], "left_anti").select(*by, "stmt_id", "_r"))
    return kept.select(*by, (-F.col("stmt_id")).alias("undo_order"), "_r.undo_sql", "_r.warning")
