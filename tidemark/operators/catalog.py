"""Catalog objects: counts, completeness, and differences between two definitions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_schema(objects: DataFrame, kinds: list[str]) -> DataFrame:
    """Objects of each kind in each schema (public if none)."""
    rows = objects.groupBy(F.lower(F.coalesce("schema_name", F.lit("public"))).alias("schema_name"))
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def completeness(objects: DataFrame) -> DataFrame:
    """Mean share of captured properties of each kind, and how far that can be trusted."""
    share = F.when(F.col("total") > 0, F.col("captured") / F.col("total")).otherwise(1.0)
    rows = objects.groupBy("kind").agg(F.round(F.avg(share), 6).alias("score"), F.count_if(F.col("captured") < F.col("total")).alias("incomplete"))
    confidence = F.when((F.col("score") >= 0.95) & (F.col("incomplete") == 0), "HIGH").when(F.col("score") >= 0.8, "MEDIUM").when(F.col("score") >= 0.6, "LOW").otherwise("VERY_LOW")
    return rows.withColumn("confidence", confidence)


def grouped_names(objects: DataFrame) -> DataFrame:
    """Distinct names of each kind and schema: how many, and the first and last. Names themselves stay rows (:func:`distinct_names`)."""
    return objects.groupBy("kind", F.coalesce("schema_name", F.lit("public")).alias("schema_name")).agg(F.count_distinct(F.lower("name")).alias("n"), F.min(F.lower("name")).alias("first_name"), F.max(F.lower("name")).alias("last_name"))


def distinct_names(objects: DataFrame) -> DataFrame:
    return objects.select("kind", F.lower(F.coalesce("schema_name", F.lit("public"))).alias("schema_name"), F.lower("name").alias("name")).distinct()


def summary_text(objects: DataFrame) -> DataFrame:
    """Counts of the kinds that occur, as one text."""
    counts = objects.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))  # a row for each kind
    text = F.array_sort(F.collect_list(F.concat(F.col("kind"), F.lit(": "), F.col("n").cast("string"))))
    return counts.agg(F.array_join(text, ", ").alias("summary"))


def assembled_constraints(rows: DataFrame) -> DataFrame:
    """One row for each constraint with its columns in order of position."""
    once = rows.select("tab", "type", "name", "pos", "col").distinct()
    columns = F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda x: x["col"])
    return once.groupBy("tab", "type", "name").agg(F.array_join(columns, ",").alias("columns"))


def column_diff(columns: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Differences of two sides of each table, a row for each: added, removed, or a changed property."""
    key = F.lower("col").alias("name")
    a = columns.where(F.col("side") == left).select("tab", key, F.struct("type", "nullable", "dflt").alias("x"))
    b = columns.where(F.col("side") == right).select("tab", key, F.struct("type", "nullable", "dflt").alias("y"))
    both = a.join(b, ["tab", "name"], "full")
    changes = F.array_compact(
        F.array(
            F.when(F.col("y").isNull(), "removed"),
            F.when(F.col("x").isNull(), "added"),
            F.when(F.lower("x.type") != F.lower("y.type"), "type"),
            F.when(F.col("x.nullable") != F.col("y.nullable"), "nullable"),
            F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("x.dflt").eqNullSafe(F.col("y.dflt")), "default"),
        )
    )
    return both.select("tab", "name", F.explode(changes).alias("difference"))


def option_diff(options: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Options ``(tab, side, option, value)`` of tables that differ, such as temporary, tablespace or versioning: ``tab, option, old, new``.

    Names of options are compared in lower case, values as they are; a missing option and a null one are the same.
    """
    side = lambda s, name: options.where(F.col("side") == s).groupBy("tab", F.lower("option").alias("option")).agg(F.max("value").alias(name))
    both = side(left, "old").join(side(right, "new"), ["tab", "option"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("tab", "option", "old", "new")


def merged_objects(first: DataFrame, second: DataFrame) -> DataFrame:
    """Objects of both, the second winning where name (case aside) and kind agree; of several the greatest id."""
    rows = first.withColumn("_side", F.lit(1)).unionByName(second.withColumn("_side", F.lit(2)))
    best = rows.groupBy("kind", F.lower("name").alias("name")).agg(F.max_by(F.struct("object_id", "_side"), F.struct("_side", "object_id")).alias("best"))
    return best.select("kind", "name", F.col("best.object_id").alias("object_id"), F.col("best._side").cast("long").alias("side"))


def constraints_to_add(new: DataFrame, known: DataFrame) -> DataFrame:
    """New constraints whose trimmed name, case aside, the table doesn't have yet."""
    key = lambda df: df.withColumn("_name", F.upper(F.trim("name")))
    return key(new).join(key(known).select("tab", "_name"), ["tab", "_name"], "left_anti").select("tab", "type", "name").distinct()


def unique_beside_primary(rows: DataFrame) -> DataFrame:
    """Unique constraints whose set of columns isn't that of the table's primary key."""
    sets = rows.select("tab", "type", "name", "col").distinct().groupBy("tab", "type", "name").agg(F.array_join(F.array_sort(F.collect_set("col")), ",").alias("columns"))
    primary = sets.where("type = 'PRIMARY KEY'").select("tab", "columns").distinct()
    return sets.where("type = 'UNIQUE'").join(primary, ["tab", "columns"], "left_anti").select("tab", "name", "columns")


def constraint_problems(rows: DataFrame) -> DataFrame:
    """Tables with several primary keys, names used for two kinds, trivial checks, and unique column sets that repeat."""
    made = rows.groupBy("tab", "type", "name").agg(F.array_join(F.array_sort(F.collect_set("col")), ",").alias("columns"), F.bool_or(F.regexp_replace("expr", r"\s", "").isin("", "1=1")).alias("trivial"))
    several = made.where("type = 'PRIMARY KEY'").groupBy("tab").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tab", F.lit("several primary keys").alias("problem"), F.col("n").cast("string").alias("detail"))
    names = made.groupBy("tab", "name").agg(F.count_distinct("type").alias("n")).where("n > 1").select("tab", F.lit("name used twice").alias("problem"), F.col("name").alias("detail"))
    trivial = made.where("type = 'CHECK' AND trivial").select("tab", F.lit("trivial check").alias("problem"), F.col("name").alias("detail"))
    same = made.where("type = 'UNIQUE'").groupBy("tab", "columns").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tab", F.lit("unique columns repeat").alias("problem"), F.col("columns").alias("detail"))
    return several.unionByName(names).unionByName(trivial).unionByName(same)


def reference_problems(rows: DataFrame, columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """What constraints refer to and isn't there: ``tab, problem, detail``.

    ``rows (tab, type, name, col)`` are the columns of constraints, ``columns (tab, col, nullable,
    computed, expr)`` those of tables, ``foreign_keys (tab, name, pos, col, ref_tab, ref_col)`` what foreign keys point to.
    Found are columns that a constraint names and its table lacks, nullable columns of primary
    keys, computed columns without an expression, and foreign keys without a table, without columns,
    with another number of columns there, or whose columns there contain no key of that table.  Names are
    compared in lower case; a table without any columns is one problem and has no others of its columns.
    """
    low = lambda c: F.lower(F.col(c))
    have = columns.select("tab", low("col").alias("col"), "nullable", "computed", "expr")
    with_columns = have.select("tab").distinct()
    named = rows.where("col IS NOT NULL").select("tab", "type", "name", low("col").alias("col")).distinct()
    problem = lambda text: F.lit(text).alias("problem")
    at = F.concat_ws(".", "name", "col").alias("detail")

    bare = rows.select("tab").distinct().join(with_columns, "tab", "left_anti").select("tab", problem("no columns"), F.lit("").alias("detail"))
    missing = named.join(with_columns, "tab", "left_semi").join(have.select("tab", "col"), ["tab", "col"], "left_anti").select("tab", problem("missing column"), at).distinct()
    nullable = named.where("type = 'PRIMARY KEY'").join(have.where("nullable").select("tab", "col"), ["tab", "col"], "left_semi").select("tab", problem("nullable key column"), at)
    empty = have.where("computed AND coalesce(expr, '') = ''").select("tab", problem("computed without expression"), F.col("col").alias("detail"))

    keys = foreign_keys.groupBy("tab", "name").agg(F.max("ref_tab").alias("ref_tab"), F.count_distinct("pos").alias("n"), F.count_distinct(F.when(F.col("ref_col").isNotNull(), F.col("pos"))).alias("n_ref"))
    no_table = keys.where("ref_tab IS NULL").select("tab", problem("foreign key without table"), F.col("name").alias("detail"))
    no_columns = keys.where("n_ref = 0").select("tab", problem("foreign key without columns"), F.col("name").alias("detail"))
    uneven = keys.where("n_ref > 0 AND n_ref <> n").select("tab", problem("foreign key with other columns"), F.col("name").alias("detail"))
    # A key is contained if as many of its columns meet as it has.
    sides = foreign_keys.where("ref_col IS NOT NULL").select("tab", "name", F.col("ref_tab").alias("_t"), low("ref_col").alias("_c")).distinct()
    unique = named.where("type IN ('PRIMARY KEY', 'UNIQUE')").select(F.col("tab").alias("_t"), "type", F.col("name").alias("_key"), F.col("col").alias("_c"))
    sizes = unique.groupBy("_t", "type", "_key").agg(F.count(F.lit(1)).alias("_size"))
    met = sides.join(unique, ["_t", "_c"]).groupBy("tab", "name", "_t", "type", "_key").agg(F.count(F.lit(1)).alias("_met"))
    held = met.join(sizes, ["_t", "type", "_key"]).where("_met = _size").select("tab", "name").distinct()
    no_key = keys.where("ref_tab IS NOT NULL AND n_ref > 0").join(held, ["tab", "name"], "left_anti").select("tab", problem("foreign key without key"), F.col("name").alias("detail"))
    out = bare
    for found in (missing, nullable, empty, no_table, no_columns, uneven, no_key):
        out = out.unionByName(found)
    return out


def referenced_columns(foreign_keys: DataFrame, keys: DataFrame) -> DataFrame:
    """The column that each column of a foreign key points to: ``tab, name, pos, col, ref_tab, ref_col``.

    ``foreign_keys (tab, name, pos, col, ref_tab)`` meet the key columns ``keys (tab, pos, col)``
    of the table they point to by place; those without a counterpart aren't returned.
    """
    targets = keys.select(F.col("tab").alias("ref_tab"), "pos", F.col("col").alias("ref_col")).distinct()
    return foreign_keys.join(targets, ["ref_tab", "pos"]).select("tab", "name", "pos", "col", "ref_tab", "ref_col")


def null_counts(df: DataFrame) -> DataFrame:
    """For each column, how many rows are null: a check before NOT NULL."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns])).alias("x")).select("x.*")


def enriched_columns(columns: DataFrame, details: DataFrame) -> DataFrame:
    """Columns with details found under the same name, case aside; the first detail by position counts."""
    one = details.groupBy("tab", F.lower("col").alias("_name")).agg(F.min_by("dflt", "pos").alias("detail"))
    return columns.withColumn("_name", F.lower("col")).join(one, ["tab", "_name"], "left").select("tab", "col", "type", "detail")


def without_internal(objects: DataFrame, internal: DataFrame) -> DataFrame:
    """Objects that aren't bookkeeping tables (by lower-case name)."""
    return objects.join(internal.select(F.lower("name").alias("_n")).distinct(), F.lower("name") == F.col("_n"), "left_anti")


def missing_columns(present: list[str], required: list[str], df: DataFrame) -> DataFrame:
    """Required columns that a foreign history lacks."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in required])).alias("column_name")).where(~F.lower("column_name").isin(*[c.lower() for c in present]))


def same_constraints(a: DataFrame, b: DataFrame) -> DataFrame:
    """Constraints of both sides with equal table, kind, name (case aside) and set of columns."""

    def made(df: DataFrame) -> DataFrame:
        return df.groupBy("tab", "type", F.lower("name").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.lower("col"))), ",").alias("columns"))

    return made(a).join(made(b), ["tab", "type", "name", "columns"], "left_semi")


def drop_order(objects: DataFrame) -> DataFrame:
    """Distinct objects with the step in which they can be dropped: what others rest on goes last."""
    # Kinds in the order in which they are dropped.
    kinds = ("trigger", "view", "procedure", "index", "table", "sequence")
    step = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("long")
    return distinct_names(objects).select("kind", "schema_name", "name", step.alias("step"))
