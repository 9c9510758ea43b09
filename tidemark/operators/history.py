"""Questions to the history of applied migrations.

A history has one row for each applied script: ``installed_rank, version, description,
type, script, checksum, success, ...``.  Each function works on a fleet of databases at
once: ``by`` names the columns that tell one history from another.  Aggregates are conditional ones in
one pass wherever the question allows it, so that a long history never has to be sorted in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.versions import numeric_parts, or_empty, version_order
from tidemark.sources.tables import numbered_within

#: Types of scripts that carry a version of their own.
VERSIONED = ("SQL", "PYTHON")
BY = ("db",)


def succeeded(raw: Column) -> Column:
    """True for 1, true and their spellings; null is neither success nor failure."""
    return F.lower(raw.cast("string")).isin("true", "1")


def failed(raw: Column) -> Column:
    return F.lower(raw.cast("string")).isin("false", "0")


def only(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


def _ok() -> Column:
    return F.col("success") == F.lit(True)


def current_version(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The highest version among successful SQL, PYTHON and BASELINE rows; of equal ones the first applied."""
    rows = history.where(_ok() & _is(*VERSIONED, "BASELINE") & (or_empty(F.col("version")) != ""))
    return rows.groupBy(*by).agg(F.max_by("version", F.struct(version_order(F.col("version")), -F.col("installed_rank"))).alias("current_version"))


def current_and_baseline(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """For display: the highest version without baselines, and the last successful baseline."""
    ok = history.where(_ok() & (or_empty(F.col("version")) != ""))
    rank = F.col("installed_rank")
    return ok.groupBy(*by).agg(
        F.max_by(only(_is(*VERSIONED), F.col("version")), only(_is(*VERSIONED), F.struct(version_order(F.col("version")), -rank))).alias("current_version"),
        F.max_by(only(_is("BASELINE"), F.col("version")), only(_is("BASELINE"), rank)).alias("baseline_version"),
    )


def first_baseline(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The baseline of the least rank, successful or not."""
    return history.where(_is("BASELINE")).groupBy(*by).agg(F.min_by("version", "installed_rank").alias("baseline_version"))


#: Ranks of one history that are looked at in one task where their order is the question.
BLOCK = 1 << 16


def before(rows: DataFrame, value: Column, highest: bool, by: Sequence[str] = BY) -> DataFrame:
    """``rows`` with ``_before``: the value of the row before by rank, or the highest of all rows before.

    A history is dealt out in blocks of ranks.  What a block needs from those before it is
    one value, found among one row for each block, so no history is sorted in one task.
    """
    rows = rows.withColumns({"_value": value, "_block": F.floor(F.col("installed_rank") / BLOCK)})
    last = F.max("_value") if highest else F.max_by("_value", "installed_rank")
    across = Window.partitionBy(*by).orderBy("_block")
    carried = F.max("_last").over(across.rowsBetween(Window.unboundedPreceding, -1)) if highest else F.lag("_last").over(across)
    ends = rows.groupBy(*by, "_block").agg(last.alias("_last")).select(*by, "_block", carried.alias("_carried"))
    within = Window.partitionBy(*by, "_block").orderBy("installed_rank")
    own = F.max("_value").over(within.rowsBetween(Window.unboundedPreceding, -1)) if highest else F.lag("_value").over(within)
    found = rows.withColumn("_own", own).join(ends, [*by, "_block"])
    both = F.greatest("_own", "_carried") if highest else F.coalesce("_own", "_carried")
    return found.withColumn("_before", F.coalesce(both, "_own", "_carried")).drop("_own", "_carried", "_block")


def out_of_order_adjacent(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Versioned rows whose numeric parts are below those of the versioned row before them."""
    rows = history.where(_is(*VERSIONED) & (or_empty(F.col("version")) != ""))
    return before(rows, numeric_parts(F.col("version")), False, by).where("_value < _before").select(*by, "installed_rank", "version", "script")


def out_of_order_scripts(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The same by version keys, among successful rows."""
    rows = history.where(_ok() & _is(*VERSIONED) & (or_empty(F.col("version")) != ""))
    return before(rows, version_order(F.col("version")), False, by).where("_value < _before").select(*by, "installed_rank", "script")


def out_of_order_global(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Successful versioned rows applied after a higher version."""
    rows = history.where(_ok() & _is(*VERSIONED) & (or_empty(F.col("version")) != ""))
    return before(rows, version_order(F.col("version")), True, by).where("_before > _value").select(*by, "installed_rank", "version")


def highest_applied(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The highest successfully applied SQL or PYTHON version."""
    rows = history.where(_ok() & _is(*VERSIONED) & (or_empty(F.col("version")) != ""))
    return rows.groupBy(*by).agg(F.max_by("version", F.struct(version_order(F.col("version")), -F.col("installed_rank"))).alias("highest"))


def undone_versions(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Versions with any successful undo."""
    return history.where(_ok() & _is("UNDO_SQL")).select(*by, "version").distinct()


def _ranks(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per version: ranks of its undo and versioned rows, one pass."""
    rank, undo, own = F.col("installed_rank"), _ok() & _is("UNDO_SQL"), _is(*VERSIONED)
    return (
        history.where(or_empty(F.col("version")) != "")
        .groupBy(*by, "version")
        .agg(
            F.min(only(undo, rank)).alias("first_undo"),
            F.max(only(undo, rank)).alias("last_undo"),
            F.max(only(own, rank)).alias("last_any"),
            F.max(only(own & _ok(), rank)).alias("last_ok"),
            F.count_if(_ok()).alias("n_ok"),
        )
    )


def reapplied_after_first_undo(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Versions with a success and with a versioned row, successful or not, after their first undo."""
    return _ranks(history, by).where("last_ok IS NOT NULL AND last_any > first_undo").select(*by, "version")


def reapplied_after_last_undo(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Versions that succeeded after their last undo."""
    return _ranks(history, by).where("last_ok > last_undo").select(*by, "version")


def applied_more_than_once(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Versions with more than one successful row of any type."""
    return _ranks(history, by).where("n_ok > 1").select(*by, "version", "n_ok")


def effectively_undone(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Versions whose last undo comes after all of their successes."""
    return _ranks(history, by).where("last_undo >= coalesce(last_ok, 0)").select(*by, "version", "last_undo")


def analysis(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Executed versions and scripts, deleted scripts, failures, and rows that need repair, as counts."""
    return history.groupBy(*by).agg(
        F.count_distinct(only(_is(*VERSIONED, "BASELINE"), F.col("version"))).alias("executed_versions"),
        F.count_distinct(only(~_is("DELETE", "UNDO_SQL"), F.col("script"))).alias("executed_scripts"),
        F.count_distinct(only(_is("DELETE"), F.col("script"))).alias("deleted_scripts"),
        F.count_if(F.col("success") == F.lit(False)).alias("failed_rows"),
        F.count_if(F.col("success").isNull()).alias("needs_repair"),
    )


def analysis_sets(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """What :func:`analysis` would count, as rows ``output, item, value``: seven sets for each history.

    A version that was undone and not applied again isn't executed, unless a row of it failed; the script of its last success
    goes with it.  Scripts of successful repeatables and callbacks, and versions and scripts of failed
    rows, are executed too, so that they aren't pending; deletions are only deletions.  A repeatable's
    checksum is that of its last success, if known.
    """
    rank, named = F.col("installed_rank"), or_empty(F.col("version")) != ""
    rows = history.where(~F.coalesce(_is("DELETE"), F.lit(False)))
    undone = undone_versions(history, by).where("version IS NOT NULL")
    again = reapplied_after_first_undo(history, by)
    gone = undone.join(again, [*by, "version"], "left_anti")
    last = rows.where(_ok() & _is(*VERSIONED) & named).groupBy(*by, "version").agg(F.max_by("script", "installed_rank").alias("script")).join(gone, [*by, "version"], "left_anti")
    failed_rows = rows.where(F.col("success") == F.lit(False))
    null = F.lit(None).cast("long")

    def of(output: str, df: DataFrame, item: str, value: Column = null) -> DataFrame:
        return df.where(or_empty(F.col(item)) != "").select(*by, F.lit(output).alias("output"), F.col(item).alias("item"), value.cast("long").alias("value"))

    parts = [
        of("executed_versions", last, "version"),
        of("executed_versions", failed_rows, "version"),
        of("executed_scripts", last, "script"),
        of("executed_scripts", rows.where(_ok() & _is("REPEATABLE", "CALLBACK")), "script"),
        of("executed_scripts", failed_rows, "script"),
        of("deleted_scripts", history.where(_is("DELETE")), "script"),
        of("failed_rows", failed_rows, "script", rank),
        of("repeatable_checksums", repeatable_checksums(history, True, by).where("checksum <> 0"), "script", F.col("checksum")),
        of("undone_versions", undone, "version"),
        of("reapplied_versions", again, "version"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def repeatable_checksums(history: DataFrame, successes_only: bool = True, by: Sequence[str] = BY) -> DataFrame:
    """The latest checksum of each repeatable script, of successes or of all rows."""
    rows = history.where(_is("REPEATABLE") & (_ok() if successes_only else F.lit(True)))
    last = rows.groupBy(*by, "script").agg(F.max_by(F.struct("checksum"), "installed_rank").alias("last"))
    return last.select(*by, "script", F.col("last.checksum").alias("checksum"))


def unrepeated(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Second and later successes of scripts of reapplied versions."""
    order = Window.partitionBy(*by, "script").orderBy("installed_rank")
    rows = history.where(_ok() & _is(*VERSIONED)).join(reapplied_after_last_undo(history, by), [*by, "version"], "left_semi")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth > 1").select(*by, "script", "installed_rank", F.col("nth").cast("long").alias("nth"))


def can_be_undone(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Versions whose last SQL row isn't followed by an undo; Python rows don't count."""
    rank = F.col("installed_rank")
    per = history.where(_ok() & _is("SQL", "UNDO_SQL") & (or_empty(F.col("version")) != "")).groupBy(*by, "version").agg(F.max(only(_is("SQL"), rank)).alias("last_sql"), F.max(only(_is("UNDO_SQL"), rank)).alias("last_undo"))
    return per.where("last_sql IS NOT NULL").select(*by, "version", (~F.coalesce(F.col("last_undo") > F.col("last_sql"), F.lit(False))).alias("undoable"))


def undo_advice(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """For each version of a row: whether it may be undone, and which version to undo if it may not.

    It may not if its last successful undo comes after its last successful SQL row.  The advice
    is the last version as text of those with an SQL row and no undo at all; null if there is none.
    """
    rank = F.col("installed_rank")
    per = history.where(or_empty(F.col("version")) != "").groupBy(*by, "version").agg(
        F.max(only(_ok() & _is("UNDO_SQL"), rank)).alias("_undo"), F.max(only(_ok() & _is("SQL"), rank)).alias("_sql"), F.count_if(_is("SQL")).alias("_n_sql"), F.count_if(_is("UNDO_SQL")).alias("_n_undo")
    )
    free = per.where("_n_sql > 0 AND _n_undo = 0").groupBy(*by).agg(F.max("version").alias("_next"))
    may = ~F.coalesce(F.col("_undo") > F.coalesce("_sql", F.lit(0)), F.lit(False))
    return per.join(free, list(by), "left").select(*by, "version", may.alias("may_be_undone"), F.when(~may, F.col("_next")).alias("instead"))


def next_to_undo(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The highest version that can be undone."""
    return can_be_undone(history, by).where("undoable").groupBy(*by).agg(F.max_by("version", F.struct(version_order(F.col("version")), "version")).alias("version"))


def undo_down_to(history: DataFrame, target: str, by: Sequence[str] = BY) -> DataFrame:
    """Rows to undo, newest first, back to the first row at or below the target (which stops the walk)."""
    rows = history.where(_ok() & _is("SQL") & (or_empty(F.col("version")) != ""))
    stop = rows.where(version_order(F.col("version")) <= version_order(F.lit(target))).groupBy(*by).agg(F.max("installed_rank").alias("_stop"))
    return rows.join(stop, list(by), "left").where("_stop IS NULL OR installed_rank > _stop").select(*by, "installed_rank", "version", "script")


def applied_without_undone(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Successful rows, without versioned ones that are effectively undone."""
    ok = history.where(_ok())
    gone = effectively_undone(history, by).select(*by, "version")
    kept = ok.where(_is(*VERSIONED)).join(gone, [*by, "version"], "left_anti").select(*by, "installed_rank", "type", "script")
    return kept.unionByName(ok.where(~_is(*VERSIONED)).select(*by, "installed_rank", "type", "script"))


def _deleted_type(description: Column) -> Column:
    return F.regexp_extract(description, r"^\[DELETE:([A-Z_]+)\]", 1)


def category(kind: Column, description: Column) -> Column:
    """What a row is listed under; a deleted script under the type in its description."""
    shown = F.when((kind == "DELETE") & (F.coalesce(_deleted_type(description), F.lit("")) != ""), _deleted_type(description)).otherwise(kind)
    return F.when(shown.isin(*VERSIONED), "Versioned").when(shown == "REPEATABLE", "Repeatable").when(shown == "UNDO_SQL", "Undo").when(shown == "BASELINE", "Baseline").otherwise("Deleted")


def labelled(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Category and type of each row; deleted scripts show the type in their description."""
    deleted = _deleted_type(F.col("description"))
    shown = F.when(_is("DELETE") & (deleted != ""), deleted).otherwise(F.col("type"))
    return history.select(*by, "installed_rank", category(F.col("type"), F.col("description")).alias("category"), shown.alias("shown_type"), clean_description(F.col("description")).alias("description"))


def clean_description(description: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(description, r"^\[DELETE:[A-Z_]+\]", ""), r"^\s+|\s+$", "")


def duplicate_ranks(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Ranks that several rows share, and how many."""
    return history.groupBy(*by, "installed_rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reranked(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """New ranks for all but the first script of a shared rank: behind the highest, in order of rank and script."""
    top = history.groupBy(*by).agg(F.max("installed_rank").alias("_top"))
    moved = numbered_within(history.select(*by, "installed_rank", "script"), [*by, "installed_rank"], "script", name="_nth").where("_nth > 1")
    return numbered_within(moved, by, "installed_rank", "script").join(top, list(by)).select(*by, "installed_rank", "script", (F.col("_top") + F.col("place")).alias("new_rank"))


def counted(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return history.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def run_statistics(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Totals for a report; baselines count as successes."""
    return history.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_ok() | _is("BASELINE")).alias("successes"),
        F.count_if((F.col("success") == F.lit(False)) & ~_is("BASELINE")).alias("failures"),
        F.count_if(F.col("success").isNull() & ~_is("BASELINE")).alias("unclear"),
        F.count_if(_is("UNDO_SQL")).alias("undos"),
        F.sum(F.col("execution_time").cast("long")).alias("total_ms"),
    )


def candidates_for_missing(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Rows that would be reported missing if there were no scripts: a gate against empty folders."""
    deleted = history.where(_is("DELETE")).select(*by, "script").distinct()
    return history.where(~_is("DELETE", "BASELINE")).join(deleted, [*by, "script"], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
