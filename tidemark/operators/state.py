"""What is pending, what has drifted and how each row is shown: scripts against history.

``scripts`` has ``script_id, name, content`` and the columns of ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checksums import script_checksum
from tidemark.functions.scripts import base_name, quick_kind, tags, with_parsed_names
from tidemark.functions.versions import or_empty, version_order
from tidemark.sources.tables import numbered_within, overwrite_touched, stored

from .history import BY, VERSIONED, category, clean_description, effectively_undone, first_baseline, highest_applied, out_of_order_adjacent, repeatable_checksums, undone_versions


def _ok() -> Column:
    return F.col("success") == F.lit(True)


def resolved_scripts(scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Scripts with what their names say (``kind`` by the quick rule), their tags and checksum.

    Contents are read once: the rows, without contents, are written and read back.  Scripts that
    are resolved already stay as they are, so a report resolves them once for all its parts.
    """
    if "file_checksum" in scripts.columns:
        return scripts
    named = with_parsed_names(scripts.withColumn("_name", base_name(F.col("name"))), "_name")
    return stored(named.select(*by, "script_id", "name", quick_kind(F.col("_name")).alias("kind"), "named_kind", "version", "description", tags(F.col("name")).alias("tags"), script_checksum(F.col("content")).alias("file_checksum")))


@dataclass(frozen=True)
class Facts:
    """What reports ask a history again and again, aggregated once and written: a row for each version, script and database."""

    versions: DataFrame
    scripts: DataFrame
    databases: DataFrame


def facts(history: DataFrame, by: Sequence[str] = BY) -> Facts:
    """One conditional aggregation each by version, by script and by database; all combine before their shuffle."""
    rank, undo, own = F.col("installed_rank"), _ok() & (F.col("type") == "UNDO_SQL"), F.col("type").isin(*VERSIONED)
    base, repeatable = F.col("type") == "BASELINE", F.col("type") == "REPEATABLE"
    named, order = or_empty(F.col("version")) != "", version_order(F.col("version"))
    versions = history.groupBy(*by, "version").agg(
        F.min(F.when(undo, rank)).alias("first_undo"),
        F.max(F.when(undo, rank)).alias("last_undo"),
        F.max(F.when(own, rank)).alias("last_any"),
        F.max(F.when(own & _ok(), rank)).alias("last_ok"),
        F.coalesce(F.bool_or(own | base), F.lit(False)).alias("ran"),
    )
    versions = versions.withColumns({"gone": F.coalesce((F.col("last_undo") >= F.coalesce("last_ok", F.lit(0))) & named, F.lit(False)), "again": F.coalesce(F.col("last_ok").isNotNull() & (F.col("last_any") > F.col("first_undo")) & named, F.lit(False))})
    scripts = history.groupBy(*by, "script").agg(
        F.coalesce(F.bool_or(own | base), F.lit(False)).alias("ran"),
        F.max_by(F.when(repeatable & _ok(), F.struct("checksum")), F.when(repeatable & _ok(), rank)).alias("last_ok"),
        F.max_by(F.when(repeatable, F.struct("checksum")), F.when(repeatable, rank)).alias("last"),
    )
    top = lambda rows: F.max_by(F.when(rows, F.col("version")), F.when(rows, F.struct(order, -rank)))
    databases = history.groupBy(*by).agg(top(_ok() & (own | base) & named).alias("current_version"), top(_ok() & own & named).alias("highest"), F.min_by(F.when(base, F.struct("version")), F.when(base, rank)).alias("_b"))
    return Facts(stored(versions), stored(scripts), stored(databases.select(*by, "current_version", "highest", F.col("_b.version").alias("baseline_version"))))


def ordered_scripts(scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Place of each script in its group: versioned ones by version, others by name."""
    group = F.when(F.col("kind").isin(*VERSIONED), "versioned").otherwise(F.lower("kind"))
    rows = resolved_scripts(scripts, by).withColumn("group", group)
    rows = rows.select(*by, "group", F.when(F.col("group") == "versioned", version_order(or_empty(F.col("version")))).alias("_version"), F.lower("name").alias("_name"), "script_id")
    return numbered_within(rows, [*by, "group"], "_version", "_name", "script_id").select(*by, "script_id", "group", "place")


def filtered_scripts(scripts: DataFrame, target: str | None = None, tag_list: Sequence[str] = (), without_tags: Sequence[str] = (), versions: Sequence[str] = (), without_versions: Sequence[str] = (), fold_case: bool = True, by: Sequence[str] = BY) -> DataFrame:
    """Resolved scripts up to a target version, with given versions and tags.

    Versions are compared as text, the target by version order; any shared tag suffices, case
    aside unless ``fold_case`` is false.  Scripts without tags are left out if tags are asked for.
    """
    fold = (lambda t: F.lower(F.trim(t))) if fold_case else (lambda t: t)
    own = F.transform("tags", fold)
    given = lambda some: F.array(*[F.lit(t.strip().lower() if fold_case else t) for t in some])
    keep = F.lit(True)
    if target is not None:
        keep &= F.col("version").isNull() | (version_order(or_empty(F.col("version"))) <= version_order(F.lit(target)))
    if versions:
        keep &= F.coalesce(F.col("version").isin(*versions), F.lit(False))
    if without_versions:
        keep &= F.coalesce(~F.col("version").isin(*without_versions), F.lit(True))
    if tag_list:
        keep &= F.arrays_overlap(own, given(tag_list))
    if without_tags:
        keep &= ~F.arrays_overlap(own, given(without_tags))
    return resolved_scripts(scripts, by).where(keep)


def pending(history: DataFrame, scripts: DataFrame, target: str | None = None, by: Sequence[str] = BY, known: Facts | None = None) -> DataFrame:
    """Scripts to run, with the reason.

    A versioned script is pending unless its version, or its name, has run; an effectively
    undone version is pending again; one at or below the baseline or the current version is
    skipped (``below``) and reported.  A repeatable one is pending if it never succeeded or
    its checksum has changed.  Undo scripts, callbacks and baselines never are.
    """
    rows = filtered_scripts(scripts, target, by=by)
    known = known or facts(history, by)
    versions = known.versions.where("version <> '' AND (ran OR gone)").select(*by, "version", F.when(F.col("ran"), True).alias("_by_version"), F.col("gone").alias("_undone"))
    names = known.scripts.where("ran").select(*by, F.col("script").alias("name"), F.lit(True).alias("_by_name"))
    limits = known.databases.select(*by, F.greatest(*[version_order(F.col(c)) for c in ("current_version", "baseline_version")]).alias("_limit"))
    versioned = rows.where(F.col("kind").isin(*VERSIONED) & F.col("version").isNotNull()).join(versions, [*by, "version"], "left").join(names, [*by, "name"], "left").join(limits, list(by), "left")
    has_run = F.coalesce("_by_version", "_by_name", F.lit(False))
    below = F.coalesce(version_order(F.col("version")) <= F.col("_limit"), F.lit(False))
    reason = F.when(F.coalesce("_undone", F.lit(False)), "undone").when(has_run, None).when(below, "below").otherwise("new")
    last = known.scripts.where("last_ok IS NOT NULL").select(*by, F.col("script").alias("name"), F.col("last_ok.checksum").alias("checksum"), F.lit(True).alias("_seen"))
    repeatable = rows.where("kind = 'REPEATABLE'").join(last, [*by, "name"], "left").withColumn("reason", F.when(F.col("_seen").isNull(), "new").when(F.col("checksum") != F.col("file_checksum"), "changed"))
    columns = [*by, "script_id", "name", "kind", "version", "reason"]
    return versioned.withColumn("reason", reason).select(*columns).unionByName(repeatable.select(*columns)).where("reason IS NOT NULL")


def _with_state(history: DataFrame, scripts: DataFrame, by: Sequence[str], known: Facts | None = None) -> DataFrame:
    """History rows with ``state`` and ``resolved`` (there is a file of that name)."""
    known = known or facts(history, by)
    undone = known.versions.where("version <> '' AND first_undo IS NOT NULL").select(*by, "version", F.when(F.col("again"), "Success").otherwise("Undone").alias("_undone"))
    late = out_of_order_adjacent(history, by).select(*by, "version").distinct().withColumn("_late", F.lit(True))
    latest = known.scripts.where("last IS NOT NULL").select(*by, "script", F.col("last.checksum").alias("_latest"))
    files = scripts.select(*by, base_name(F.col("name")).alias("script")).distinct().withColumn("_file", F.lit(True))
    top = known.databases.select(*by, version_order(F.col("highest")).alias("_highest"))
    rows = history.join(undone, [*by, "version"], "left").join(late, [*by, "version"], "left").join(files, [*by, "script"], "left")
    rows = rows.join(latest, [*by, "script"], "left").join(top, list(by), "left")
    future = F.coalesce((or_empty(F.col("version")) != "") & (version_order(F.col("version")) > F.col("_highest")), F.lit(False))
    missing = F.col("_file").isNull()
    # A checksum of 0 is unknown; a latest one that is null differs from any.
    outdated = (F.col("type") == "REPEATABLE") & (F.coalesce("checksum", F.lit(0)) != 0) & ~F.coalesce(F.col("_latest") == F.col("checksum"), F.lit(False))
    state = (
        F.when(F.col("type") == "DELETE", "Deleted")
        .when(F.col("type") == "BASELINE", "Baseline")
        .when(F.col("success") == F.lit(False), F.when(missing & future, "Failed (Future)").when(missing, "Failed (Missing)").otherwise("Failed"))
        .when(_ok() & (F.col("type") == "UNDO_SQL"), "Success")
        .when(_ok() & F.col("_undone").isNotNull(), F.col("_undone"))
        .when(_ok() & F.coalesce("_late", F.lit(False)), "Out of Order")
        .when(_ok() & outdated, "Outdated")
        .when(_ok() & missing, F.when(future, "Future").otherwise("Missing"))
        .when(_ok(), "Success")
        .when(F.col("success").isNull(), "Needs repair")
        .otherwise("Unknown")
    )
    return rows.select(*history.columns, state.alias("state"), (~missing).alias("resolved"))


def history_states(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY, known: Facts | None = None) -> DataFrame:
    """How each history row is shown.

    Deleted, baseline, and failed rows (of a missing script "Missing", or "Future" above the
    highest applied version) come first.  Of successful rows an undo is a success, and so is
    a version that was undone and applied again; then the first that holds of: undone, out of
    order, outdated (the latest run of a repeatable had another checksum), missing or future,
    success.  Rows that are neither need repair.
    """
    return _with_state(history, scripts, by, known).select(*by, "installed_rank", "version", "type", "script", "state")


def pending_states(history: DataFrame, scripts: DataFrame, target: str | None = None, by: Sequence[str] = BY, known: Facts | None = None) -> DataFrame:
    """How pending scripts and undo scripts are shown."""
    baselines = known.databases.select(*by, "baseline_version") if known else first_baseline(history, by)
    rows = resolved_scripts(scripts, by).where(F.col("kind").isin(*VERSIONED, "REPEATABLE", "UNDO_SQL"))
    undo = rows.where("kind = 'UNDO_SQL'").select(*by, "version").distinct().withColumn("_undo", F.lit(True))
    key = version_order(or_empty(F.col("version")))
    state = (
        F.when(F.col("kind") == "REPEATABLE", "Pending")
        .when(F.col("kind") == "UNDO_SQL", "Available")
        .when(F.coalesce(key <= version_order(F.col("baseline_version")), F.lit(False)), "Below Baseline")
        .when(F.lit(target is not None) & (key > version_order(F.lit(target or ""))), "Above Target")
        .when(F.col("_undo").isNotNull(), "Available")
        .otherwise("Pending")
    )
    return rows.join(undo, [*by, "version"], "left").join(baselines, list(by), "left").select(*by, "script_id", "kind", "version", state.alias("state"))


def available_undos(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Undo scripts of effectively undone versions."""
    undos = resolved_scripts(scripts, by).where("kind = 'UNDO_SQL'")
    return undos.join(effectively_undone(history, by), [*by, "version"], "left_semi").select(*by, "script_id", "name", "version")


def undoable(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Applied versions, and whether there is an undo script for them."""
    undo = resolved_scripts(scripts, by).where("kind = 'UNDO_SQL'").select(*by, "version").distinct().withColumn("_undo", F.lit(True))
    return history.where(_ok() & F.col("type").isin(*VERSIONED)).select(*by, "version").distinct().join(undo, [*by, "version"], "left").select(*by, "version", F.col("_undo").isNotNull().alias("undoable"))


def matching_undo(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The first undo script of each applied version, by name."""
    undo = resolved_scripts(scripts, by).where("kind = 'UNDO_SQL'").groupBy(*by, "version").agg(F.min_by("name", F.struct("name", "script_id")).alias("undo_script"))
    return history.where(_ok() & F.col("type").isin(*VERSIONED)).select(*by, "version").distinct().join(undo, [*by, "version"])


def still_pending(plan: DataFrame, history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Those of ``plan`` (version, type) without a success after the version's last undo: a second look once a lock is held."""
    undo = history.where(_ok() & (F.col("type") == "UNDO_SQL")).groupBy(*by, "version").agg(F.max("installed_rank").alias("_undo"))
    done = history.where(_ok() & F.col("type").isin(*VERSIONED)).groupBy(*by, "version", "type").agg(F.max("installed_rank").alias("_done")).join(undo, [*by, "version"], "left").where("_done > coalesce(_undo, 0)")
    return plan.join(done, [*by, "version", "type"], "left_anti")


#: Columns of the unified listing, after those that tell histories apart.
LISTED = ("category", "version", "description", "type", "state", "execution_time", "script", "checksum", "installed_by", "installed_rank", "success", "resolved", "source", "installed_on")


def _shown_version(version: Column) -> Column:
    return F.replace(or_empty(version), F.lit("_"), F.lit("."))


def listing(history: DataFrame, scripts: DataFrame, target: str | None = None, by: Sequence[str] = BY) -> DataFrame:
    """All history rows with their states, all pending scripts with theirs, and undo scripts of undone versions that aren't pending."""
    scripts = resolved_scripts(scripts, by)
    known = facts(history, by)
    rows = _with_state(history, scripts, by, known)
    labels = category(F.col("type"), F.col("description"))
    shown = rows.select(*by, labels.alias("category"), _shown_version(F.col("version")).alias("version"), clean_description(F.col("description")).alias("description"), "type", "state", "execution_time", "script", "checksum", "installed_by", F.col("installed_rank"), "success", "resolved", F.lit("applied").alias("source"), "installed_on")
    new = stored(pending(history, scripts, target, by, known).where("reason <> 'below'").select(*by, "script_id"))
    files = resolved_scripts(scripts, by).join(new, [*by, "script_id"], "left_semi").join(pending_states(history, scripts, target, by, known).select(*by, "script_id", "state"), [*by, "script_id"])
    null = lambda kind: F.lit(None).cast(kind)
    waiting = files.select(*by, category(F.col("kind"), F.lit("")).alias("category"), _shown_version(F.col("version")).alias("version"), "description", F.col("kind").alias("type"), "state", null("int").alias("execution_time"), F.col("name").alias("script"), F.col("file_checksum").cast("int").alias("checksum"), null("string").alias("installed_by"), null("long").alias("installed_rank"), null("boolean").alias("success"), F.lit(True).alias("resolved"), F.lit("pending").alias("source"), null("date").alias("installed_on"))
    more = synthetic_undos(history, scripts, by, known).join(waiting.where("version <> ''").select(*by, "version").distinct(), [*by, "version"], "left_anti")
    undo = more.select(*by, F.lit("Undo").alias("category"), "version", "description", F.lit("UNDO_SQL").alias("type"), F.lit("Available").alias("state"), null("int").alias("execution_time"), F.concat(F.lit("U"), "version", F.lit("__.sql")).alias("script"), null("int").alias("checksum"), null("string").alias("installed_by"), null("long").alias("installed_rank"), null("boolean").alias("success"), F.lit(True).alias("resolved"), F.lit("pending").alias("source"), null("date").alias("installed_on"))
    return shown.unionByName(waiting).unionByName(undo)


def with_undo_file(versions: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Those of ``versions`` for which there is a file ``U<version>*.sql``: version 1 is also met by ``U10__x.sql``.

    Each such file's name is cut at the lengths that versions have, so the search for prefixes is
    an equi-join.
    """
    lengths = versions.select(F.length("version").alias("_n")).distinct()
    stems = scripts.select(*by, F.regexp_extract(base_name(F.col("name")), r"(?s)^U(.+)\.sql$", 1).alias("_stem")).where("_stem <> ''").distinct()
    starts = stems.join(lengths, F.col("_n") <= F.length("_stem")).select(*by, F.expr("left(_stem, _n)").alias("version")).distinct()
    return versions.join(starts, [*by, "version"], "left_semi")


def synthetic_undos(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY, known: Facts | None = None) -> DataFrame:
    """Undone versions with an undo file, and the description of the version's first row."""
    undone = known.versions.where("first_undo IS NOT NULL").select(*by, "version") if known else undone_versions(history, by)
    undone = with_undo_file(undone.where("version <> ''"), scripts, by)
    rows = history.where(F.col("type").isin(*VERSIONED)).groupBy(*by, _shown_version(F.col("version")).alias("version")).agg(F.min_by(clean_description(F.col("description")), "installed_rank").alias("description"))
    return undone.join(rows, [*by, "version"], "left").select(*by, "version", F.coalesce("description", F.concat(F.lit("Undo migration "), "version")).alias("description"))


def info(history: DataFrame, scripts: DataFrame, target: str | None = None, by: Sequence[str] = BY, need_undone: bool = True) -> DataFrame:
    """The status report: history rows, then pending scripts.

    Earlier runs of a repeatable with another checksum than its last success are hidden.  A
    successful version is undone if an undo of it succeeded later and (with ``need_undone``)
    no success of it came after that.  Pending scripts come in ``place``: versioned ones by
    version as text, then others by name.
    """
    scripts = resolved_scripts(scripts, by)
    known = facts(history, by)
    latest = known.scripts.where("last_ok IS NOT NULL").select(*by, "script", F.col("last_ok.checksum").alias("_latest"), F.lit("REPEATABLE").alias("_known"))
    undos = known.versions.where("last_undo IS NOT NULL").select(*by, "version", F.col("last_undo").alias("_undo"), F.col("gone").alias("_gone"))
    undo = resolved_scripts(scripts, by).where("named_kind = 'UNDO_SQL' AND version IS NOT NULL").select(*by, "version").distinct().withColumn("_file", F.lit(True))
    rows = history.join(latest, [*by, "script"], "left").join(undos, [*by, "version"], "left").join(undo, [*by, "version"], "left")
    hidden = (F.col("type") == "REPEATABLE") & F.col("_known").isNotNull() & (F.coalesce("checksum", F.lit(0)) != 0) & ~F.coalesce(F.col("checksum") == F.col("_latest"), F.lit(False))
    undone = F.col("type").isin(*VERSIONED) & F.coalesce(F.col("_undo") > F.col("installed_rank"), F.lit(False))
    if need_undone:
        undone &= F.coalesce("_gone", F.lit(False))
    state = (
        F.when(F.col("type").isin("DELETE", "MISSING"), "Deleted")
        .when(_ok(), F.when(F.col("type") == "BASELINE", "Baseline").when(undone, "Undone").otherwise("Success"))
        .when(F.col("success") == F.lit(False), "Failed")
        .otherwise("Unknown")
    )
    undoable = F.col("_file").isNotNull().alias("undoable")
    shown = rows.where(~hidden).select(*by, category(F.col("type"), F.col("description")).alias("category"), _shown_version(F.col("version")).alias("version"), clean_description(F.col("description")).alias("description"), "type", state.alias("state"), undoable, "script", F.coalesce("execution_time", F.lit(0)).alias("execution_time"), "installed_rank", "checksum", F.lit(None).cast("long").alias("place"))
    new = pending(history, scripts, target, by, known).where("reason <> 'below'").select(*by, "script_id")
    files = resolved_scripts(scripts, by).join(new, [*by, "script_id"], "left_semi").join(undo, [*by, "version"], "left")
    files = numbered_within(files, by, (~F.col("kind").isin(*VERSIONED)).cast("int"), or_empty(F.col("version")), "name", "script_id")
    waiting = files.select(*by, category(F.col("kind"), F.lit("")).alias("category"), _shown_version(F.col("version")).alias("version"), "description", F.col("kind").alias("type"), F.lit("Pending").alias("state"), undoable, F.col("name").alias("script"), F.lit(0).alias("execution_time"), F.lit(None).cast("long").alias("installed_rank"), F.lit(None).cast("int").alias("checksum"), "place")
    return shown.unionByName(waiting)


def snapshot(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One row for each database: current version, and counts of the states and of pending scripts."""
    scripts = resolved_scripts(scripts, by)
    known = facts(history, by)
    states = history_states(history, scripts, by, known).groupBy(*by).agg(F.count(F.lit(1)).alias("applied"), F.count_if(F.col("state").startswith("Failed") | (F.col("state") == "Needs repair")).alias("failed"), F.count_if(F.col("state") == "Undone").alias("undone"), F.count_if(F.col("state") == "Deleted").alias("deleted"))
    waiting = pending(history, scripts, by=by, known=known).where("reason <> 'below'").groupBy(*by).agg(F.count(F.lit(1)).alias("pending"))
    drifted = drifted_repeatables(history, scripts, by, known).groupBy(*by).agg(F.count(F.lit(1)).alias("drifted"))
    out = states.join(known.databases.select(*by, "current_version"), list(by), "left").join(waiting, list(by), "left").join(drifted, list(by), "left")
    return out.select(*by, "current_version", "applied", "failed", "undone", "deleted", F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), F.coalesce("drifted", F.lit(0)).cast("long").alias("drifted"))


def drifted_repeatables(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY, known: Facts | None = None) -> DataFrame:
    """Repeatable scripts whose last successful checksum differs from the file's. A stored 0 counts as unknown."""
    last = known.scripts.select(*by, "script", F.col("last_ok.checksum").alias("checksum")) if known else repeatable_checksums(history, True, by)
    last = last.where("checksum <> 0")
    files = resolved_scripts(scripts, by).where("kind = 'REPEATABLE'")
    return files.join(last.withColumnRenamed("script", "name"), [*by, "name"]).where("checksum <> file_checksum").select(*by, "script_id", "name", F.col("checksum").alias("previous"), F.col("file_checksum").alias("current"))


def drifted_scripts(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """For each applied SQL script whose file differs, the first row that says so."""
    rows = history.where((F.col("type") == "SQL") & F.col("checksum").isNotNull())
    files = resolved_scripts(scripts, by).select(*by, F.col("name").alias("script"), "file_checksum")
    found = rows.join(files, [*by, "script"]).where("checksum <> file_checksum")
    return found.groupBy(*by, "script", "file_checksum").agg(F.min("installed_rank").alias("installed_rank"))


def last_successes(history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The last successful row of each script, audit rows aside."""
    rows = history.where(_ok() & ~F.col("type").isin("DELETE", "UNDO_SQL"))
    last = rows.groupBy(*by, "script").agg(F.max_by(F.struct("installed_rank", "checksum"), "installed_rank").alias("last"))
    return last.select(*by, "script", "last.*")


def changed_scripts(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Whether each script differs from its last success; unknown counts as changed."""
    files = resolved_scripts(scripts, by).select(*by, "script_id", F.col("name").alias("script"), "file_checksum")
    changed = ~F.coalesce(F.col("checksum") == F.col("file_checksum"), F.lit(False))
    return files.join(last_successes(history, by), [*by, "script"], "left").select(*by, "script_id", "script", changed.alias("changed"))


def checksum_issues(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Last successes without a file (with how many files share the version), and changed ones that aren't repeatable."""
    files = resolved_scripts(scripts, by)
    last = last_successes(history, by).join(history.select(*by, "installed_rank", "type", "version"), [*by, "installed_rank"])
    own = files.select(*by, F.col("name").alias("script"), "file_checksum")
    others = files.where("version IS NOT NULL").groupBy(*by, "version").agg(F.count(F.lit(1)).alias("_others"))
    joined = last.join(own, [*by, "script"], "left").join(others, [*by, "version"], "left")
    issue = F.when(F.col("file_checksum").isNull(), "missing").when((F.col("type") != "REPEATABLE") & F.col("checksum").isNotNull() & (F.col("checksum") != F.col("file_checksum")), "changed")
    return joined.withColumn("issue", issue).where("issue IS NOT NULL").select(*by, "script", "installed_rank", "issue", F.coalesce("_others", F.lit(0)).cast("long").alias("same_version"))


def repeatables_to_rerun(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Latest row of each repeatable against its file: failed and unchanged is an error, failed and changed or drifted is run again."""
    rows = history.where("type = 'REPEATABLE'").groupBy(*by, "script").agg(F.max_by(F.struct("success", "checksum"), "installed_rank").alias("last"))
    files = resolved_scripts(scripts, by).where("kind = 'REPEATABLE'").select(*by, "script_id", F.col("name").alias("script"), "file_checksum")
    differs = ~F.coalesce(F.col("last.checksum") == F.col("file_checksum"), F.lit(False))
    bad = F.col("last.success") == F.lit(False)
    verdict = F.when(bad & ~differs, "error").when(differs, "modified")
    return rows.join(files, [*by, "script"]).withColumn("verdict", verdict).where("verdict IS NOT NULL").select(*by, "script_id", "script", "verdict")


def not_imported(foreign: DataFrame, history: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Foreign rows whose version and script are both new; null and empty ones match nothing."""
    versions = history.where(or_empty(F.col("version")) != "").select(*by, "version").distinct()
    names = history.where(or_empty(F.col("script")) != "").select(*by, "script").distinct()
    return foreign.join(versions, [*by, "version"], "left_anti").join(names, [*by, "script"], "left_anti")


def applied_without_file(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    rows = history.where(_ok() & ~F.col("type").isin("DELETE", "BASELINE", "UNDO_SQL"))
    files = scripts.select(*by, base_name(F.col("name")).alias("script"))
    return rows.join(files, [*by, "script"], "left_anti").select(*by, "installed_rank", "script")


def reappeared(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Deleted scripts that are there again, with the first deletion."""
    gone = history.where("type = 'DELETE'").groupBy(*by, "script").agg(F.min("installed_rank").alias("deleted_at"))
    return gone.join(scripts.select(*by, base_name(F.col("name")).alias("script")).distinct(), [*by, "script"])


def duplicate_versions(scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Later scripts of a version that an earlier one (by id) has; versions compare as text."""
    rows = resolved_scripts(scripts, by).where(F.col("kind").isin(*VERSIONED) & F.col("version").isNotNull())
    first = rows.groupBy(*by, "version").agg(F.min_by("name", "script_id").alias("first"), F.min("script_id").alias("_first_id"))
    return rows.join(first, [*by, "version"]).where("script_id > _first_id").select(*by, "version", "first", F.col("name").alias("later"), "script_id")


def repair_plan(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """What repair would do: align checksums, mark missing scripts deleted, remove failed rows."""
    scripts = resolved_scripts(scripts, by)
    columns = [*by, "script", "installed_rank", "repair_type"]
    checksums = drifted_scripts(history, scripts, by).withColumn("repair_type", F.lit("CHECKSUM_MISMATCH")).select(*columns)
    deleted = history.where("type = 'DELETE'").select(*by, "script").distinct()
    missing = applied_without_file(history, scripts, by).join(deleted, [*by, "script"], "left_anti").withColumn("repair_type", F.lit("MISSING_SCRIPT")).select(*columns)
    broken = history.where(F.col("success") == F.lit(False)).withColumn("repair_type", F.lit("FAILED_MIGRATION")).select(*columns)
    return checksums.unionByName(missing).unionByName(broken)


def strict_violations(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Applied scripts without a file, and new scripts strictly below the highest applied version."""
    scripts = resolved_scripts(scripts, by)
    missing = applied_without_file(history, scripts, by).select(*by, "script", F.lit("missing").alias("rule")).distinct()
    ran = history.where(F.col("type").isin(*VERSIONED)).select(*by, "version").distinct()
    new = resolved_scripts(scripts, by).where(F.col("kind").isin(*VERSIONED) & F.col("version").isNotNull()).join(ran, [*by, "version"], "left_anti").join(highest_applied(history, by), list(by))
    late = new.where(version_order(F.col("version")) < version_order(F.col("highest"))).select(*by, F.col("name").alias("script"), F.lit("below_highest").alias("rule"))
    return missing.unionByName(late)


def failed_issues(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Failed rows, without failed repeatables that will run again because their script has changed."""
    scripts = resolved_scripts(scripts, by)
    again = repeatables_to_rerun(history, scripts, by).where("verdict = 'modified'").select(*by, "script").distinct()
    rows = history.where(F.col("success") == F.lit(False))
    return rows.where("type <> 'REPEATABLE'").unionByName(rows.where("type = 'REPEATABLE'").join(again, [*by, "script"], "left_anti").select(*rows.columns)).select(*by, "installed_rank", "script", "type")


def repaired(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The history after repair: failed rows gone, checksums aligned with files, and a DELETE row for each missing script.

    All columns of the history are kept.  A DELETE row has the version of the script's last row and
    its description behind ``[DELETE:TYPE]``, and is ranked behind all others by script.
    """
    scripts = resolved_scripts(scripts, by)
    plan = stored(repair_plan(history, scripts, by))
    files = scripts.select(*by, F.col("name").alias("script"), "file_checksum")
    aligned = plan.where("repair_type = 'CHECKSUM_MISMATCH'").select(*by, "script").distinct().join(files, [*by, "script"])
    aligned = aligned.groupBy(*by, "script").agg(F.min("file_checksum").alias("_new"))
    kept = history.where(~F.coalesce(F.col("success") == F.lit(False), F.lit(False))).join(aligned, [*by, "script"], "left")
    kept = kept.withColumn("checksum", F.when((F.col("type") == "SQL") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("checksum"))).select(*history.columns)
    top = history.groupBy(*by).agg(F.max("installed_rank").alias("_top"))
    last = history.groupBy(*by, "script").agg(F.max_by(F.struct("version", "description", "type"), "installed_rank").alias("_last"))
    gone = numbered_within(plan.where("repair_type = 'MISSING_SCRIPT'").select(*by, "script").distinct(), by, "script").join(top, list(by)).join(last, [*by, "script"])
    values = {"installed_rank": F.col("_top") + F.col("place"), "type": F.lit("DELETE"), "version": F.col("_last.version"), "description": F.concat(F.lit("[DELETE:"), "_last.type", F.lit("] "), "_last.description"), "success": F.lit(True), "execution_time": F.lit(0)}
    values |= {c: F.col(c) for c in (*by, "script")}
    gone = gone.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in history.schema])
    return kept.unionByName(gone)


def apply_repair(path: str, scripts: DataFrame, by: Sequence[str] = BY) -> None:
    """Repair the histories that :func:`tidemark.sources.tables.write_history` wrote: only databases that need it are written anew."""
    history = scripts.sparkSession.read.parquet(path)
    scripts = resolved_scripts(scripts, by)
    touched = stored(repair_plan(history, scripts, by).select(*by).distinct())
    mine = lambda df: df.join(touched, list(by), "left_semi")
    overwrite_touched(repaired(mine(history), mine(scripts), by), touched, path, by)


def empty_folder_gate(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Databases without any script whose history would be reported missing: repair must refuse there."""
    from .history import candidates_for_missing

    return candidates_for_missing(history, by).join(scripts.select(*by).distinct(), list(by), "left_anti")


def validation_issues(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """All issues with the order of their check: duplicates, failures, checksums, missing files."""
    scripts = resolved_scripts(scripts, by)

    def of(order: int, df: DataFrame) -> DataFrame:
        return df.select(*by, F.lit(order).cast("long").alias("check_order"), F.col("script"))

    return (
        of(1, duplicate_versions(scripts, by).withColumnRenamed("later", "script"))
        .unionByName(of(2, failed_issues(history, scripts, by)))
        .unionByName(of(3, checksum_issues(history, scripts, by).where("issue = 'changed'")))
        .unionByName(of(4, checksum_issues(history, scripts, by).where("issue = 'missing'")))
    )


def first_failing_check(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The first check that finds something in each database, and how many issues it finds."""
    counts = validation_issues(history, scripts, by).groupBy(*by, "check_order").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by(F.struct("check_order", "n"), "check_order").alias("first")).select(*by, "first.*")


#: Checks of a validation run in their order; what a check finds ends the run, but for the last ones, which are looked at together.
CHECKS = ("no scripts", "only repeatables", "duplicate versions", "callbacks in history", "strict rules", "issues")


def validation_run(history: DataFrame, scripts: DataFrame, strict: bool = False, by: Sequence[str] = BY) -> DataFrame:
    """How validation of each database ends: ``success``, the check that ended it (null if all passed), and how many issues it found.

    Without usable scripts it succeeds, unless rules are ``strict`` and something was applied;
    with repeatables and callbacks alone it succeeds.  Then come versions of two scripts, callbacks in the
    history, strict rules, and at last failed rows, changed checksums and deleted scripts that are
    there again; applied scripts without a file are issues only where rules are strict.
    """
    scripts = resolved_scripts(scripts, by)
    known = scripts.where(F.col("kind").isin(*VERSIONED, "REPEATABLE", "CALLBACK", "BASELINE", "UNDO_SQL"))
    usable = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_usable"), F.count_if(~F.col("kind").isin("REPEATABLE", "CALLBACK")).alias("_others"))
    applied = history.groupBy(*by).agg(F.count(F.lit(1)).alias("_applied"), F.count_if(F.col("type") == "CALLBACK").alias("_callbacks"))
    issues = checksum_issues(history, scripts, by)
    counted = lambda name, df: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = usable.join(applied, list(by), "full")
    parts = {"_duplicates": duplicate_versions(scripts, by), "_strict": strict_violations(history, scripts, by), "_failed": failed_issues(history, scripts, by), "_changed": issues.where("issue = 'changed'"), "_missing": issues.where("issue = 'missing'"), "_again": reappeared(history, scripts, by)}
    for name, df in parts.items():
        out = out.join(counted(name, df), list(by), "left")
    n = lambda name: F.coalesce(name, F.lit(0))
    late = n("_failed") + n("_changed") + n("_again") + (n("_missing") if strict else F.lit(0))
    no_scripts = n("_usable") == 0
    found = (
        F.when(no_scripts, F.when(F.lit(strict) & (n("_applied") > 0), n("_applied")).otherwise(0))
        .when(n("_others") == 0, 0)
        .when(n("_duplicates") > 0, n("_duplicates"))
        .when(n("_callbacks") > 0, n("_callbacks"))
        .when(F.lit(strict) & (n("_strict") > 0), n("_strict"))
        .otherwise(late)
    ).cast("long")
    ended = F.when(no_scripts, CHECKS[0]).when(n("_others") == 0, CHECKS[1]).when(n("_duplicates") > 0, CHECKS[2]).when(n("_callbacks") > 0, CHECKS[3]).when(F.lit(strict) & (n("_strict") > 0), CHECKS[4]).when(late > 0, CHECKS[5])
    return out.select(*by, (found == 0).alias("success"), ended.alias("ended_by"), found.alias("n"))


def compatibility(foreign: DataFrame, own: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Whether two histories of a database say the same, and the first difference: ``compatible, position, difference``.

    Different numbers of rows differ at no position.  Else rows are compared place by place: version, types that both
    know (SQL, BASELINE and UNDO_SQL, case aside), script, checksum (0 and null are equal).
    """
    # Types that both sides know.
    both_know = ("SQL", "BASELINE", "UNDO_SQL")
    place = lambda df: numbered_within(df.select(*by, "installed_rank", "version", F.upper("type").alias("type"), "script", F.nullif("checksum", F.lit(0)).alias("checksum")), by, "installed_rank", "script", name="position")
    a, b = place(foreign), place(own).select(*by, "position", *[F.col(c).alias(f"_{c}") for c in ("version", "type", "script", "checksum")])
    known = lambda c: F.coalesce(F.col(c).isin(*both_know), F.lit(False))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    difference = F.when(~same("version"), "version").when(~known("type"), "foreign type").when(~known("_type"), "type").when(~same("script"), "script").when(~same("checksum"), "checksum")
    first = a.join(b, [*by, "position"]).withColumn("d", difference).where("d IS NOT NULL").groupBy(*by).agg(F.min_by(F.struct("position", F.col("d").alias("difference")), "position").alias("f"))
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    sizes = count(foreign, "_a").join(count(own, "_b"), list(by))
    uneven = F.col("_a") != F.col("_b")
    return sizes.join(first, list(by), "left").select(*by, (~uneven & F.col("f").isNull()).alias("compatible"), F.when(~uneven, F.col("f.position")).alias("position"), F.when(uneven, "count").otherwise(F.col("f.difference")).alias("difference"))


def may_take_baseline(history: DataFrame, databases: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Databases whose history is empty."""
    return databases.select(*by).distinct().join(history.select(*by).distinct(), list(by), "left_anti")


def marked_as_executed(history: DataFrame, scripts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Rows to append for pending versioned scripts that are recorded without being run, ranked by version."""
    scripts = resolved_scripts(scripts, by)
    new = pending(history, scripts, by=by).where("kind <> 'REPEATABLE' AND reason <> 'below'")
    top = history.groupBy(*by).agg(F.max("installed_rank").alias("_top"))
    new = numbered_within(new.withColumn("_version", version_order(F.col("version"))), by, "_version", "name", "script_id")
    return new.join(top, list(by), "left").select(*by, (F.coalesce("_top", F.lit(0)) + F.col("place")).alias("installed_rank"), "version", F.col("kind").alias("type"), F.col("name").alias("script"))
