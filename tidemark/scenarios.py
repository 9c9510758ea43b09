"""Registered queries: each applies one operator to a whole relation, beside the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checksums, display, scripts, sqltext, textdiff, types, versions
from .operators import catalog, graph, history, journal, state, undo
from .operators.contraction import strong_components
from .oracle import category, crc, key, numbers, type_case, with_views
from .plans import info
from .relations import relation
from .sources.tables import append_history, coerced_history, decoded, encoding, new_path, queried, read_history, read_scripts, write_history, written_scripts

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, relations: str, build: Callable[..., DataFrame], oracle: str | None = None) -> None:
    """Register ``build`` on named relations, and the DuckDB text that gives the same rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[relation(spark, sf_dir, r) for r in relations.split()])

    _found[name] = (run, with_views(oracle) if oracle else None)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return info.overview(relation(spark, sf_dir, "history"), relation(spark, sf_dir, "scripts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


_KEY = key("version")
_TEXT_KEY = f"array_to_string(list_transform({_KEY}, lambda e: e.k::VARCHAR || '/' || e.n::VARCHAR || '/' || e.t), ' ')"
_V = "coalesce(version, '') <> ''"

# Versions
query("v1_version_key", "history", lambda h: h.select("version").distinct().where("version IS NOT NULL").select("version", F.array_join(F.transform(versions.version_key(F.col("version")), lambda e: F.concat_ws("/", e["k"].cast("string"), e["n"].cast("string"), e["t"])), " ").alias("version_key")), f"SELECT DISTINCT version, {_TEXT_KEY} AS version_key FROM history WHERE version IS NOT NULL")
query("v2_compare_versions", "history", lambda h: h.select("db", "installed_rank", versions.compare_versions(F.col("version"), F.lit("12_0.0")).alias("cmp")), f"SELECT db, installed_rank, CASE WHEN {key('v')} < {key("'12'")} THEN -1 WHEN {key('v')} > {key("'12'")} THEN 1 ELSE 0 END AS cmp FROM (SELECT *, coalesce(version, '') AS v FROM history)")
query("v3_current_version", "history", history.current_version, "SELECT db, current_version FROM current")
query("v3b_current_and_baseline", "history", history.current_and_baseline, f"SELECT db, max_by(version, {{'k': {_KEY}, 'r': -installed_rank}}) FILTER (type IN ('SQL', 'PYTHON')) AS current_version, max_by(version, installed_rank) FILTER (type = 'BASELINE') AS baseline_version FROM history WHERE success AND {_V} GROUP BY db")
query("v4_first_baseline", "history", history.first_baseline, "SELECT db, baseline_version FROM baseline")
query("v5_scripts_above_baseline", "scripts", lambda s: (lambda r: r.where("kind = 'SQL' AND name LIKE '%.py'").unionByName(r.where("kind = 'SQL' AND name NOT LIKE '%.py' AND version IS NOT NULL").join(r.where("kind = 'BASELINE'").groupBy("db").agg(F.max(versions.pep440_order(F.replace(F.regexp_extract("name", "^B([^_].*?)__", 1), F.lit("_"), F.lit(".")))).alias("_b")), "db", "left").where(versions.pep440_order(F.col("version")) > F.col("_b")).drop("_b")).select("db", "script_id", "kind"))(state.resolved_scripts(s)), f"SELECT db, script_id, kind FROM resolved WHERE kind = 'SQL' AND name LIKE '%.py' UNION ALL SELECT r.db, script_id, kind FROM resolved r JOIN (SELECT db, max({key('bv')}) AS b FROM (SELECT db, regexp_extract(name, '^B([^_].*?)__', 1) AS bv FROM resolved WHERE kind = 'BASELINE') GROUP BY db) x ON x.db = r.db WHERE kind = 'SQL' AND name NOT LIKE '%.py' AND version IS NOT NULL AND {_KEY} > b")
# Suffixes with what they stand for: (pre-release, its number), post-release, development release, local part; -1 is before, 9 behind all others.
_SUFFIXES = (("", 9, 0, -1, 999, ""), ("a1", 1, 1, -1, 999, ""), (".beta", 2, 0, -1, 999, ""), ("-RC.2", 3, 2, -1, 999, ""), (".post1", 9, 0, 1, 999, ""), ("-3", 9, 0, 3, 999, ""), (".dev4", -1, 0, -1, 4, ""), ("c1.rev2.dev3", 3, 1, 2, 3, ""), (".post2.dev1", 9, 0, 2, 1, ""), (".0", 9, 0, -1, 999, ""), ("+abc", 9, 0, -1, 999, "abc"), ("+7", 9, 0, -1, 999, "~7"), ("!x", None, 0, 0, 0, ""))
_PEP = "[" + ", ".join("{'s': '%s', 'p': %s, 'pn': %d, 'o': %d, 'd': %d, 'l': '%s'}" % (x[0], "NULL" if x[1] is None else x[1], *x[2:]) for x in _SUFFIXES) + "]"
query("v5_pep440_order", "history", lambda h: h.where("version IS NOT NULL").select(F.concat("version", F.element_at(F.array(*[F.lit(x[0]) for x in _SUFFIXES]), (F.col("installed_rank") % 13 + 1).cast("int"))).alias("version")).distinct().select("version", F.when(versions.pep440_order(F.col("version")) < versions.pep440_order(F.lit("12.1rc2")), -1).when(versions.pep440_order(F.col("version")) > versions.pep440_order(F.lit("12.1rc2")), 1).when(versions.pep440_order(F.col("version")).isNotNull(), 0).alias("cmp")), f"SELECT DISTINCT version || x.s AS version, CASE WHEN x.p IS NULL THEN NULL WHEN k < c THEN -1 WHEN k > c THEN 1 ELSE 0 END AS cmp FROM (SELECT *, [split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT, x.p, x.pn, x.o, x.d] AS k, [12, 1, 3, 2, -1, 999] AS c FROM (SELECT version, {_PEP}[installed_rank % 13 + 1] AS x FROM history WHERE version IS NOT NULL))")
query("v6_out_of_order_adjacent", "history", history.out_of_order_adjacent, f"SELECT db, installed_rank, version, script FROM (SELECT *, lag(p) OVER (PARTITION BY db ORDER BY installed_rank) AS b FROM (SELECT *, {numbers('version')} AS p FROM history WHERE type IN ('SQL', 'PYTHON') AND {_V})) WHERE p < b")
query("v6b_out_of_order_scripts", "history", history.out_of_order_scripts, f"SELECT db, installed_rank, script FROM (SELECT *, lag(p) OVER (PARTITION BY db ORDER BY installed_rank) AS b FROM (SELECT *, {_KEY} AS p FROM history WHERE success AND type IN ('SQL', 'PYTHON') AND {_V})) WHERE p < b")
query("v7_out_of_order_global", "history", history.out_of_order_global, f"SELECT db, installed_rank, version FROM (SELECT *, max(p) OVER (PARTITION BY db ORDER BY installed_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT *, {_KEY} AS p FROM history WHERE success AND type IN ('SQL', 'PYTHON') AND {_V})) WHERE b > p")
query("v8_highest_applied", "history", history.highest_applied, f"SELECT db, max_by(version, {{'k': {_KEY}, 'r': -installed_rank}}) AS highest FROM history WHERE success AND type IN ('SQL', 'PYTHON') AND {_V} GROUP BY db")
query("v9_product_version", "history", lambda h: h.where("version IS NOT NULL").select("version").distinct().select("version", versions.product_at_least(F.col("version"), F.lit("9.4+")).alias("at_least")), "SELECT DISTINCT version, {'a': split_part(version, '.', 1)::INT, 'b': split_part(version, '.', 2)::INT} >= {'a': 9, 'b': 4} AS at_least FROM history WHERE version IS NOT NULL")

# Sources
query("s2_ordered_scripts", "scripts", state.ordered_scripts, f"SELECT db, script_id, grp AS \"group\", row_number() OVER (PARTITION BY db, grp ORDER BY k NULLS FIRST, lower(name), script_id) AS place FROM (SELECT *, CASE WHEN kind IN ('SQL', 'PYTHON') THEN 'versioned' ELSE lower(kind) END AS grp, CASE WHEN kind IN ('SQL', 'PYTHON') THEN {key("coalesce(version, '')")} END AS k FROM resolved)")
query("s3_parsed_names", "scripts", lambda s: s.withColumn("p", scripts.parsed_name(F.col("name"))).select("script_id", F.col("p.kind").alias("kind"), F.col("p.version").alias("version"), F.col("p.description").alias("description")), "SELECT script_id, named_kind AS kind, version, description FROM resolved")
query("s3b_quick_kind", "scripts", lambda s: s.select("script_id", scripts.quick_kind(F.col("name")).alias("kind")), "SELECT script_id, kind FROM resolved")
query("s4_tags", "scripts", lambda s: s.select("script_id", F.explode(scripts.tags(F.col("name"))).alias("tag")), "SELECT script_id, unnest(tags) AS tag FROM resolved")
query("s5_formats", "scripts", lambda s: s.groupBy(scripts.script_format(F.col("name")).alias("format")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE lower(regexp_extract(name, '\\.([^.]*)$', 1)) WHEN 'sql' THEN 'SQL' WHEN 'py' THEN 'PYTHON' WHEN 'json' THEN 'JSON' ELSE 'UNKNOWN' END AS format, count(*) AS n FROM scripts GROUP BY 1")
_HEADS = ("", "CREATE (n)-[:x]->(m) ", "alter table t ", "import os; ", "function f() {} ", '{"a": ', "key-1: value ", "nothing  ")
query("s5_formats_by_content", "scripts", lambda s: s.withColumn("c", F.concat(F.element_at(F.array(*[F.lit(x) for x in _HEADS]), (F.col("script_id") % 8 + 1).cast("int")), F.lower(F.replace("content", F.lit(":"), F.lit("."))))).groupBy(scripts.format_of(F.when(F.col("script_id") % 3 == 0, F.col("name")).otherwise("notes.txt"), F.when(F.col("script_id") % 8 != 0, F.col("c"))).alias("format")).agg(F.count(F.lit(1)).alias("n")), r"""SELECT CASE WHEN script_id % 3 = 0 AND name LIKE '%.sql' THEN 'SQL' WHEN script_id % 3 = 0 AND name LIKE '%.py' THEN 'PYTHON' WHEN k = 0 THEN 'UNKNOWN' WHEN k = 1 OR regexp_matches(upper(substr(h, 1, 200)), 'CREATE \(|MATCH \(|MERGE \(|RETURN') THEN 'CYPHER'
  WHEN k = 2 THEN 'SQL' WHEN k = 3 OR contains(substr(h, 1, 100), 'import ') THEN 'PYTHON' WHEN k = 4 OR contains(substr(h, 1, 100), 'var ') THEN 'JAVASCRIPT' WHEN k = 5 THEN 'JSON' WHEN k = 6 THEN 'YAML' ELSE 'UNKNOWN' END AS format, count(*) AS n
FROM (SELECT *, script_id % 8 AS k, ['', 'CREATE (n)-[:x]->(m) ', 'alter table t ', 'import os; ', 'function f() {} ', '{"a": ', 'key-1: value ', 'nothing  '][script_id % 8 + 1] || lower(replace(content, ':', '.')) AS h FROM scripts) GROUP BY 1""")
query("s7_callbacks", "scripts", lambda s: s.where(scripts.is_callback_for(F.col("name"), "beforeEach")).select("script_id", "name"), "SELECT script_id, name FROM scripts WHERE lower(name) LIKE 'beforeeach%'")
query("s9_query", "history", lambda h: queried("SELECT type, success, count(*) AS n, max(installed_rank) AS last_rank FROM {history} GROUP BY type, success", history=h), "SELECT type, success, count(*) AS n, max(installed_rank) AS last_rank FROM history GROUP BY ALL")
query("s8_history_scan", "history", lambda h: h.select("installed_rank", "version", "description", "type", "script", "checksum", "installed_by", "installed_on", "execution_time", "success").orderBy("installed_rank"), "SELECT installed_rank, version, description, type, script, checksum, installed_by, installed_on, execution_time, success FROM history ORDER BY installed_rank")

# Checksums
query("c1_script_checksum", "scripts", lambda s: s.select("script_id", checksums.script_checksum(F.col("content")).alias("checksum")), f"SELECT script_id, {crc('content', 'tb')}::INT AS checksum FROM scripts, crc_table")
query("c2_stored_checksum", "history", lambda h: h.select("installed_rank", checksums.stored_checksum((F.col("installed_rank") * 1_000_003 % 6_000_000_000 - 1_000_000_000).cast("string")).alias("checksum")), "SELECT installed_rank, (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END)::INT AS checksum FROM (SELECT installed_rank, (installed_rank * 1000003 % 6000000000 - 1000000000) & 4294967295 AS u FROM history)")
query("c3_drifted_repeatables", "history scripts", state.drifted_repeatables, "SELECT db, script_id, name, previous, current FROM drifted")
query("c4_drifted_scripts", "history scripts", state.drifted_scripts, "SELECT db, script, file_checksum, installed_rank FROM drifted_sql")
query("c5_last_successes", "history", state.last_successes, "SELECT db, script, installed_rank, checksum FROM last_success")
query("c6_changed_scripts", "history scripts", state.changed_scripts, "SELECT c.db, c.script_id, c.name AS script, NOT coalesce(l.checksum = c.file_checksum, false) AS changed FROM checked c LEFT JOIN last_success l ON l.db = c.db AND l.script = c.name")
query("c7_checksum_issues", "history scripts", state.checksum_issues, "SELECT l.db, l.script, l.installed_rank, CASE WHEN c.script_id IS NULL THEN 'missing' ELSE 'changed' END AS issue, coalesce(o.n, 0) AS same_version FROM last_success l JOIN history h ON h.db = l.db AND h.installed_rank = l.installed_rank LEFT JOIN checked c ON c.db = l.db AND c.name = l.script LEFT JOIN (SELECT db, version, count(*) AS n FROM resolved WHERE version IS NOT NULL GROUP BY ALL) o ON o.db = l.db AND o.version = h.version WHERE c.script_id IS NULL OR (h.type <> 'REPEATABLE' AND l.checksum IS NOT NULL AND l.checksum <> c.file_checksum)")
query("c8_repeatables_to_rerun", "history scripts", state.repeatables_to_rerun, "SELECT db, script_id, script, verdict FROM rerun")

# History states
query("h1_success", "history", lambda h: h.groupBy("db").agg(F.count_if(history.succeeded(F.col("success"))).alias("ok"), F.count_if(history.failed(F.col("success"))).alias("failed"), F.count_if(F.col("success").isNull()).alias("unknown")), "SELECT db, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success IS NULL) AS unknown FROM history GROUP BY db")
query("h2_undone_versions", "history", history.undone_versions, "SELECT DISTINCT db, version FROM history WHERE success AND type = 'UNDO_SQL'")
query("h3_reapplied_first_undo", "history", history.reapplied_after_first_undo, "SELECT db, version FROM ranks WHERE last_ok IS NOT NULL AND last_any > first_undo")
query("h3b_reapplied_last_undo", "history", history.reapplied_after_last_undo, "SELECT db, version FROM ranks WHERE last_ok > last_undo")
query("h3d_applied_more_than_once", "history", history.applied_more_than_once, "SELECT db, version, n_ok FROM ranks WHERE n_ok > 1")
query("h4_effectively_undone", "history", history.effectively_undone, "SELECT db, version, last_undo FROM undone")
query("h5_analysis", "history", history.analysis, "SELECT db, count(DISTINCT version) FILTER (type IN ('SQL', 'PYTHON', 'BASELINE')) AS executed_versions, count(DISTINCT script) FILTER (type NOT IN ('DELETE', 'UNDO_SQL')) AS executed_scripts, count(DISTINCT script) FILTER (type = 'DELETE') AS deleted_scripts, count(*) FILTER (NOT success) AS failed_rows, count(*) FILTER (success IS NULL) AS needs_repair FROM history GROUP BY db")
query("h5_analysis_sets", "history", history.analysis_sets, """WITH gone AS (SELECT DISTINCT u.db, u.version FROM history u WHERE success AND type = 'UNDO_SQL' AND version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ranks r WHERE r.db = u.db AND r.version = u.version AND last_ok IS NOT NULL AND last_any > first_undo)),
done AS (SELECT db, version, max_by(script, installed_rank) AS script FROM history WHERE success AND type IN ('SQL', 'PYTHON') AND version <> '' GROUP BY db, version), kept AS (SELECT * FROM done ANTI JOIN gone USING (db, version)), bad AS (SELECT * FROM history WHERE NOT success AND type <> 'DELETE')
SELECT DISTINCT * FROM (SELECT db, 'executed_versions' AS output, version AS item, NULL::BIGINT AS value FROM kept UNION ALL SELECT db, 'executed_versions', version, NULL FROM bad UNION ALL SELECT db, 'executed_scripts', script, NULL FROM kept UNION ALL SELECT db, 'executed_scripts', script, NULL FROM history WHERE success AND type IN ('REPEATABLE', 'CALLBACK')
UNION ALL SELECT db, 'executed_scripts', script, NULL FROM bad UNION ALL SELECT db, 'deleted_scripts', script, NULL FROM history WHERE type = 'DELETE' UNION ALL SELECT db, 'failed_rows', script, installed_rank FROM bad UNION ALL SELECT db, 'repeatable_checksums', script, checksum FROM repeatable WHERE checksum <> 0
UNION ALL SELECT db, 'undone_versions', version, NULL FROM history WHERE success AND type = 'UNDO_SQL' UNION ALL SELECT db, 'reapplied_versions', version, NULL FROM ranks WHERE last_ok IS NOT NULL AND last_any > first_undo) WHERE item <> ''""")
query("h6_repeatable_checksums", "history", history.repeatable_checksums, "SELECT db, script, checksum FROM repeatable")
query("h6_repeatable_checksums_all_rows", "history", lambda h: history.repeatable_checksums(h, False), "SELECT db, script, max_by({'c': checksum}, installed_rank).c AS checksum FROM history WHERE type = 'REPEATABLE' GROUP BY db, script")
query("h7_pending", "history scripts", state.pending, "SELECT db, script_id, name, kind, version, reason FROM pending WHERE reason IS NOT NULL")
query("h8_versioned_pending", "history scripts", lambda h, s: state.pending(h, s).where("kind <> 'REPEATABLE'").groupBy("db", "reason").agg(F.count(F.lit(1)).alias("n")), "SELECT db, reason, count(*) AS n FROM pending WHERE reason IS NOT NULL AND kind <> 'REPEATABLE' GROUP BY ALL")
query("h9_repeatable_pending", "history scripts", lambda h, s: state.pending(h, s).where("kind = 'REPEATABLE'").select("db", "script_id", "reason"), "SELECT db, script_id, reason FROM pending WHERE reason IS NOT NULL AND kind = 'REPEATABLE'")
query("h10_resolved_flag", "history scripts", lambda h, s: h.join(state.pending(h, s).where("reason <> 'below'").select("db", F.col("name").alias("script")).distinct().withColumn("_p", F.lit(True)), ["db", "script"], "left").select("db", "installed_rank", F.col("_p").isNotNull().alias("resolved")), "SELECT h.db, h.installed_rank, p.name IS NOT NULL AS resolved FROM history h LEFT JOIN (SELECT DISTINCT db, name FROM pending WHERE reason IS NOT NULL AND reason <> 'below') p ON p.db = h.db AND p.name = h.script")
query("h11_history_states", "history scripts", state.history_states, "SELECT db, installed_rank, version, type, script, state FROM states")
query("h12_pending_states", "history scripts", lambda h, s: state.pending_states(h, s, "30"), f"SELECT r.db, script_id, kind, r.version, CASE WHEN kind = 'REPEATABLE' THEN 'Pending' WHEN kind = 'UNDO_SQL' THEN 'Available' WHEN coalesce(k <= {key('baseline_version')}, false) THEN 'Below Baseline' WHEN k > {key("'30'")} THEN 'Above Target' WHEN u.version IS NOT NULL THEN 'Available' ELSE 'Pending' END AS state FROM (SELECT *, {key("coalesce(version, '')")} AS k FROM resolved) r LEFT JOIN (SELECT DISTINCT db, version FROM resolved WHERE kind = 'UNDO_SQL') u ON u.db = r.db AND u.version = r.version LEFT JOIN baseline b ON b.db = r.db WHERE kind IN ('SQL', 'PYTHON', 'REPEATABLE', 'UNDO_SQL')")
query("h13_failed_states", "history scripts", lambda h, s: state.history_states(h, s).where("state LIKE 'Failed%' OR state = 'Needs repair'").select("db", "installed_rank", "state"), "SELECT db, installed_rank, state FROM states WHERE state LIKE 'Failed%' OR state = 'Needs repair'")
_SNAPSHOT = "SELECT s.db, c.current_version, s.applied, s.failed, s.undone, s.deleted, coalesce(p.n, 0) AS pending, coalesce(d.n, 0) AS drifted FROM (SELECT db, count(*) AS applied, count(*) FILTER (state LIKE 'Failed%' OR state = 'Needs repair') AS failed, count(*) FILTER (state = 'Undone') AS undone, count(*) FILTER (state = 'Deleted') AS deleted FROM states GROUP BY db) s LEFT JOIN current c ON c.db = s.db LEFT JOIN (SELECT db, count(*) AS n FROM pending WHERE reason IS NOT NULL AND reason <> 'below' GROUP BY db) p ON p.db = s.db LEFT JOIN (SELECT db, count(*) AS n FROM drifted GROUP BY db) d ON d.db = s.db"
query("h14_snapshot", "history scripts", info.overview, _SNAPSHOT)
_WAITING = "SELECT p.db, p.kind, p.version, p.name, p.script_id, c.description, c.file_checksum FROM pending p JOIN checked c ON c.db = p.db AND c.script_id = p.script_id WHERE reason IS NOT NULL AND reason <> 'below'"
_LISTING = f"""SELECT db, {category('label')} AS category, replace(coalesce(version, ''), '_', '.') AS version, cleaned AS description, type, state, execution_time, script, checksum, installed_by, installed_rank, success, resolved, 'applied' AS source, installed_on FROM labels
    UNION ALL SELECT w.db, {category('w.kind')}, replace(coalesce(w.version, ''), '_', '.'), description, w.kind, CASE WHEN w.kind = 'REPEATABLE' THEN 'Pending' WHEN coalesce({key('w.version')} <= {key('b.baseline_version')}, false) THEN 'Below Baseline'
      WHEN EXISTS (SELECT 1 FROM resolved u WHERE u.kind = 'UNDO_SQL' AND u.db = w.db AND u.version = w.version) THEN 'Available' ELSE 'Pending' END, NULL, name, CAST(file_checksum AS INT), NULL, NULL, NULL, true, 'pending', NULL
    FROM ({_WAITING}) w LEFT JOIN baseline b ON b.db = w.db
    UNION ALL SELECT db, 'Undo', version, description, 'UNDO_SQL', 'Available', NULL, 'U' || version || '__.sql', NULL, NULL, NULL, NULL, true, 'pending', NULL FROM synthetic_undos s
    WHERE NOT EXISTS (SELECT 1 FROM ({_WAITING}) w WHERE w.db = s.db AND replace(w.version, '_', '.') = s.version)"""
query("h16_synthetic_undos", "history scripts", state.synthetic_undos, "SELECT db, version, description FROM synthetic_undos")
query("h15_unified_listing", "history scripts", state.listing, _LISTING)
query("h16_available_undos", "history scripts", state.available_undos, "SELECT r.db, script_id, name, r.version FROM resolved r JOIN undone u ON u.db = r.db AND u.version = r.version WHERE kind = 'UNDO_SQL'")
_UNDOABLE = "EXISTS (SELECT 1 FROM resolved u WHERE u.named_kind = 'UNDO_SQL' AND u.db = {0}.db AND u.version = {0}.version)"


def _info(undone: str) -> str:
    """Rows of the report, given what besides a later undo makes a version undone."""
    return f"""SELECT l.db, {category('label')} AS category, replace(coalesce(l.version, ''), '_', '.') AS version, cleaned AS description, type,
      CASE WHEN type = 'DELETE' THEN 'Deleted' WHEN success IS NULL THEN 'Unknown' WHEN NOT success THEN 'Failed' WHEN type = 'BASELINE' THEN 'Baseline'
        WHEN type IN ('SQL', 'PYTHON') AND {undone} AND EXISTS (SELECT 1 FROM history x WHERE x.db = l.db AND x.version = l.version AND x.type = 'UNDO_SQL' AND x.success AND x.installed_rank > l.installed_rank) THEN 'Undone' ELSE 'Success' END AS state,
      {_UNDOABLE.format('l')} AS undoable, l.script, coalesce(execution_time, 0) AS execution_time, installed_rank, l.checksum, NULL AS place
    FROM labels l LEFT JOIN repeatable r ON r.db = l.db AND r.script = l.script
    WHERE NOT (type = 'REPEATABLE' AND r.script IS NOT NULL AND coalesce(l.checksum, 0) <> 0 AND l.checksum IS DISTINCT FROM r.checksum)
    UNION ALL SELECT w.db, {category('w.kind')}, replace(coalesce(w.version, ''), '_', '.'), description, w.kind, 'Pending', {_UNDOABLE.format('w')}, name, 0, NULL, NULL,
      row_number() OVER (PARTITION BY w.db ORDER BY w.kind NOT IN ('SQL', 'PYTHON'), coalesce(w.version, ''), name, script_id) FROM ({_WAITING}) w"""


query("h17_info", "history scripts", info.info, _info("EXISTS (SELECT 1 FROM undone d WHERE d.db = l.db AND d.version = l.version)"))
query("h18_older_info", "history scripts", info.older_info, _info("true"))
query("h18_info_by_state", "history scripts", lambda h, s: info.older_info(h, s).groupBy("db", "category", "state").agg(F.count(F.lit(1)).alias("n")), f"SELECT db, category, state, count(*) AS n FROM ({_info('true')}) GROUP BY ALL")
query("h19_repeated_runs", "history", history.unrepeated, "SELECT db, script, installed_rank, nth FROM (SELECT h.*, row_number() OVER (PARTITION BY h.db, h.script ORDER BY h.installed_rank) AS nth FROM history h JOIN ranks r ON r.db = h.db AND r.version = h.version WHERE h.success AND h.type IN ('SQL', 'PYTHON') AND r.last_ok > r.last_undo) WHERE nth > 1")
query("h20_undoable", "history scripts", state.undoable, "SELECT h.db, h.version, u.version IS NOT NULL AS undoable FROM (SELECT DISTINCT db, version FROM history WHERE success AND type IN ('SQL', 'PYTHON')) h LEFT JOIN (SELECT DISTINCT db, version FROM resolved WHERE kind = 'UNDO_SQL') u ON u.db = h.db AND u.version = h.version")
query("h21_labels", "history", history.labelled, "SELECT db, installed_rank, CASE WHEN t IN ('SQL', 'PYTHON') THEN 'Versioned' WHEN t = 'REPEATABLE' THEN 'Repeatable' WHEN t = 'UNDO_SQL' THEN 'Undo' WHEN t = 'BASELINE' THEN 'Baseline' ELSE 'Deleted' END AS category, t AS shown_type, trim(regexp_replace(description, '^\\[DELETE:[A-Z_]+\\]', '')) AS description FROM (SELECT *, CASE WHEN type = 'DELETE' AND regexp_extract(description, '^\\[DELETE:([A-Z_]+)\\]', 1) <> '' THEN regexp_extract(description, '^\\[DELETE:([A-Z_]+)\\]', 1) ELSE type END AS t FROM history)")
query("h22_clean_descriptions", "history", lambda h: h.groupBy(history.clean_description(F.col("description")).alias("description")).agg(F.count(F.lit(1)).alias("n")), "SELECT trim(regexp_replace(description, '^\\[DELETE:[A-Z_]+\\]', '')) AS description, count(*) AS n FROM history GROUP BY 1")
query("h23_still_pending", "history scripts", lambda h, s: state.still_pending(state.resolved_scripts(s).where("kind IN ('SQL', 'PYTHON')").select("db", "script_id", "version", F.col("kind").alias("type")), h).select("db", "script_id"), "SELECT db, script_id FROM resolved r WHERE kind IN ('SQL', 'PYTHON') AND NOT EXISTS (SELECT 1 FROM history h WHERE h.db = r.db AND h.version = r.version AND h.type = r.kind AND h.success AND h.installed_rank > coalesce((SELECT max(installed_rank) FROM history u WHERE u.db = h.db AND u.version = h.version AND u.type = 'UNDO_SQL' AND u.success), 0))")
_CAN = f"SELECT db, version, NOT coalesce(u > s, false) AS undoable FROM (SELECT db, version, max(installed_rank) FILTER (type = 'SQL') AS s, max(installed_rank) FILTER (type = 'UNDO_SQL') AS u FROM history WHERE success AND type IN ('SQL', 'UNDO_SQL') AND {_V} GROUP BY db, version) WHERE s IS NOT NULL"
query("h24_can_be_undone", "history", history.can_be_undone, _CAN)
query("h24_undo_advice", "history", history.undo_advice, """WITH v AS (SELECT db, version, max(installed_rank) FILTER (success AND type = 'UNDO_SQL') AS u, coalesce(max(installed_rank) FILTER (success AND type = 'SQL'), 0) AS s, bool_or(type = 'SQL') AND NOT bool_or(type = 'UNDO_SQL') AS free FROM history WHERE version <> '' GROUP BY db, version)
SELECT db, version, NOT coalesce(u > s, false) AS may_be_undone, CASE WHEN u > s THEN (SELECT max(version) FROM v f WHERE f.db = v.db AND f.free) END AS instead FROM v""")
query("h25_next_to_undo", "history", history.next_to_undo, f"SELECT db, max_by(version, {{'k': {_KEY}, 'v': version}}) AS version FROM ({_CAN}) WHERE undoable GROUP BY db")
query("h25_undo_down_to", "history", lambda h: history.undo_down_to(h, "3"), f"SELECT db, installed_rank, version, script FROM (SELECT *, max(b) OVER (PARTITION BY db ORDER BY installed_rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM (SELECT *, ({_KEY} <= {key("'3'")})::INT AS b FROM history WHERE success AND type = 'SQL' AND {_V})) WHERE stop = 0")
query("h26_matching_undo", "history scripts", state.matching_undo, "SELECT h.db, h.version, u.undo_script FROM (SELECT DISTINCT db, version FROM history WHERE success AND type IN ('SQL', 'PYTHON')) h JOIN (SELECT db, version, min(name) AS undo_script FROM resolved WHERE kind = 'UNDO_SQL' GROUP BY db, version) u ON u.db = h.db AND u.version = h.version")
query("h27_tags_by_version", "scripts", lambda s: state.resolved_scripts(s).where("version IS NOT NULL").groupBy("db", "version").agg(F.array_join(F.max_by("tags", "script_id"), ",").alias("tags")), "SELECT db, version, array_to_string(max_by(tags, script_id), ',') AS tags FROM resolved WHERE version IS NOT NULL GROUP BY db, version")
query("h28_applied_without_undone", "history", history.applied_without_undone, "SELECT h.db, h.installed_rank, h.type, h.script FROM history h LEFT JOIN undone u ON u.db = h.db AND u.version = h.version WHERE h.success AND (h.type NOT IN ('SQL', 'PYTHON') OR u.version IS NULL)")

# Filters
query("f1_filtered_scripts", "scripts", lambda s: state.filtered_scripts(s, target="20.3", without_tags=["SRC1 "], without_versions=["4.0"]).select("db", "script_id"), f"SELECT db, script_id FROM resolved WHERE (version IS NULL OR {_KEY} <= {key("'20.3'")}) AND coalesce(version <> '4.0', true) AND NOT list_contains(list_transform(tags, lambda t: lower(t)), 'src1')")
query("f1_tagged_scripts", "scripts", lambda s: state.filtered_scripts(s, tag_list=["EN", "src7"]).select("db", "script_id"), "SELECT db, script_id FROM resolved WHERE list_has_any(list_transform(tags, lambda t: lower(t)), ['en', 'src7'])")
query("f2_tags_case_sensitive", "scripts", lambda s: state.filtered_scripts(s, tag_list=["en", "SRC7"], fold_case=False).select("db", "script_id"), "SELECT db, script_id FROM resolved WHERE list_has_any(tags, ['en', 'SRC7'])")
query("f3_filter_lists", "scripts", lambda s: s.select("script_id", F.array_join(scripts.filter_list(F.concat(F.lit(" "), F.col("name"), F.lit(" , , x"), (F.col("script_id") % 3).cast("string"), F.lit(","))), "|").alias("listed"), F.array_join(scripts.filter_items(F.array(F.lit(" a "), F.col("name"), F.lit("")), True), "|").alias("trimmed"), F.array_join(scripts.filter_items(F.array(F.lit(" a "), F.col("name"), F.lit("")), False), "|").alias("kept")), "SELECT script_id, replace(replace(name, ', ', '|'), ',', '|') || '|x' || CAST(script_id % 3 AS VARCHAR) AS listed, 'a|' || name AS trimmed, ' a |' || name || '|' AS kept FROM scripts")
query("f4_history_in_scope", "history", lambda h: h.where(versions.version_key(F.col("version")) <= versions.version_key(F.lit("10"))).select("db", "installed_rank"), f"SELECT db, installed_rank FROM history WHERE {_KEY} <= {key("'10'")}")
query("f5_payload_without_nulls", "history", lambda h: h.select("installed_rank", F.to_json(F.struct("version", "checksum", "success")).alias("payload")), """SELECT installed_rank, '{' || array_to_string(list_filter([CASE WHEN version IS NOT NULL THEN '"version":"' || version || '"' END, CASE WHEN checksum IS NOT NULL THEN '"checksum":' || checksum::VARCHAR END, CASE WHEN success IS NOT NULL THEN '"success":' || success::VARCHAR END], lambda x: x IS NOT NULL), ',') || '}' AS payload FROM history""")

# Joins
query("j1_not_imported", "foreign_history sparse_history", lambda f, h: state.not_imported(f, h).select("db", "installed_rank"), "SELECT db, installed_rank FROM foreign_history f WHERE NOT EXISTS (SELECT 1 FROM sparse_history h WHERE h.db = f.db AND h.version = f.version AND h.version <> '') AND NOT EXISTS (SELECT 1 FROM sparse_history h WHERE h.db = f.db AND h.script = f.script)")
query("j10_referenced_columns", "constraints", lambda c: catalog.referenced_columns(c.where("type = 'FOREIGN KEY'").select("tab", "name", "pos", "col", F.concat(F.lit("t"), (F.substring("tab", 2, 9).cast("int") * 7 % 50).cast("string")).alias("ref_tab")).distinct(), c.where("type = 'PRIMARY KEY'")), "SELECT DISTINCT f.tab, f.name, f.pos, f.col, k.tab AS ref_tab, k.col AS ref_col FROM constraints f JOIN constraints k ON k.type = 'PRIMARY KEY' AND k.pos = f.pos AND k.tab = 't' || CAST(CAST(f.tab[2:] AS INT) * 7 % 50 AS VARCHAR) WHERE f.type = 'FOREIGN KEY'")
query("j2_applied_without_file", "history scripts", state.applied_without_file, "SELECT db, installed_rank, script FROM without_file")
query("j3_reappeared", "history scripts", state.reappeared, "SELECT h.db, h.script, min(h.installed_rank) AS deleted_at FROM history h JOIN (SELECT DISTINCT db, name FROM scripts) s ON s.db = h.db AND s.name = h.script WHERE h.type = 'DELETE' GROUP BY h.db, h.script")
query("j4_duplicate_versions", "scripts", lambda s: state.duplicate_versions(s.withColumn("db", F.col("db") % 2)), "SELECT db, version, first, name AS later, script_id FROM (SELECT * REPLACE (db % 2 AS db), first_value(name) OVER (PARTITION BY db % 2, version ORDER BY script_id) AS first, row_number() OVER (PARTITION BY db % 2, version ORDER BY script_id) AS n FROM resolved WHERE kind IN ('SQL', 'PYTHON') AND version IS NOT NULL) WHERE n > 1")
query("j5_changes_with_times", "journal", lambda j: journal.changes_with_times(j.where("success"), j).groupBy("object_type", "object_name").agg(F.count(F.lit(1)).alias("n"), F.sum("execution_time").alias("total")), "SELECT object_type, object_name, count(*) AS n, sum(t)::BIGINT AS total FROM journal j JOIN (SELECT migration_id, statement_index, min(execution_time) AS t FROM journal GROUP BY ALL) f USING (migration_id, statement_index) WHERE success GROUP BY ALL")
query("j6_column_diff", "columns", catalog.column_diff, "SELECT tab, name, d AS difference FROM (SELECT tab, name, unnest(list_filter([CASE WHEN y IS NULL THEN 'removed' END, CASE WHEN x IS NULL THEN 'added' END, CASE WHEN lower(x.type) <> lower(y.type) THEN 'type' END, CASE WHEN x.nullable <> y.nullable THEN 'nullable' END, CASE WHEN x IS NOT NULL AND y IS NOT NULL AND x.dflt IS DISTINCT FROM y.dflt THEN 'default' END], lambda e: e IS NOT NULL)) AS d FROM (SELECT coalesce(a.tab, b.tab) AS tab, coalesce(a.name, b.name) AS name, x, y FROM (SELECT tab, lower(col) AS name, {'type': type, 'nullable': nullable, 'dflt': dflt} AS x FROM columns WHERE side = 'a') a FULL JOIN (SELECT tab, lower(col) AS name, {'type': type, 'nullable': nullable, 'dflt': dflt} AS y FROM columns WHERE side = 'b') b ON a.tab = b.tab AND a.name = b.name))")
query("j7_merged_objects", "objects", lambda o: catalog.merged_objects(o.where("object_id % 3 <> 0"), o.where("object_id % 3 = 0")), "SELECT kind, lower(name) AS name, max_by(object_id, {'s': s, 'o': object_id}) AS object_id, max(s)::BIGINT AS side FROM (SELECT *, CASE WHEN object_id % 3 = 0 THEN 2 ELSE 1 END AS s FROM objects) GROUP BY 1, 2")
query("j8_constraints_to_add", "constraints", lambda c: catalog.constraints_to_add(c.where("pos = 0"), c.where("pos = 1 AND type <> 'CHECK'")), "SELECT DISTINCT tab, type, name FROM constraints n WHERE pos = 0 AND NOT EXISTS (SELECT 1 FROM constraints k WHERE k.pos = 1 AND k.type <> 'CHECK' AND k.tab = n.tab AND upper(k.name) = upper(n.name))")
_SETS = "SELECT tab, type, name, array_to_string(list_sort(list(DISTINCT col)), ',') AS columns FROM constraints GROUP BY ALL"
query("j9_unique_beside_primary", "constraints", catalog.unique_beside_primary, f"SELECT tab, name, s.columns FROM ({_SETS}) s WHERE type = 'UNIQUE' AND NOT EXISTS (SELECT 1 FROM ({_SETS}) p WHERE p.type = 'PRIMARY KEY' AND p.tab = s.tab AND p.columns = s.columns)")
query("j12_null_counts", "history", lambda h: catalog.null_counts(h.select("version", "checksum", "success", "script")), "SELECT 'version' AS column_name, count(*) FILTER (version IS NULL) AS n_null FROM history UNION ALL SELECT 'checksum', count(*) FILTER (checksum IS NULL) FROM history UNION ALL SELECT 'success', count(*) FILTER (success IS NULL) FROM history UNION ALL SELECT 'script', count(*) FILTER (script IS NULL) FROM history")
query("j14_duplicate_ranks", "history", lambda h: history.duplicate_ranks(h.withColumn("installed_rank", F.floor(F.col("installed_rank") / 3))), "SELECT db, floor(installed_rank / 3.0)::BIGINT AS installed_rank, count(*) AS n FROM history GROUP BY 1, 2 HAVING count(*) > 1")
query("j14_reranked", "history", lambda h: history.reranked(h.withColumns({"script": F.concat("script", F.lit("#"), F.col("installed_rank").cast("string")), "installed_rank": F.floor(F.col("installed_rank") / 3)})), "SELECT m.db, m.r AS installed_rank, m.s AS script, t.top + row_number() OVER (PARTITION BY m.db ORDER BY m.r, m.s) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY db, r ORDER BY s) AS n FROM (SELECT db, floor(installed_rank / 3.0)::BIGINT AS r, script || '#' || installed_rank::VARCHAR AS s FROM history)) m JOIN (SELECT db, max(floor(installed_rank / 3.0)::BIGINT) AS top FROM history GROUP BY db) t ON t.db = m.db WHERE m.n > 1")
query("j15_history_count", "history", history.counted, "SELECT db, count(*) AS n FROM history GROUP BY db")

# Aggregations
query("a1_statement_times", "journal", journal.statement_times, "SELECT migration_id, count(*) AS n, sum(execution_time)::BIGINT AS total, round(avg(execution_time), 6) AS mean, max(execution_time) AS longest, min(execution_time) AS shortest, max_by(statement_index, {'t': execution_time, 'i': -statement_index}) FILTER (execution_time > 0) AS slowest_index FROM journal GROUP BY migration_id")
query("a2_times_by_kind", "journal", journal.times_by_kind, "SELECT migration_id, object_type, count(*) AS n, sum(execution_time)::BIGINT AS total, max(execution_time) AS longest, count(DISTINCT object_name) AS objects, round(avg(execution_time), 6) AS mean FROM journal GROUP BY ALL")
query("a3_objects_by_schema", "objects", lambda o: catalog.counts_by_schema(o, ["table", "view", "index", "sequence", "trigger", "procedure"]), "SELECT lower(coalesce(schema_name, 'public')) AS schema_name, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("table", "view", "index", "sequence", "trigger", "procedure")) + " FROM objects GROUP BY 1")
query("a4_completeness", "objects", catalog.completeness, "SELECT kind, score, incomplete, CASE WHEN score >= 0.95 AND incomplete = 0 THEN 'HIGH' WHEN score >= 0.8 THEN 'MEDIUM' WHEN score >= 0.6 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence FROM (SELECT kind, round(avg(CASE WHEN total > 0 THEN captured / total ELSE 1.0 END), 6) AS score, count(*) FILTER (captured < total) AS incomplete FROM objects GROUP BY kind)")
query("a6_grouped_names", "objects", catalog.grouped_names, "SELECT kind, coalesce(schema_name, 'public') AS schema_name, count(DISTINCT lower(name)) AS n, min(lower(name)) AS first_name, max(lower(name)) AS last_name FROM objects GROUP BY 1, 2")
query("a7_summary_text", "objects", catalog.summary_text, "SELECT array_to_string(list_sort(list(kind || ': ' || n::VARCHAR)), ', ') AS summary FROM (SELECT kind, count(*) AS n FROM objects GROUP BY kind)")
query("a8_distinct_names", "objects", catalog.distinct_names, "SELECT DISTINCT kind, lower(coalesce(schema_name, 'public')) AS schema_name, lower(name) AS name FROM objects")
query("a9_assembled_constraints", "constraints", catalog.assembled_constraints, "SELECT tab, type, name, array_to_string(list(col ORDER BY pos, col), ',') AS columns FROM (SELECT DISTINCT tab, type, name, pos, col FROM constraints) GROUP BY ALL")
query("a10_run_statistics", "history", history.run_statistics, "SELECT db, count(*) AS total, count(*) FILTER (success OR type = 'BASELINE') AS successes, count(*) FILTER (NOT success AND type <> 'BASELINE') AS failures, count(*) FILTER (success IS NULL AND type <> 'BASELINE') AS unclear, count(*) FILTER (type = 'UNDO_SQL') AS undos, sum(execution_time)::BIGINT AS total_ms FROM history GROUP BY db")
query("a11_outcome_counts", "journal", journal.outcome_counts, "SELECT success, count(*) AS n FROM journal GROUP BY success")
query("a12_candidates_for_missing", "history", history.candidates_for_missing, "SELECT db, count(*) AS n FROM history h WHERE type NOT IN ('DELETE', 'BASELINE') AND NOT EXISTS (SELECT 1 FROM history d WHERE d.type = 'DELETE' AND d.db = h.db AND d.script = h.script) GROUP BY db")
# Categories of the messages of each dialect, in the order of the relation.
_CATEGORIES = {
    "postgresql": ("NETWORK", "NETWORK", "LOCKING", "SQL_SYNTAX", "INTERNAL", "AUTHORIZATION", "TIMEOUT"),
    "oracle": ("NETWORK", "TIMEOUT", "LOCKING", "SCHEMA", "RESOURCE", "UNKNOWN", "NETWORK"),
    "mysql": ("NETWORK", "LOCKING", "TIMEOUT", "CONSTRAINT", "UNKNOWN", "SCHEMA", "AUTHENTICATION"),
    "db2": ("NETWORK", "NETWORK", "LOCKING", "CONSTRAINT", "RESOURCE", "UNKNOWN", "NETWORK"),
}
for _dialect, _found_categories in _CATEGORIES.items():
    query(f"e1_errors_{_dialect}", "error_messages", lambda e, d=_dialect: e.where(F.col("dialect") == d).groupBy(F.col("message").alias("m"), journal.error_category(F.col("message"), d, F.col("exception")).alias("category")).agg(F.count(F.lit(1)).alias("n")), f"SELECT message AS m, {list(_found_categories)}[k + 1] AS category, count(*) AS n FROM error_messages WHERE dialect = '{_dialect}' GROUP BY ALL")
query("e1_error_categories", "error_messages", lambda e: e.where("dialect = 'any'").groupBy(journal.error_category(F.col("message")).alias("category"), journal.retryable(journal.error_category(F.col("message")), F.col("execution_time") % 5).alias("again")).agg(F.count(F.lit(1)).alias("n")), "SELECT category, category IN ('NETWORK', 'TIMEOUT', 'LOCKING') AND execution_time % 5 < 3 AS again, count(*) AS n FROM (SELECT *, ['NETWORK', 'LOCKING', 'AUTHORIZATION', 'TIMEOUT', 'UNKNOWN', 'NETWORK', 'AUTHENTICATION'][k + 1] AS category FROM error_messages WHERE dialect = 'any') GROUP BY ALL")

# SQL text
_BARE = r"regexp_replace(sql_text, '(?s)^(\s*(--[^\n]*(\n|$)|/\*.*?\*/))*\s*', '')"
query("p8_batches", "batches", lambda b: b.select("script_id", F.posexplode(sqltext.batches(F.col("content"))).alias("pos", "batch")).select("script_id", F.col("pos").cast("long").alias("pos"), "batch"), r"SELECT script_id, unnest(range(len(p))) AS pos, unnest(p) AS batch FROM (SELECT script_id, list_filter(list_transform(str_split_regex(content, '(?im)^[ \t]*GO[ \t]*(?:--[^\n]*)?$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM batches)")
query("p9_simple_statements", "batches", lambda b: b.select("script_id", F.explode(sqltext.simple_statements(F.col("content"))).alias("stmt")), r"SELECT script_id, unnest(list_filter(list_transform(str_split_regex(regexp_replace(content, '(?im)^[ \t]*GO[ \t]*(?:--[^\n]*)?$', ';', 'g'), ';'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS stmt FROM batches")
query("p7_quoted_statements", "statements", lambda s: s.select("stmt_id", F.size(sqltext.quoted_statements(F.concat("sql_text", F.lit("; SELECT ';' -- c;\n; /* ; */ x")))).cast("long").alias("n")), r"""SELECT stmt_id, len(list_filter(regexp_extract_all(regexp_replace(sql_text || '; SELECT '';'' -- c;' || chr(10) || '; /* ; */ x', '(?s)(''(?:[^'']|'''')*''|"[^"]*")|--[^\n]*|/\*.*?\*/', '\1', 'g'), '(?:[^;''"]|''(?:[^'']|'''')*''|"[^"]*")+;?'), lambda x: regexp_replace(x, '[;\s]', '', 'g') <> ''))::BIGINT AS n FROM statements""")
query("p11_statement_class", "statements", lambda s: s.select("stmt_id", sqltext.statement_class(F.col("sql_text")).alias("class")), f"SELECT stmt_id, CASE WHEN regexp_matches(h, '^(CREATE|ALTER|DROP|TRUNCATE|COMMENT|GRANT|REVOKE|RENAME)') THEN 'DDL' WHEN regexp_matches(h, '^(INSERT|UPDATE|DELETE|MERGE|UPSERT|EXEC\\s|EXECUTE )') THEN 'DML' WHEN regexp_matches(h, '^(SELECT|WITH|SHOW|DESC|EXPLAIN)') THEN 'QUERY' ELSE 'UNKNOWN' END AS class FROM (SELECT stmt_id, upper({_BARE}) AS h FROM statements)")
query("p12_verbs", "statements", lambda s: s.groupBy(sqltext.verb(F.col("sql_text")).alias("verb")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN v IN ('CREATE', 'ALTER', 'DROP', 'INSERT', 'UPDATE', 'DELETE', 'COMMENT', 'TRUNCATE') THEN v ELSE 'UNKNOWN' END AS verb, count(*) AS n FROM (SELECT upper(regexp_extract(sql_text, '^\\s*([A-Za-z]*)', 1)) AS v FROM statements) GROUP BY 1")
query("p13_executable", "statements", lambda s: s.where(sqltext.is_executable(F.col("sql_text"))).select("stmt_id"), f"SELECT stmt_id FROM (SELECT stmt_id, regexp_replace({_BARE}, '[\\s;]+$', '') AS r FROM statements) WHERE r <> '' AND upper(r) NOT IN ('GO', '/')")
query("p14_transaction_policy", "statements", lambda s: s.groupBy((F.col("stmt_id") % 50).alias("script")).agg(F.when(F.bool_and(sqltext.statement_class(F.col("sql_text")) != "DDL"), "transactional").when(F.bool_and(sqltext.statement_class(F.col("sql_text")) == "DDL"), "autocommit").otherwise("mixed").alias("policy")), f"SELECT stmt_id % 50 AS script, CASE WHEN bool_and(NOT d) THEN 'transactional' WHEN bool_and(d) THEN 'autocommit' ELSE 'mixed' END AS policy FROM (SELECT stmt_id, regexp_matches(upper({_BARE}), '^(CREATE|ALTER|DROP|TRUNCATE|COMMENT|GRANT|REVOKE|RENAME)') AS d FROM statements) GROUP BY 1")
query("p15_structural_problems", "statements", lambda s: s.select("stmt_id", sqltext.structural_problem(F.col("sql_text")).alias("problem")).where("problem IS NOT NULL"), "SELECT stmt_id, problem FROM (SELECT stmt_id, CASE WHEN trim(sql_text) = '' THEN 'empty' WHEN len(regexp_extract_all(sql_text, '\\(')) <> len(regexp_extract_all(sql_text, '\\)')) THEN 'parentheses' WHEN len(regexp_extract_all(sql_text, '''')) % 2 = 1 THEN 'quotes' END AS problem FROM statements) WHERE problem IS NOT NULL")
_OBJECT = r"(?i)^(?:CREATE|ALTER|DROP)\s+(?:UNIQUE\s+)?(TABLE|VIEW|INDEX)\s+([\w.]+)"
query("p16_objects", "statements", lambda s: s.withColumn("o", sqltext.object_of(F.col("sql_text"))).where("o.object_type IS NOT NULL").select("stmt_id", "o.*"), f"SELECT stmt_id, upper(regexp_extract(h, '{_OBJECT}', 1)) AS object_type, nullif(regexp_extract(regexp_extract(h, '{_OBJECT}', 2), '^(.*)\\.[^.]*$', 1), '') AS schema_name, regexp_extract(regexp_extract(h, '{_OBJECT}', 2), '([^.]*)$', 1) AS object_name FROM (SELECT stmt_id, {_BARE} AS h FROM statements) WHERE regexp_matches(h, '{_OBJECT}')")
query("p16_object_kinds", "defined", lambda d: d.withColumn("o", sqltext.object_of(F.col("sql_text"))).where("o.object_type IS NOT NULL").select("stmt_id", "o.*"), "SELECT stmt_id, ['TABLE', 'VIEW', 'VIEW', 'INDEX', 'SEQUENCE', 'TRIGGER', 'PROCEDURE', 'FUNCTION', 'TABLE', 'TYPE', 'SCHEMA'][k + 1] AS object_type, CASE stmt_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'Y' END AS schema_name, CASE WHEN stmt_id % 3 = 0 THEN 'Obj1' ELSE 'obj2' END AS object_name FROM defined WHERE k < 11")
query("x4_option_diff", "options", catalog.option_diff, "SELECT coalesce(a.tab, b.tab) AS tab, coalesce(a.option, b.option) AS option, old, new FROM (SELECT tab, lower(option) AS option, max(value) AS old FROM options WHERE side = 'a' GROUP BY ALL) a FULL JOIN (SELECT tab, lower(option) AS option, max(value) AS new FROM options WHERE side = 'b' GROUP BY ALL) b ON a.tab = b.tab AND a.option = b.option WHERE old IS DISTINCT FROM new")
query("p22_placeholders", "batches", lambda b: b.select("script_id", sqltext.substituted(F.col("content"), {"state": F.col("state")}).alias("content")), "SELECT script_id, regexp_replace(replace(content, '$' || '{state}', state), '\\$\\{\\w+:([^}]*)\\}', '\\1', 'g') AS content FROM batches")
query("p23_returns_rows", "statements", lambda s: s.where(sqltext.returns_rows(F.col("sql_text"))).select("stmt_id"), f"SELECT stmt_id FROM statements WHERE regexp_matches(upper(regexp_replace({_BARE}, '^[(\\s]+', '')), '^(SELECT|WITH|SHOW|VALUES|EXPLAIN|DESC)')")
_TARGET = r"(?i)^(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO|TRUNCATE\s+TABLE)\s+([\w.]+)"
query("d1_dml_analysis", "statements", lambda s: s.withColumn("a", sqltext.dml_analysis(F.col("sql_text"))).where("a IS NOT NULL").select("stmt_id", "a.target", F.array_join("a.events", ",").alias("events"), F.array_join("a.updated_columns", ",").alias("updated_columns")), """SELECT stmt_id, CASE WHEN k = 14 THEN 's.' ELSE '' END || 'tab' || (stmt_id % 7)::VARCHAR AS target, CASE k WHEN 3 THEN 'INSERT' WHEN 4 THEN 'UPDATE' WHEN 5 THEN 'DELETE' WHEN 6 THEN 'INSERT,UPDATE' WHEN 7 THEN 'INSERT,UPDATE' WHEN 14 THEN 'UPDATE' END AS events, CASE k WHEN 4 THEN 'name,price' WHEN 14 THEN 'b' END AS updated_columns FROM (SELECT stmt_id, stmt_id % 16 AS k FROM statements) WHERE k IN (3, 4, 5, 6, 7, 13, 14)""")
query("d2_dml_targets", "statements", lambda s: s.select("stmt_id", sqltext.dml_target(F.col("sql_text")).alias("target")).where("target IS NOT NULL"), f"SELECT stmt_id, regexp_extract({_BARE}, '{_TARGET}', 1) AS target FROM statements WHERE regexp_matches({_BARE}, '{_TARGET}')")
query("d3_dml_events", "statements", lambda s: s.select("stmt_id", F.array_join(sqltext.dml_events(F.col("sql_text")), ",").alias("events")), f"SELECT stmt_id, CASE WHEN h LIKE 'INSERT%' THEN CASE WHEN regexp_matches(h, '(?s)ON\\s+DUPLICATE\\s+KEY\\s+UPDATE|ON\\s+CONFLICT.*DO\\s+UPDATE') THEN 'INSERT,UPDATE' ELSE 'INSERT' END WHEN h LIKE 'UPDATE%' THEN 'UPDATE' WHEN h LIKE 'DELETE%' THEN 'DELETE' WHEN h LIKE 'MERGE%' THEN array_to_string(list_sort(list_distinct(regexp_extract_all(h, 'THEN\\s+(INSERT|UPDATE|DELETE)', 1))), ',') END AS events FROM (SELECT stmt_id, upper({_BARE}) AS h FROM statements)")
query("d4_upserts", "statements", lambda s: s.where(sqltext.is_upsert(F.col("sql_text"))).select("stmt_id"), "SELECT stmt_id FROM statements WHERE regexp_matches(sql_text, '(?is)ON\\s+DUPLICATE\\s+KEY\\s+UPDATE|ON\\s+CONFLICT.*DO\\s+UPDATE')")
query("d5_updated_columns", "statements", lambda s: s.select("stmt_id", F.explode(sqltext.updated_columns(F.col("sql_text"))).alias("column_name")), f"SELECT stmt_id, c AS column_name FROM (SELECT stmt_id, unnest(list_transform(string_split(regexp_extract({_BARE}, '(?is)^UPDATE\\s+.*?\\s+SET\\s+(.*?)(?:\\s+WHERE\\s.*)?$', 1), ','), lambda x: lower(regexp_extract(x, '(?:\\w+\\.)?(\\w+)\\s*=', 1)))) AS c FROM statements) WHERE c <> ''")
query("d6_where_text", "statements", lambda s: s.select("stmt_id", sqltext.where_text(F.col("sql_text")).alias("predicate")).where("predicate IS NOT NULL"), f"SELECT stmt_id, p AS predicate FROM (SELECT stmt_id, regexp_extract({_BARE}, '(?is)^(?:UPDATE|DELETE)\\s.*?\\sWHERE\\s+(.*)$', 1) AS p FROM statements) WHERE p <> ''")
query("d7_changes_all_rows", "statements", lambda s: s.where(sqltext.changes_all_rows(F.col("sql_text"))).select("stmt_id"), f"SELECT stmt_id FROM (SELECT stmt_id, upper({_BARE}) AS h FROM statements) WHERE regexp_matches(h, '^(UPDATE|DELETE)') AND NOT regexp_matches(h, '\\bWHERE\\b')")
query("d8_inserted_literals", "statements", lambda s: s.select("stmt_id", F.array_join(sqltext.inserted_literals(F.col("sql_text")), ";").alias("row")).where("row <> ''"), "SELECT stmt_id, CASE WHEN stmt_id % 16 = 3 THEN 'id=1;name=''a;b''' ELSE 'id=1' END AS row FROM statements WHERE stmt_id % 16 IN (3, 7)")
query("d9_touches_key", "statements", lambda s: s.where(sqltext.touches(F.col("sql_text"), ["PRICE"])).select("stmt_id"), f"SELECT stmt_id FROM statements WHERE regexp_matches({_BARE}, '(?is)^UPDATE\\s+.*\\sSET\\s+(.*,\\s*)?price\\s*=')")
query("d10_without_comments", "statements", lambda s: s.select("stmt_id", sqltext.without_comments(F.col("sql_text")).alias("sql_text")), f"SELECT stmt_id, {_BARE} AS sql_text FROM statements")

# Types and names
_BASE, _ARGS = "trim(upper(regexp_replace(type_name, '\\s*\\(.*$', '')))", "replace(regexp_extract(type_name, '(\\(.*\\))\\s*$', 1), ' ', '')"


_FAMILY = type_case(lambda row: row[1])
for _dialect in ("postgresql", "oracle", "mysql", "mariadb", "sqlserver", "db2", "sqlite"):
    query(f"n1_normalised_types_{_dialect}", "types", lambda t, d=_dialect: t.select("type_id", types.normalised_type(F.col("type_name"), d).alias("type_name")), f"SELECT type_id, {type_case(lambda row, d=_dialect: row[3].get(d, row[2]))} AS type_name FROM types")
    query("n6_preferred_types" + f"_{_dialect}" * (_dialect != "oracle"), "types", lambda t, d=_dialect: t.select("type_id", types.preferred_type(F.col("type_name"), d).alias("preferred")), f"SELECT type_id, CASE f WHEN 'INTEGER' THEN '{dict(oracle='NUMBER', mysql='INT', mariadb='INT', sqlserver='INT').get(_dialect, 'INTEGER')}' WHEN 'VARCHAR' THEN '{dict(oracle='VARCHAR2', sqlite='TEXT').get(_dialect, 'VARCHAR')}' WHEN 'TIMESTAMP' THEN '{dict(mysql='DATETIME', mariadb='DATETIME', sqlserver='DATETIME2', sqlite='DATETIME').get(_dialect, 'TIMESTAMP')}' ELSE f END AS preferred FROM (SELECT type_id, {_FAMILY} AS f FROM types)")
query("n3_versioned_types", "types", lambda t: t.withColumn("v", F.concat((F.col("d") + 5).cast("string"), F.lit(".6"))).select("type_id", types.canonical_type(F.col("type_name"), "postgresql", F.col("v")).alias("family")), f"SELECT type_id, CASE type_name WHEN 'serial' THEN 'INTEGER' ELSE {_FAMILY} END AS family FROM types")
query("n2_type_parameters", "types", lambda t: t.withColumn("p", types.type_parameters(F.col("type_name"))).select("type_id", types.type_base(F.col("type_name")).alias("base"), "p.*"), f"SELECT type_id, {_BASE} AS base, TRY_CAST(regexp_extract(type_name, '\\(\\s*(\\d+)\\s*(?:,\\s*(\\d+)\\s*)?\\)', 1) AS BIGINT) AS precision, TRY_CAST(regexp_extract(type_name, '\\(\\s*(\\d+)\\s*(?:,\\s*(\\d+)\\s*)?\\)', 2) AS BIGINT) AS scale FROM types")
query("n3_canonical_types", "types", lambda t: t.select("type_id", types.canonical_type(F.col("type_name")).alias("family")), f"SELECT type_id, {_FAMILY} AS family FROM types")
query("n5_same_family", "types", lambda t: t.select("type_id", (types.canonical_type(F.col("type_name")) == types.canonical_type(F.lit("NUMERIC(18,0)"))).alias("same")), f"SELECT type_id, {_FAMILY} = 'INTEGER' AS same FROM types")

def _identifier():
    return F.when(F.col("object_id") % 3 == 0, F.concat(F.lit('"'), "name", F.lit('"'))).when(F.col("object_id") % 3 == 1, F.concat(F.lit("Sales."), "name")).otherwise(F.col("name"))


_IDENTIFIER_SQL = "CASE object_id % 3 WHEN 0 THEN '\"' || name || '\"' WHEN 1 THEN 'Sales.' || name ELSE name END"
query("n7_identifiers", "objects", lambda o: o.select("object_id", types.normalised_identifier(_identifier(), "oracle").alias("upper_name"), types.normalised_identifier(_identifier(), "postgresql").alias("lower_name")), "SELECT object_id, CASE object_id % 3 WHEN 0 THEN name WHEN 1 THEN upper('Sales.' || name) ELSE upper(name) END AS upper_name, CASE object_id % 3 WHEN 0 THEN name WHEN 1 THEN lower('Sales.' || name) ELSE lower(name) END AS lower_name FROM objects")
query("n8_qualified_names", "objects", lambda o: o.withColumn("q", types.qualified_name(_identifier())).select("object_id", "q.*"), f"SELECT object_id, regexp_replace({_IDENTIFIER_SQL}, '^[^.]*\\.', '') AS object_name, CASE WHEN object_id % 3 = 1 THEN 'Sales' END AS schema_name FROM objects")
query("n9_needs_quotes", "objects", lambda o: o.select("object_id", types.needs_quotes(F.when(F.col("object_id") % 7 == 0, F.lit("")).when(F.col("object_id") % 7 == 1, F.concat(F.lit("1"), "name")).when(F.col("object_id") % 7 == 2, F.lit("Order")).otherwise(_identifier())).alias("quotes")), "SELECT object_id, CASE object_id % 7 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true ELSE object_id % 3 <> 2 END AS quotes FROM objects")

# Graphs
_CLOSURE = "WITH RECURSIVE r(src, dst, p) AS (SELECT src, dst, [src, dst] FROM {e} UNION ALL SELECT r.src, e.dst, list_append(r.p, e.dst) FROM r JOIN {e} e ON e.src = r.dst WHERE NOT list_contains(r.p[2:], e.dst)) "
_DEPTH = "WITH RECURSIVE d(node, depth) AS (SELECT dst, 0 FROM edges WHERE dst NOT IN (SELECT src FROM edges) UNION ALL SELECT e.src, depth + 1 FROM d JOIN edges e ON e.dst = d.node) "
query("g1_table_references", "statements", graph.table_references, "SELECT DISTINCT stmt_id, lower(unnest(regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)?)', 1))) AS ref FROM statements")
query("g4_reversed_edges", "edges", graph.reversed_edges, "SELECT DISTINCT dst AS src, src AS dst FROM edges")
query("g5_degrees", "edges", graph.degrees, "SELECT node, count(*) FILTER (o) AS needs, count(*) FILTER (NOT o) AS needed_by FROM (SELECT DISTINCT src AS node, dst, true AS o FROM edges UNION ALL SELECT DISTINCT dst, src, false FROM edges) GROUP BY node")
query("g6_closure", "edges", graph.closure, _CLOSURE.format(e="edges") + "SELECT DISTINCT src, dst FROM r")
query("g6_closure_cyclic", "cyclic_edges", graph.closure, _CLOSURE.format(e="cyclic_edges") + "SELECT DISTINCT src, dst FROM r")
query("g7_creation_order", "edges", graph.creation_order, _DEPTH + "SELECT node, depth, row_number() OVER (ORDER BY depth, node) AS place FROM (SELECT node, max(depth)::BIGINT AS depth FROM d GROUP BY node)")
query("g8_in_cycles", "cyclic_edges", graph.in_cycles, _CLOSURE.format(e="cyclic_edges") + "SELECT DISTINCT src AS node FROM r WHERE src = dst")
query("g9_has_cycle", "edges", graph.has_cycle, _CLOSURE.format(e="edges") + "SELECT count(*) FILTER (src = dst) > 0 AS has_cycle FROM r")
# Pairs on a common cycle, and from each component's least node the walk to least needs until it meets itself.
_COMPONENTS = "WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM {e} UNION SELECT r.src, e.dst FROM r JOIN {e} e ON e.src = r.dst), member AS (SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src)"
_CYCLES = _COMPONENTS + """, step AS (SELECT e.src AS node, min(e.dst) AS nxt FROM {e} e JOIN member a ON a.node = e.src JOIN member b ON b.node = e.dst AND b.component = a.component GROUP BY e.src),
walk(component, p) AS (SELECT component, [component] FROM member WHERE node = component UNION ALL SELECT component, list_append(p, nxt) FROM walk JOIN step ON step.node = p[-1] WHERE NOT list_contains(p[:-2], p[-1])),
ring AS (SELECT component, p[list_position(p, p[-1]):-2] AS c FROM walk WHERE list_contains(p[:-2], p[-1]))
SELECT component, len(c)::BIGINT AS length, c[list_position(c, list_min(c)):] || c[:list_position(c, list_min(c)) - 1] || [list_min(c)] AS path FROM ring"""
query("g8_components", "tangled_edges", strong_components, _COMPONENTS.format(e="tangled_edges") + " SELECT node, component FROM member")
query("g8_cycle_paths", "tangled_edges", graph.cycle_paths, _CYCLES.format(e="tangled_edges"))
query("g8_object_cycles", "definitions references", lambda d, r: graph.cycle_paths(graph.object_edges(d, r)), _CYCLES.format(e="object_graph"))
query("g9_has_cycle_long", "long_edges", graph.has_cycle, "SELECT count(*) > 0 AS has_cycle FROM long_edges WHERE substr(src, 2)::BIGINT >= substr(dst, 2)::BIGINT AND dst NOT LIKE 'leaf%'".replace("substr(dst, 2)::BIGINT", "TRY_CAST(substr(dst, 2) AS BIGINT)"))
query("g3_object_graph", "definitions references", graph.object_edges, "SELECT src, dst, via, found FROM object_graph")
query("g5_object_degrees", "definitions references", lambda d, r: graph.degrees(graph.object_edges(d, r).select("src", "dst")), "SELECT node, count(*) FILTER (o) AS needs, count(*) FILTER (NOT o) AS needed_by FROM (SELECT DISTINCT src AS node, dst, true AS o FROM object_graph UNION ALL SELECT DISTINCT dst, src, false FROM object_graph) GROUP BY node")
# Depths of a chain are differences of its numbers.
query("o2_long_depths", "long_edges", graph.depths, "SELECT src AS node, (SELECT max(o_orderkey) + 1 FROM orders) - substr(src, 2)::BIGINT AS depth FROM (SELECT DISTINCT src FROM long_edges) UNION ALL SELECT DISTINCT dst, 0 FROM long_edges WHERE dst NOT IN (SELECT src FROM long_edges)")
_ABOVE = " SELECT node FROM member UNION SELECT r.src FROM r JOIN member ON member.node = r.dst"
_PRIORITY = "list_position(['sequence', 'table', 'index', 'view', 'procedure', 'trigger'], split_part(node, '.', 2))::BIGINT"
query("o2_dependency_order", "definitions references", lambda d, r: graph.dependency_order(d, graph.object_edges(d, r), strict=False), _COMPONENTS.format(e="object_graph") + f""", blocked AS ({_ABOVE}),
obj AS (SELECT DISTINCT lower(coalesce(schema_name, 'public')) || '.' || kind || '.' || lower(name) AS node FROM definitions),
d(node, depth) AS (SELECT node, 0 FROM (SELECT node FROM obj UNION SELECT dst FROM object_graph) WHERE node NOT IN (SELECT src FROM object_graph) UNION SELECT e.src, depth + 1 FROM d JOIN object_graph e ON e.dst = d.node WHERE e.src NOT IN (SELECT node FROM blocked))
SELECT node, {_PRIORITY} AS priority, depth, row_number() OVER (ORDER BY {_PRIORITY}, depth NULLS LAST, split_part(node, '.', 1), split_part(node, '.', 3)) AS place FROM obj LEFT JOIN (SELECT node, max(depth)::BIGINT AS depth FROM d GROUP BY node) USING (node)""")
query("o1_canonical_order", "objects", graph.canonical_order, "SELECT object_id, kind, row_number() OVER (PARTITION BY kind ORDER BY lower(coalesce(schema_name, 'public')), lower(name), object_id) AS place, list_position(['sequence', 'table', 'index', 'view', 'procedure', 'trigger'], kind)::BIGINT AS priority FROM objects")
query("o2_depths", "edges", graph.depths, _DEPTH + "SELECT node, max(depth)::BIGINT AS depth FROM d GROUP BY node")

# Constraints, undo scripts, repair
query("x7_constraint_problems", "constraints", catalog.constraint_problems, f"SELECT tab, 'several primary keys' AS problem, count(*)::VARCHAR AS detail FROM (SELECT DISTINCT tab, name FROM constraints WHERE type = 'PRIMARY KEY') GROUP BY tab HAVING count(*) > 1 UNION ALL SELECT tab, 'name used twice', name FROM constraints GROUP BY tab, name HAVING count(DISTINCT type) > 1 UNION ALL SELECT tab, 'trivial check', name FROM constraints WHERE type = 'CHECK' GROUP BY tab, name HAVING bool_or(expr = '1=1') UNION ALL SELECT tab, 'unique columns repeat', s.columns FROM ({_SETS}) s WHERE type = 'UNIQUE' GROUP BY tab, s.columns HAVING count(*) > 1")
query("x7_reference_problems", "constraints table_columns foreign_keys", catalog.reference_problems, """WITH k AS (SELECT DISTINCT tab, type, name, lower(col) AS col FROM constraints), f AS (SELECT tab, name, max(ref_tab) AS ref_tab, count(DISTINCT pos) AS n, count(DISTINCT pos) FILTER (ref_col IS NOT NULL) AS r, list(DISTINCT lower(ref_col)) FILTER (ref_col IS NOT NULL) AS cs FROM foreign_keys GROUP BY tab, name)
SELECT DISTINCT tab, 'no columns' AS problem, '' AS detail FROM constraints WHERE tab NOT IN (SELECT tab FROM table_columns)
UNION ALL SELECT DISTINCT tab, 'missing column', name || '.' || col FROM k WHERE tab IN (SELECT tab FROM table_columns) AND NOT EXISTS (SELECT 1 FROM table_columns c WHERE c.tab = k.tab AND lower(c.col) = k.col)
UNION ALL SELECT tab, 'nullable key column', name || '.' || col FROM k WHERE type = 'PRIMARY KEY' AND EXISTS (SELECT 1 FROM table_columns c WHERE c.tab = k.tab AND lower(c.col) = k.col AND nullable)
UNION ALL SELECT tab, 'computed without expression', lower(col) FROM table_columns WHERE computed AND coalesce(expr, '') = ''
UNION ALL SELECT tab, 'foreign key without table', name FROM f WHERE ref_tab IS NULL
UNION ALL SELECT tab, 'foreign key without columns', name FROM f WHERE r = 0
UNION ALL SELECT tab, 'foreign key with other columns', name FROM f WHERE r > 0 AND r <> n
UNION ALL SELECT tab, 'foreign key without key', name FROM f WHERE ref_tab IS NOT NULL AND r > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT tab AS t, type, name, list(col) AS u FROM k WHERE type IN ('PRIMARY KEY', 'UNIQUE') GROUP BY ALL) g WHERE g.t = f.ref_tab AND list_has_all(f.cs, g.u))""")
_REVERSED = f"SELECT stmt_id, CASE stmt_id % 16 WHEN 0 THEN 'DROP TABLE s.' || t WHEN 9 THEN 'DROP INDEX ix' || n WHEN 1 THEN 'ALTER TABLE ' || t || ' DROP COLUMN c' || n WHEN 3 THEN 'DELETE FROM ' || t || ' WHERE id = 1 AND name = ''a;b''' WHEN 7 THEN 'DELETE FROM ' || t || ' WHERE id = 1' END AS undo_sql, CASE WHEN stmt_id % 16 IN (0, 1, 9) THEN NULL WHEN stmt_id % 16 IN (3, 7) THEN 'review: deletes by equality' ELSE 'cannot reverse ' || CASE WHEN v IN ('CREATE', 'ALTER', 'DROP', 'INSERT', 'UPDATE', 'DELETE', 'COMMENT', 'TRUNCATE') THEN v ELSE 'UNKNOWN' END END AS warning FROM (SELECT stmt_id, 'tab' || (stmt_id % 7)::VARCHAR AS t, (stmt_id % 5)::VARCHAR AS n, upper(regexp_extract({_BARE}, '^([A-Za-z]*)', 1)) AS v FROM statements)"
query("u2_reversed_statements", "statements", undo.reversed_statements, _REVERSED)
query("u1_reversed_script", "statements", lambda s: undo.reversed_script(s.withColumn("script", F.col("stmt_id") % 100), ["script"]), f"SELECT stmt_id % 100 AS script, -stmt_id AS undo_order, undo_sql, warning FROM ({_REVERSED}) r JOIN statements USING (stmt_id) WHERE NOT EXISTS (SELECT 1 FROM statements m WHERE m.stmt_id % 100 = r.stmt_id % 100 AND m.stmt_id % 16 = 0 AND 's.tab' || (m.stmt_id % 7)::VARCHAR = lower(regexp_extract({_BARE.replace('sql_text', 'statements.sql_text')}, '{_TARGET}', 1)))")
query("u3_reversed_alters", "alters", undo.reversed_statements, """SELECT stmt_id, 'ALTER TABLE ' || CASE WHEN k = 10 THEN 'S.New1 RENAME TO Tab' || (stmt_id % 7)::VARCHAR ELSE 'S.Tab' || (stmt_id % 7)::VARCHAR || [' DROP COLUMN c1', ' DROP COLUMN c2', ' DROP CONSTRAINT k1', ' DROP PRIMARY KEY', ' DROP FOREIGN KEY k3', NULL, NULL, NULL, NULL, NULL, NULL, ' RENAME COLUMN new2 TO old1', NULL, NULL][k + 1] END AS undo_sql,
  CASE WHEN k = 5 THEN 'no constraint name found' WHEN k = 6 THEN 'DROP COLUMN ' || x WHEN k IN (7, 13) THEN 'DROP CONSTRAINT ' || x WHEN k IN (8, 9) THEN 'a changed column ' || x WHEN k = 12 THEN 'cannot reverse ALTER' END AS warning FROM (SELECT *, 'cannot be reversed without the original definition' AS x FROM alters)""")
_REPAIR = "SELECT db, script, installed_rank, 'CHECKSUM_MISMATCH' AS repair_type FROM drifted_sql UNION ALL SELECT db, script, installed_rank, 'MISSING_SCRIPT' FROM without_file w WHERE NOT EXISTS (SELECT 1 FROM history d WHERE d.type = 'DELETE' AND d.db = w.db AND d.script = w.script) UNION ALL SELECT db, script, installed_rank, 'FAILED_MIGRATION' FROM history WHERE NOT success"
query("r1_repair_plan", "history scripts", state.repair_plan, _REPAIR)
query("r4_strict_violations", "history scripts", state.strict_violations, f"SELECT DISTINCT db, script, 'missing' AS rule FROM without_file UNION ALL SELECT r.db, r.name, 'below_highest' FROM resolved r JOIN (SELECT db, max_by(version, {{'k': {_KEY}, 'r': -installed_rank}}) AS highest FROM history WHERE success AND type IN ('SQL', 'PYTHON') AND {_V} GROUP BY db) h ON h.db = r.db WHERE r.kind IN ('SQL', 'PYTHON') AND r.version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM history x WHERE x.db = r.db AND x.version = r.version AND x.type IN ('SQL', 'PYTHON')) AND {key('r.version')} < {key('h.highest')}")
query("r5_failed_issues", "history scripts", state.failed_issues, "SELECT db, installed_rank, script, type FROM history h WHERE NOT success AND NOT (type = 'REPEATABLE' AND EXISTS (SELECT 1 FROM rerun r WHERE r.verdict = 'modified' AND r.db = h.db AND r.script = h.script))")


# More of validation, catalogs and imports
query("h3c_reapplied_by_sequence", "history", history.reapplied_after_last_undo, "SELECT DISTINCT h.db, h.version FROM history h WHERE success AND type IN ('SQL', 'PYTHON') AND installed_rank > (SELECT max(installed_rank) FROM history u WHERE u.db = h.db AND u.version = h.version AND u.type = 'UNDO_SQL' AND u.success)")
query("r2_empty_folder_gate", "history few_scripts", state.empty_folder_gate, "SELECT db, count(*) AS n FROM history h WHERE type NOT IN ('DELETE', 'BASELINE') AND db NOT IN (SELECT db FROM few_scripts) AND NOT EXISTS (SELECT 1 FROM history d WHERE d.type = 'DELETE' AND d.db = h.db AND d.script = h.script) GROUP BY db")
_AFTER = ("db", "installed_rank", "type", "script", "checksum", "success")


def _applied_repair(h: DataFrame, s: DataFrame) -> DataFrame:
    path = new_path(h.sparkSession, "history")
    write_history(h, path, ["db"])
    state.apply_repair(path, s)
    return h.sparkSession.read.parquet(path).select(F.col("db").cast("long").alias("db"), *_AFTER[1:])


def _appended(h: DataFrame, new: DataFrame) -> DataFrame:
    path = new_path(h.sparkSession, "history")
    with_id = lambda df: df.withColumn("script", F.concat("script", F.lit("#"), F.col("installed_rank").cast("string")))
    for rows in (h, new):
        append_history(with_id(rows), path)
    return read_history(h.sparkSession, path).select("installed_rank", "version", "type", "script", "checksum", "success")


def _read_back(s: DataFrame) -> DataFrame:
    """Contents written in four character sets below two folders, read back with what each file's bytes say."""
    path = new_path(s.sparkSession, "scripts")
    line = F.concat(F.lit("-- a line of a script, as it was read: "), F.regexp_replace(F.regexp_replace("content", r"[\r\n\x00\x01\x85\u2028\u2029]", " "), r"[^\x00-\xff]", "?"))
    for k, (charset, folder) in enumerate((("UTF-8", "flat"), ("ISO-8859-1", "deep/one"), ("UTF-16LE", "deep/two"), ("UTF-16", "flat"))):
        written_scripts(s.where(F.col("script_id") % 4 == k).select(line.alias("content")), f"{path}/{folder}/{k}", charset)
    files = read_scripts(s.sparkSession, {f"{path}/flat/0": False, f"{path}/flat/3": False, f"{path}/deep": True, f"{path}/deep/one": True}, "*.csv")
    lines = files.select(F.regexp_extract("path", r"/(\d)/[^/]*$", 1).alias("written"), F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("written").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"), F.max("line").alias("last"))


_REPAIRED = f"SELECT h.db, h.installed_rank, h.type, h.script, CASE WHEN h.type = 'SQL' AND a.c IS NOT NULL THEN a.c ELSE h.checksum END::INT AS checksum, h.success FROM history h LEFT JOIN (SELECT d.db, d.script, min(c.file_checksum) AS c FROM (SELECT DISTINCT db, script FROM drifted_sql) d JOIN checked c ON c.db = d.db AND c.name = d.script GROUP BY ALL) a ON a.db = h.db AND a.script = h.script WHERE h.success IS DISTINCT FROM false UNION ALL SELECT g.db, t.top + row_number() OVER (PARTITION BY g.db ORDER BY g.script), 'DELETE', g.script, NULL, true FROM (SELECT DISTINCT db, script FROM ({_REPAIR}) WHERE repair_type = 'MISSING_SCRIPT') g JOIN (SELECT db, max(installed_rank) AS top FROM history GROUP BY db) t ON t.db = g.db"
query("r3_repaired", "history scripts", lambda h, s: state.repaired(h, s).select(*_AFTER), _REPAIRED)
query("r3_applied_repair", "history scripts", _applied_repair, _REPAIRED)
query("s10_appended_history", "sparse_history foreign_history", _appended, """WITH old AS (SELECT *, script || '#' || installed_rank::VARCHAR AS s FROM sparse_history), new AS (SELECT *, script || '#' || installed_rank::VARCHAR AS s FROM foreign_history)
SELECT row_number() OVER (ORDER BY s) AS installed_rank, version, type, s AS script, checksum, success FROM old UNION ALL SELECT (SELECT count(*) FROM old) + row_number() OVER (ORDER BY s), version, type, s, checksum, success FROM new""")
query("s1_scripts_read_back", "scripts", _read_back, r"""SELECT (script_id % 4)::VARCHAR AS written, count(*) AS n, sum(length(l))::BIGINT AS chars, max(l) AS last FROM (SELECT script_id, '-- a line of a script, as it was read: ' || regexp_replace(regexp_replace(content, '[\r\n\x00\x01\x{85}\x{2028}\x{2029}]', ' ', 'g'), '[^\x00-\x{ff}]', '?', 'g') AS l FROM scripts) GROUP BY 1""")
_SETS4 = (("UTF-8", "utf-8", ""), ("UTF-16LE", "utf-16-le", "\ufeff"), ("UTF-16BE", "utf-16-be", "\ufeff"), ("ISO-8859-1", None, ""))
query("s6_encodings", "scripts", lambda s: (lambda b: b.select("script_id", encoding(F.col("b")).alias("encoding"), (decoded(F.col("b")) == F.col("t")).alias("same")))(s.withColumn("t", F.concat(F.lit("x"), F.regexp_replace("content", r"[^\x00-\xff]", "?"))).select("script_id", "t", F.coalesce(*[F.when(F.col("script_id") % 4 == k, F.encode(F.concat(F.lit(bom), "t"), c)) for k, (c, _, bom) in enumerate(_SETS4)]).alias("b"))), r"""SELECT script_id, CASE script_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' WHEN 2 THEN 'utf-16-be' ELSE CASE WHEN regexp_matches(t, '[\x{80}-\x{ff}]') THEN 'iso-8859-1' ELSE 'utf-8' END END AS encoding, true AS same FROM (SELECT script_id, regexp_replace(content, '[^\x00-\x{ff}]', '?', 'g') AS t FROM scripts)""")
_DUPLICATES = "SELECT db, name AS script FROM (SELECT *, row_number() OVER (PARTITION BY db, version ORDER BY script_id) AS n FROM resolved WHERE kind IN ('SQL', 'PYTHON') AND version IS NOT NULL) WHERE n > 1"
_ISSUES = f"SELECT db, 1::BIGINT AS check_order, script FROM ({_DUPLICATES}) UNION ALL SELECT db, 2, script FROM history h WHERE NOT success AND NOT (type = 'REPEATABLE' AND EXISTS (SELECT 1 FROM rerun r WHERE r.verdict = 'modified' AND r.db = h.db AND r.script = h.script)) UNION ALL SELECT l.db, CASE WHEN c.script_id IS NULL THEN 4 ELSE 3 END, l.script FROM last_success l JOIN history h ON h.db = l.db AND h.installed_rank = l.installed_rank LEFT JOIN checked c ON c.db = l.db AND c.name = l.script WHERE c.script_id IS NULL OR (h.type <> 'REPEATABLE' AND l.checksum IS NOT NULL AND l.checksum <> c.file_checksum)"
query("r6_validation_issues", "history scripts", state.validation_issues, _ISSUES)
query("r6_first_failing_check", "history scripts", state.first_failing_check, f"SELECT db, min(check_order) AS check_order, min_by(n, check_order) AS n FROM (SELECT db, check_order, count(*) AS n FROM ({_ISSUES}) GROUP BY db, check_order) GROUP BY db")
_RUN = "WITH kinds AS (SELECT db, count(*) AS n, count(*) FILTER (kind NOT IN ('REPEATABLE', 'CALLBACK')) AS other FROM resolved WHERE kind <> 'UNKNOWN' AND {0} GROUP BY db), dups AS (SELECT db, count(*) AS n FROM (SELECT db, row_number() OVER (PARTITION BY db, version ORDER BY script_id) AS k FROM resolved WHERE kind IN ('SQL', 'PYTHON') AND version IS NOT NULL AND {0}) WHERE k > 1 GROUP BY db)"
_SOME = "db <> 6 AND (db <> 5 OR kind IN ('REPEATABLE', 'CALLBACK')) AND (db % 2 = 0 OR script_id % 3 = 0)"
query("r6_early_exits", "history scripts", lambda h, s: state.validation_run(h, state.resolved_scripts(s).where(_SOME)).where("ended_by IN ('no scripts', 'only repeatables', 'duplicate versions')"), _RUN.format(_SOME) + " SELECT h.db, coalesce(k.other, 0) = 0 AS success, CASE WHEN coalesce(k.n, 0) = 0 THEN 'no scripts' WHEN k.other = 0 THEN 'only repeatables' ELSE 'duplicate versions' END AS ended_by, CASE WHEN coalesce(k.other, 0) = 0 THEN 0 ELSE d.n END AS n FROM (SELECT DISTINCT db FROM history) h LEFT JOIN kinds k ON k.db = h.db LEFT JOIN dups d ON d.db = h.db WHERE coalesce(k.other, 0) = 0 OR d.n > 0")
query("r6_strict_run", "history scripts", lambda h, s: state.validation_run(h, s.where("script_id % 5 <> 8"), strict=True).select("db", "success", "ended_by"), f"SELECT db, false AS success, CASE WHEN EXISTS (SELECT 1 FROM ({_DUPLICATES}) d WHERE d.db = h.db) THEN 'duplicate versions' ELSE 'strict rules' END AS ended_by FROM (SELECT DISTINCT db FROM history) h")
query("r10_compatibility", "history", lambda h: state.compatibility(h.where("NOT (db = 1 AND installed_rank < 30)"), h.where("db <> 6").withColumns({"script": F.when((F.col("db") == 2) & (F.col("installed_rank") > 40), "other").otherwise(F.col("script")), "type": F.when(F.col("db").isin(0, 2, 3), F.lit("sql")).otherwise(F.col("type")), "checksum": F.when(F.col("db") == 3, F.coalesce("checksum", F.lit(0)) + F.when(F.col("installed_rank") > 90, 1).otherwise(0)).otherwise(F.col("checksum"))})), """WITH f AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY installed_rank, script) AS pos FROM history WHERE NOT (db = 1 AND installed_rank < 30)),
o AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY installed_rank) AS pos FROM (SELECT db, installed_rank, version, CASE WHEN db IN (0, 2, 3) THEN 'SQL' ELSE type END AS type, CASE WHEN db = 2 AND installed_rank > 40 THEN 'other' ELSE script END AS script, CASE WHEN db = 3 THEN coalesce(checksum, 0) + CASE WHEN installed_rank > 90 THEN 1 ELSE 0 END ELSE checksum END AS checksum FROM history WHERE db <> 6)),
n AS (SELECT db, a, b FROM (SELECT db, count(*) AS a FROM f GROUP BY db) JOIN (SELECT db, count(*) AS b FROM o GROUP BY db) USING (db)),
d AS (SELECT f.db, f.pos, CASE WHEN f.version IS DISTINCT FROM o.version THEN 'version' WHEN f.type NOT IN ('SQL', 'BASELINE', 'UNDO_SQL') THEN 'foreign type' WHEN o.type NOT IN ('SQL', 'BASELINE', 'UNDO_SQL') THEN 'type' WHEN f.script <> o.script THEN 'script' WHEN nullif(f.checksum, 0) IS DISTINCT FROM nullif(o.checksum, 0) THEN 'checksum' END AS d FROM f JOIN o ON o.db = f.db AND o.pos = f.pos)
SELECT n.db, a = b AND x.p IS NULL AS compatible, CASE WHEN a = b THEN x.p END AS position, CASE WHEN a <> b THEN 'count' ELSE x.d END AS difference FROM n LEFT JOIN (SELECT db, min(pos) AS p, min_by(d, pos) AS d FROM d WHERE d IS NOT NULL GROUP BY db) x ON x.db = n.db""")
query("r7_baseline_guard", "partial_history scripts", state.may_take_baseline, "SELECT DISTINCT db FROM scripts WHERE db NOT IN (SELECT db FROM partial_history)")
query("r8_marked_as_executed", "history scripts", state.marked_as_executed, f"SELECT p.db, coalesce(top, 0) + row_number() OVER (PARTITION BY p.db ORDER BY {_KEY}, name, script_id) AS installed_rank, version, kind AS type, name AS script FROM pending p LEFT JOIN (SELECT db, max(installed_rank) AS top FROM history GROUP BY db) t ON t.db = p.db WHERE kind <> 'REPEATABLE' AND reason IS NOT NULL AND reason <> 'below'")
query("r9_cleaned_objects", "objects", catalog.drop_order, "SELECT DISTINCT kind, lower(coalesce(schema_name, 'public')) AS schema_name, lower(name) AS name, list_position(['trigger', 'view', 'procedure', 'index', 'table', 'sequence'], kind)::BIGINT AS step FROM objects")
query("r10_missing_columns", "history", lambda h: catalog.missing_columns(h.drop("installed_on").columns, ["installed_rank", "version", "description", "type", "script", "checksum", "installed_by", "installed_on", "execution_time", "success"], h), "SELECT 'installed_on' AS column_name")
query("j11_tables_without_view", "objects", lambda o: (lambda r: r.where("kind = 'table'").select("name").join(r.where("kind = 'view'").select("name"), "name", "left_anti").distinct())(catalog.distinct_names(o)), "SELECT DISTINCT lower(name) AS name, FROM objects t WHERE kind = 'table' AND NOT EXISTS (SELECT 1 FROM objects v WHERE v.kind = 'view' AND lower(v.name) = lower(t.name))".replace("name, FROM", "name FROM"))
query("j13_has_rows", "history", lambda h: h.groupBy("db").agg(F.bool_or(F.col("type") == "BASELINE").alias("has_baseline")), "SELECT db, EXISTS (SELECT 1 FROM history b WHERE b.db = h.db AND b.type = 'BASELINE') AS has_baseline FROM (SELECT DISTINCT db FROM history) h")
query("m9_enriched_columns", "columns", lambda c: catalog.enriched_columns(c.where("side = 'a'"), c.where("side = 'b'")), "SELECT a.tab, a.col, a.type, b.d AS detail FROM columns a LEFT JOIN (SELECT tab, lower(col) AS n, min_by({'d': dflt}, pos).d AS d FROM columns WHERE side = 'b' GROUP BY ALL) b ON b.tab = a.tab AND b.n = lower(a.col) WHERE a.side = 'a'")
query("m12_without_internal", "objects", lambda o: catalog.without_internal(o, o.where("kind = 'sequence'")).select("object_id"), "SELECT object_id FROM objects o WHERE NOT EXISTS (SELECT 1 FROM objects i WHERE i.kind = 'sequence' AND lower(i.name) = lower(o.name))")
query("x3_same_constraints", "constraints", lambda c: catalog.same_constraints(c.where("pos <> 1"), c.where("pos <> 2")), "SELECT * FROM (SELECT tab, type, lower(name) AS name, array_to_string(list_sort(list(DISTINCT col)), ',') AS columns FROM constraints WHERE pos <> 1 GROUP BY ALL) INTERSECT SELECT * FROM (SELECT tab, type, lower(name), array_to_string(list_sort(list(DISTINCT col)), ',') FROM constraints WHERE pos <> 2 GROUP BY ALL)")
query("x6_line_diff", "scripts", lambda s: textdiff.counted_lines(s, F.col("content"), F.regexp_replace("content", r"\n[A-Z]", "\n")))
query("g2_mentions", "statements objects", lambda s, o: graph.mentions(s, o.select(F.concat(F.lit("TAB"), (F.col("object_id") % 5).cast("string")).alias("name"))), "SELECT stmt_id, 'tab' || (stmt_id % 7)::VARCHAR AS name FROM statements WHERE stmt_id % 7 < 5 AND regexp_matches(lower(sql_text), '\\btab[0-4]\\b')")
query("g3_object_edges", "objects", lambda o: graph.implied_edges(o.withColumn("name", F.concat(F.lit("Obj"), (F.col("object_id") % 50).cast("string")))), "SELECT DISTINCT s || '.' || o.kind || '.' || n AS src, s || '.table.' || n AS dst FROM (SELECT kind, lower(coalesce(schema_name, 'public')) AS s, 'obj' || (object_id % 50)::VARCHAR AS n FROM objects WHERE kind IN ('index', 'trigger')) o JOIN (SELECT DISTINCT lower(coalesce(schema_name, 'public')) AS s, 'obj' || (object_id % 50)::VARCHAR AS n FROM objects WHERE kind = 'table') t USING (s, n)")
query("n4_equivalent_types", "types", lambda t: t.select("type_id", types.equivalent_types(F.col("type_name"), "postgresql", F.lit("NUMBER(10,0)"), "oracle").alias("equivalent")), f"SELECT type_id, {_FAMILY} = 'INTEGER' OR type_name = 'serial' AS equivalent FROM types")

# Imports, identities, display
query("s14_imported_history", "history", lambda h: coerced_history(h.select(F.col("installed_rank").cast("string").alias("INSTALLED_RANK"), F.col("version").alias("Version"), F.col("type").alias("TYPE"), F.col("script").alias("SCRIPT"), F.concat(F.col("checksum").cast("string"), F.when(F.col("installed_rank") % 3 == 0, "x").otherwise("")).alias("checksum"), F.when(F.col("success"), "1").otherwise(F.col("success").cast("string")).alias("Success"))).select("installed_rank", "version", "type", "script", "checksum", "execution_time", "success"), "SELECT installed_rank, version, type, script, CASE WHEN installed_rank % 3 <> 0 THEN checksum END AS checksum, 0 AS execution_time, coalesce(success, false) AS success FROM history")
query("f6_named_columns", "history", lambda h: h.selectExpr("INSTALLED_RANK AS installed_rank", "Script AS script"), "SELECT installed_rank, script FROM history")
query("x1_object_identity", "objects", lambda o: o.groupBy("kind", F.lower("name").alias("name"), F.lower("schema_name").alias("schema_name")).agg(F.count(F.lit(1)).alias("n"), F.min("object_id").alias("first_id")), "SELECT kind, lower(name) AS name, lower(schema_name) AS schema_name, count(*) AS n, min(object_id) AS first_id FROM objects GROUP BY ALL")
query("x2_same_columns", "columns", lambda c: (lambda a, b: a.join(b, (a.tab == b.tab2) & (a.name == b.name2) & (a.t == b.t2) & a.dflt.eqNullSafe(b.dflt2)).select("tab", "name"))(c.where("side = 'a'").select("tab", F.lower("col").alias("name"), F.lower("type").alias("t"), "dflt"), c.where("side = 'b'").select(F.col("tab").alias("tab2"), F.lower("col").alias("name2"), F.lower("type").alias("t2"), F.col("dflt").alias("dflt2"))), "SELECT a.tab, lower(a.col) AS name FROM columns a JOIN columns b ON a.side = 'a' AND b.side = 'b' AND a.tab = b.tab AND lower(a.col) = lower(b.col) AND lower(a.type) = lower(b.type) AND a.dflt IS NOT DISTINCT FROM b.dflt")
query("x5_without_default_flags", "columns", lambda c: c.select("tab", "side", "col", F.nullif("dflt", F.lit("0")).alias("dflt"), F.when(F.col("nullable"), None).otherwise(F.lit("NOT NULL")).alias("flag")), "SELECT tab, side, col, nullif(dflt, '0') AS dflt, CASE WHEN NOT nullable THEN 'NOT NULL' END AS flag FROM columns")
query("x8_lookup_names", "objects", lambda o: o.select("object_id", F.upper("name").alias("oracle_name"), F.lower("name").alias("postgresql_name")), "SELECT object_id, upper(name) AS oracle_name, lower(name) AS postgresql_name FROM objects")
query("u6_reversed_comments", "statements", lambda s: s.select("stmt_id", display.reversed_comment(F.when(F.col("stmt_id") % 2 == 0, F.concat(F.lit("COMMENT ON TABLE t IS '"), F.replace("sql_text", F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.col("sql_text"))).alias("undo_sql")).where("undo_sql IS NOT NULL"), "SELECT stmt_id, 'COMMENT ON TABLE t IS NULL' AS undo_sql FROM statements WHERE stmt_id % 2 = 0")
query("d_durations", "history", lambda h: h.select("installed_rank", display.duration(F.col("execution_time") * F.col("installed_rank") % 200_000).alias("shown")), "SELECT installed_rank, CASE WHEN ms < 1000 THEN ms::VARCHAR || 'ms' WHEN ms < 60000 THEN ((ms + 5) // 1000)::VARCHAR || '.' || lpad(((ms + 5) // 10 % 100)::VARCHAR, 2, '0') || 's' ELSE (ms // 60000)::VARCHAR || 'm ' || (ms % 60000 // 1000)::VARCHAR || 's' END AS shown FROM (SELECT installed_rank, execution_time * installed_rank % 200000 AS ms FROM history)")
query("d_shortened_names", "scripts", lambda s: s.select("script_id", display.shortened(F.col("name"), 12).alias("shown")), "SELECT script_id, CASE WHEN length(name) > 12 THEN substr(name, 1, 9) || '...' ELSE name END AS shown FROM scripts")
query("d_masked_addresses", "objects", lambda o: o.select("object_id", display.masked(F.concat(F.lit("postgresql://u"), F.col("object_id").cast("string"), F.lit(":s3cr@et/"), F.col("name"), F.lit("?password=x&a=1"))).alias("shown")), "SELECT object_id, 'postgresql://u' || object_id::VARCHAR || ':***@et/' || name || '?password=***&a=1' AS shown FROM objects")
