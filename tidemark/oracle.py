"""DuckDB text for the relations and for expressions that several queries need."""

from __future__ import annotations

from .functions.scripts import CALLBACKS
from .relations import SQL


def key(version: str) -> str:
    """Version key of a text expression."""
    parts = f"""list_transform(str_split_regex(regexp_replace({version}, '^\\s+|\\s+$', '', 'g'), '[._]'), lambda x: CASE
      WHEN x = '' THEN {{'k': 0, 'n': 0::HUGEINT, 't': ''}}
      WHEN regexp_full_match(x, '[0-9]+[A-Za-z]*') THEN {{'k': 0, 'n': TRY_CAST(regexp_extract(x, '^([0-9]+)', 1) AS HUGEINT), 't': lower(regexp_extract(x, '^[0-9]+([A-Za-z]*)$', 1))}}
      ELSE {{'k': 1, 'n': 0::HUGEINT, 't': lower(x)}} END)"""
    return f"""(CASE WHEN {version} IS NULL THEN NULL ELSE list_transform([{parts}], lambda p: p[1:len(p) - coalesce(list_position(list_transform(list_reverse(p), lambda e: NOT (e.k = 0 AND e.n = 0 AND e.t = '')), true), len(p) + 1) + 1])[1] END)"""


def numbers(version: str) -> str:
    return f"list_transform(str_split_regex({version}, '[._]'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::HUGEINT ELSE 0::HUGEINT END)"


#: The 256 remainders of CRC-32, and the signed checksum of a text without line ends.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"


def crc(text: str, table: str) -> str:
    pairs = f"regexp_extract_all(hex(encode(regexp_replace({text}, '[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', '', 'g'))), '..')"
    value = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({pairs}, lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
    return f"list_transform([{value}], lambda u: CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END)[1]"


_CALLBACK = "|".join(c.lower() for c in CALLBACKS)
_NAMED = "([A-Za-z0-9]+(?:[._][A-Za-z0-9]+)*)__(.+)$"
_ENDING = "(?i)\\.(sql|py|js|cypher|cql|gremlin|json|yaml|yml)$"
_RESOLVED = f"""
SELECT db, script_id, name, content, kind, named_kind, CASE WHEN named_kind IN ('SQL', 'UNDO_SQL') THEN CASE WHEN regexp_full_match(raw, '[0-9_.]+') THEN replace(raw, '_', '.') ELSE raw END END AS version,
  CASE WHEN named_kind IN ('SQL', 'UNDO_SQL') THEN regexp_extract(stem, '^[VU]{_NAMED}', 2) WHEN named_kind = 'REPEATABLE' THEN regexp_extract(stem, '^R__(.*)$', 1) ELSE stem END AS description,
  list_filter(list_transform(string_split(regexp_extract(name, '\\[([^\\]]*)\\]', 1), ','), lambda t: trim(t)), lambda t: t <> '') AS tags
FROM (SELECT *, nullif(regexp_extract(stem, '^[VU]{_NAMED}', 1), '') AS raw,
   CASE WHEN NOT regexp_matches(bare, '{_ENDING}') THEN 'UNKNOWN' WHEN regexp_matches(lower(stem), '^({_CALLBACK})') THEN 'CALLBACK'
     WHEN stem = 'V__' OR regexp_matches(stem, '^V{_NAMED}') THEN 'SQL' WHEN regexp_matches(stem, '^U{_NAMED}') THEN 'UNDO_SQL' WHEN regexp_matches(stem, '^R__.') THEN 'REPEATABLE' ELSE 'UNKNOWN' END AS named_kind,
   CASE WHEN regexp_matches(lower(name), '^({_CALLBACK})') THEN 'CALLBACK' WHEN regexp_matches(lower(name), '^v[0-9]') THEN 'SQL' WHEN regexp_matches(lower(name), '^u[0-9]') THEN 'UNDO_SQL'
     WHEN regexp_matches(lower(name), '^b[0-9]') THEN 'BASELINE' WHEN lower(name) LIKE 'r\\_\\_%' ESCAPE '\\' THEN 'REPEATABLE' ELSE 'UNKNOWN' END AS kind
  FROM (SELECT *, regexp_replace(bare, '{_ENDING}', '') AS stem FROM (SELECT *, CASE WHEN name LIKE '%[%]%' THEN replace(name, regexp_extract(name, '\\[.*?\\]'), '') ELSE name END AS bare FROM scripts)))
"""

# Names that objects state or that their texts hold, each with the objects it may mean, nearest schema first.
_ASKED = r"""
SELECT kind, lower(coalesce(schema_name, 'public')) AS s, lower(name) AS n, via, lower(ref_schema) AS rs, lower(ref_name) AS rn FROM "references"
UNION SELECT kind, s, n, kind || '_text', CASE WHEN contains(ref, '.') THEN split_part(ref, '.', 1) END, split_part(ref, '.', -1)
FROM (SELECT kind, lower(coalesce(schema_name, 'public')) AS s, lower(name) AS n, lower(unnest(regexp_extract_all(sql_text, '(?i)\b(?:FROM|JOIN)\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)', 1))) AS ref FROM definitions WHERE kind IN ('view', 'procedure'))
"""
_GRAPH = f"""
SELECT DISTINCT s || '.' || kind || '.' || n AS src, CASE WHEN best IS NULL THEN coalesce(rs, s) || '.' || CASE via WHEN 'calls' THEN 'procedure' WHEN 'follows' THEN 'trigger' ELSE 'table' END || '.' || rn ELSE best END AS dst, via, best IS NOT NULL AS found
FROM (
  SELECT a.*, (SELECT t.ts || '.' || t.k || '.' || t.tn FROM (SELECT DISTINCT kind AS k, lower(coalesce(schema_name, 'public')) AS ts, lower(name) AS tn FROM definitions) t
    WHERE t.tn = a.rn AND CASE a.via WHEN 'calls' THEN t.k = 'procedure' WHEN 'follows' THEN t.k = 'trigger' WHEN 'view_text' THEN t.k IN ('view', 'table') ELSE t.k = 'table' END AND CASE WHEN a.rs IS NOT NULL THEN t.ts = a.rs ELSE t.ts IN (a.s, 'public') END
    ORDER BY t.ts <> a.s, t.k = 'table' LIMIT 1) AS best
  FROM ({_ASKED}) a)
"""

VIEWS = dict(SQL) | {
    "object_graph": _GRAPH,
    "resolved": _RESOLVED,
    "crc_table": f"SELECT {CRC_TABLE} AS tb",
    "checked": f"SELECT r.*, {crc('content', 'tb')} AS file_checksum FROM resolved r, crc_table",
    "ranks": """SELECT db, version, min(installed_rank) FILTER (type = 'UNDO_SQL' AND success) AS first_undo, max(installed_rank) FILTER (type = 'UNDO_SQL' AND success) AS last_undo,
       max(installed_rank) FILTER (type IN ('SQL', 'PYTHON')) AS last_any, max(installed_rank) FILTER (type IN ('SQL', 'PYTHON') AND success) AS last_ok, count(*) FILTER (success) AS n_ok
       FROM history WHERE coalesce(version, '') <> '' GROUP BY db, version""",
    "undone": "SELECT db, version, last_undo FROM ranks WHERE last_undo >= coalesce(last_ok, 0)",
    "current": f"SELECT db, max_by(version, {{'k': {key('version')}, 'r': -installed_rank}}) AS current_version FROM history WHERE success AND type IN ('SQL', 'PYTHON', 'BASELINE') AND coalesce(version, '') <> '' GROUP BY db",
    "baseline": "SELECT db, min_by(version, installed_rank) AS baseline_version FROM history WHERE type = 'BASELINE' GROUP BY db",
    "repeatable": "SELECT db, script, max_by({'c': checksum}, installed_rank).c AS checksum FROM history WHERE type = 'REPEATABLE' AND success GROUP BY db, script",
    "last_success": "SELECT db, script, max(installed_rank) AS installed_rank, max_by({'c': checksum}, installed_rank).c AS checksum FROM history WHERE success AND type NOT IN ('DELETE', 'UNDO_SQL') GROUP BY db, script",
    "pending": f"""SELECT r.db, script_id, name, kind, r.version,
          CASE WHEN u.version IS NOT NULL THEN 'undone' WHEN v.version IS NOT NULL OR n.script IS NOT NULL THEN NULL
               WHEN coalesce({key('r.version')} <= {key('current_version')}, false) OR coalesce({key('r.version')} <= {key('baseline_version')}, false) THEN 'below' ELSE 'new' END AS reason
        FROM resolved r LEFT JOIN (SELECT DISTINCT db, version FROM history WHERE type IN ('SQL', 'PYTHON', 'BASELINE') AND coalesce(version, '') <> '') v ON v.db = r.db AND v.version = r.version
        LEFT JOIN (SELECT DISTINCT db, script FROM history WHERE type IN ('SQL', 'PYTHON', 'BASELINE')) n ON n.db = r.db AND n.script = r.name
        LEFT JOIN undone u ON u.db = r.db AND u.version = r.version LEFT JOIN current c ON c.db = r.db LEFT JOIN baseline b ON b.db = r.db
        WHERE kind IN ('SQL', 'PYTHON') AND r.version IS NOT NULL
        UNION ALL
        SELECT r.db, script_id, name, kind, r.version, CASE WHEN p.script IS NULL THEN 'new' WHEN p.checksum <> r.file_checksum THEN 'changed' END
        FROM checked r LEFT JOIN repeatable p ON p.db = r.db AND p.script = r.name WHERE kind = 'REPEATABLE'""",
    # Whatever was undone once is shown as undone, or as a success if a versioned row came after the first undo and one succeeded.
    "undone_once": """SELECT u.db, u.version, bool_or(coalesce(h.success, false)) AND max(h.installed_rank) > any_value(u.first) AS again
        FROM (SELECT db, version, min(installed_rank) AS first FROM history WHERE type = 'UNDO_SQL' AND success AND version <> '' GROUP BY db, version) u
        LEFT JOIN history h ON h.db = u.db AND h.version = u.version AND h.type IN ('SQL', 'PYTHON') GROUP BY u.db, u.version""",
    "steps_back": f"""SELECT DISTINCT db, version FROM (SELECT db, version, {numbers('version')} AS own, lag({numbers('version')}) OVER (PARTITION BY db ORDER BY installed_rank) AS earlier
        FROM history WHERE type IN ('SQL', 'PYTHON') AND version <> '') WHERE own < earlier""",
    "highest_run": f"SELECT db, max({key('version')}) AS top FROM history WHERE success AND type IN ('SQL', 'PYTHON') AND version <> '' GROUP BY db",
    "shown": f"""SELECT h.*, EXISTS (SELECT 1 FROM scripts f WHERE f.db = h.db AND f.name = h.script) AS resolved, coalesce({key('h.version')} > t.top, false) AS above, o.again, b.version IS NOT NULL AS back,
          h.type = 'REPEATABLE' AND coalesce(h.checksum, 0) <> 0 AND h.checksum IS DISTINCT FROM last_value(h.checksum) OVER (PARTITION BY h.db, h.script, h.type ORDER BY h.installed_rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS old
        FROM history h LEFT JOIN highest_run t ON t.db = h.db LEFT JOIN undone_once o ON o.db = h.db AND o.version = h.version LEFT JOIN steps_back b ON b.db = h.db AND b.version = h.version""",
    "states": """SELECT *, CASE WHEN type = 'DELETE' THEN 'Deleted' WHEN type = 'BASELINE' THEN 'Baseline' WHEN success IS NULL THEN 'Needs repair'
          WHEN NOT success THEN 'Failed' || CASE WHEN resolved THEN '' WHEN above THEN ' (Future)' ELSE ' (Missing)' END
          WHEN type = 'UNDO_SQL' OR again THEN 'Success' WHEN NOT again THEN 'Undone' WHEN back THEN 'Out of Order' WHEN old THEN 'Outdated' WHEN resolved THEN 'Success' WHEN above THEN 'Future' ELSE 'Missing' END AS state FROM shown""",
    "labels": """SELECT *, CASE WHEN type = 'DELETE' AND regexp_extract(description, '^\\[DELETE:([A-Z_]+)\\]', 1) <> '' THEN regexp_extract(description, '^\\[DELETE:([A-Z_]+)\\]', 1) ELSE type END AS label,
          trim(regexp_replace(description, '^\\[DELETE:[A-Z_]+\\]', '')) AS cleaned FROM states""",
    "synthetic_undos": """SELECT u.db, u.version, coalesce((SELECT cleaned FROM labels l WHERE l.db = u.db AND replace(l.version, '_', '.') = u.version AND l.type IN ('SQL', 'PYTHON') ORDER BY installed_rank LIMIT 1), 'Undo migration ' || u.version) AS description
        FROM (SELECT DISTINCT db, version FROM history WHERE type = 'UNDO_SQL' AND success AND version <> '') u WHERE EXISTS (SELECT 1 FROM scripts s WHERE s.db = u.db AND starts_with(s.name, 'U' || u.version) AND s.name LIKE '%.sql')""",
    "rerun": """SELECT * FROM (SELECT c.db, c.script_id, c.name AS script, CASE WHEN s = false AND coalesce(k = file_checksum, false) THEN 'error' WHEN NOT coalesce(k = file_checksum, false) THEN 'modified' END AS verdict
        FROM checked c JOIN (SELECT db, script, max_by({'s': success}, installed_rank).s AS s, max_by({'k': checksum}, installed_rank).k AS k FROM history WHERE type = 'REPEATABLE' GROUP BY db, script) h ON h.db = c.db AND h.script = c.name
        WHERE c.kind = 'REPEATABLE') WHERE verdict IS NOT NULL""",
    "without_file": "SELECT db, installed_rank, script FROM history h WHERE success AND type NOT IN ('DELETE', 'BASELINE', 'UNDO_SQL') AND NOT EXISTS (SELECT 1 FROM scripts s WHERE s.db = h.db AND s.name = h.script)",
    "drifted": "SELECT c.db, c.script_id, c.name, r.checksum AS previous, c.file_checksum AS current FROM checked c JOIN repeatable r ON r.db = c.db AND r.script = c.name WHERE c.kind = 'REPEATABLE' AND r.checksum <> 0 AND r.checksum <> c.file_checksum",
    "drifted_sql": "SELECT c.db, c.name AS script, c.file_checksum, min(h.installed_rank) AS installed_rank FROM history h JOIN checked c ON c.db = h.db AND c.name = h.script WHERE h.type = 'SQL' AND h.checksum IS NOT NULL AND h.checksum <> c.file_checksum GROUP BY ALL",
}


def category(label: str) -> str:
    return f"CASE {label} WHEN 'SQL' THEN 'Versioned' WHEN 'PYTHON' THEN 'Versioned' WHEN 'REPEATABLE' THEN 'Repeatable' WHEN 'UNDO_SQL' THEN 'Undo' WHEN 'BASELINE' THEN 'Baseline' ELSE 'Deleted' END"


# Type names of the fixture: family, spelling where no dialect says otherwise, and spellings of dialects.
TYPES = (
    ("VARCHAR2(30)", "VARCHAR", "VARCHAR2(30)", {"oracle": "VARCHAR(30)"}),
    ("NUMBER(10,2)", "NUMERIC", "NUMBER(10,2)", {}),
    ("NUMBER(10,0)", "INTEGER", "NUMBER(10,0)", {}),
    ("TINYINT(1)", "SMALLINT", "TINYINT(1)", {"mysql": "BOOLEAN", "mariadb": "BOOLEAN"}),
    ("int4", "INTEGER", "INT4", {"postgresql": "INTEGER"}),
    ("timestamp(6)", "TIMESTAMP", "TIMESTAMP", {}),
    ("DATETIME2(7)", "TIMESTAMP", "DATETIME", {}),
    ("bool", "BOOLEAN", "BOOL", {"postgresql": "BOOLEAN", "mysql": "BOOLEAN", "mariadb": "BOOLEAN"}),
    ("TEXT", "TEXT", "TEXT", {"sqlserver": "VARCHAR"}),
    ("DOUBLE", "DOUBLE", "DOUBLE", {"postgresql": "DOUBLE PRECISION", "sqlite": "REAL"}),
    ("bytea", "BLOB", "BYTEA", {}),
    ("INT8", "BIGINT", "INT8", {"postgresql": "BIGINT"}),
    ("CHAR(3)", "CHAR", "CHAR(3)", {}),
    ("uuid", "UUID", "UUID", {}),
    ("NUMERIC(18, 4)", "NUMERIC", "NUMERIC(18,4)", {}),
    ("serial", "SERIAL", "SERIAL", {"postgresql": "INTEGER"}),
    ("NUMBER(10)", "INTEGER", "NUMBER(10)", {}),
    ("NUMERIC(18, 0)", "NUMERIC", "NUMERIC(18,0)", {}),
    ("NUMERIC(18,0)", "INTEGER", "NUMERIC(18,0)", {}),
    ("JSONB", "JSON", "JSONB", {}),
    ("timestamptz", "TIMESTAMP", "TIMESTAMPTZ", {"postgresql": "TIMESTAMP WITH TIME ZONE"}),
    ("MEDIUMINT", "INTEGER", "MEDIUMINT", {}),
    ("UNIQUEIDENTIFIER", "UUID", "UNIQUEIDENTIFIER", {}),
    ("NUMBER(20)", "NUMERIC", "NUMBER(20)", {}),
)


def type_case(value) -> str:
    """A CASE over the fixture's type names, with ``value`` of each row of ``TYPES``."""
    return "CASE type_name " + " ".join(f"WHEN '{row[0]}' THEN '{value(row)}'" for row in TYPES) + " END"


def with_views(query: str) -> str:
    """``query`` with all relations that it needs, directly or through others, before it."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf'\b(FROM|JOIN|,)\s+"?{name}\b', text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    recursive = "RECURSIVE " if "RECURSIVE" in query else ""
    body = query.replace("WITH RECURSIVE ", "")
    if recursive:
        return "WITH RECURSIVE " + "".join(f'"{n}" AS ({VIEWS[n]}),\n' for n in needed) + body
    if query.startswith("WITH "):
        return "WITH " + "".join(f'"{n}" AS ({VIEWS[n]}),\n' for n in needed) + query.removeprefix("WITH ")
    return ("WITH " + ",\n".join(f'"{n}" AS ({VIEWS[n]})' for n in needed) + "\n" if needed else "") + query
