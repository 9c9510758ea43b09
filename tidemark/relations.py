"""Migration-shaped relations over the provided tables.

They are synthetic: deterministic projections in SQL that Spark and DuckDB read alike, so
that each operator and its counterpart see the same rows.  A fleet of databases is in one
table: ``db`` names the database that a row belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HISTORY = """
SELECT db, installed_rank, CASE WHEN type = 'REPEATABLE' THEN NULL ELSE version END AS version,
       CASE WHEN type = 'DELETE' THEN '[DELETE:SQL] step ' || CAST(event_id % 17 AS STRING) ELSE 'step ' || CAST(event_id % 17 AS STRING) END AS description,
       type,
       CASE WHEN type = 'REPEATABLE' THEN 'R__view_' || CAST(user_id % 25 AS STRING) || '.sql'
            WHEN type = 'UNDO_SQL' THEN 'U' || version || '__undo.sql'
            WHEN type = 'BASELINE' THEN 'B' || version || '__baseline.sql'
            WHEN type = 'PYTHON' THEN 'V' || version || '__step.py'
            ELSE 'V' || version || '__step.sql' END AS script,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST((event_id * 7919) % 5 AS INT) END AS checksum,
       'user' || CAST(user_id % 3 AS STRING) AS installed_by,
       CAST((event_id * 31) % 997 AS INT) AS execution_time, success,
       CASE WHEN success IS NOT NULL THEN CAST('2024-0' || CAST(event_id % 9 + 1 AS STRING) || '-' || CAST(event_id % 19 + 10 AS STRING) AS DATE) END AS installed_on
FROM (
  SELECT event_id, user_id, CAST(user_id % 7 AS BIGINT) AS db, CAST(event_id + 1 AS BIGINT) AS installed_rank,
         CASE WHEN event_id % 499 = 0 THEN '90.' ELSE CAST(user_id % 40 AS STRING) || '.' END || CAST(event_id % 5 AS STRING) AS version,
         CASE WHEN event_id % 997 = 0 THEN 'BASELINE' WHEN event_id % 101 = 0 THEN 'DELETE'
              WHEN event_type = 'error' THEN 'UNDO_SQL' WHEN event_type = 'signup' THEN 'REPEATABLE'
              WHEN event_type = 'click' THEN 'PYTHON' ELSE 'SQL' END AS type,
         CASE WHEN event_id % 13 = 0 OR event_id % 499 = 0 THEN false WHEN event_id % 29 = 0 THEN NULL ELSE true END AS success
  FROM events
) e
"""

SCRIPTS = """
SELECT CAST(doc_id % 7 AS BIGINT) AS db, doc_id AS script_id, text AS content,
       CASE WHEN doc_id % 10 <= 4 THEN 'V' || v || '__step.sql'
            WHEN doc_id % 10 = 5 THEN 'V' || v || '__step[' || lang || ', ' || source || CASE WHEN doc_id % 20 = 15 THEN '][x].sql' ELSE '].sql' END
            WHEN doc_id % 10 = 6 THEN 'U' || v || '__undo.sql'
            WHEN doc_id % 10 = 7 THEN 'R__view_' || CAST(doc_id % 25 AS STRING) || '.sql'
            WHEN doc_id % 10 = 8 THEN 'V' || v || 'b__step.py'
            WHEN doc_id % 50 = 9 THEN 'beforeEachMigrate__' || CAST(doc_id % 3 AS STRING) || '.sql'
            WHEN doc_id % 50 = 19 THEN 'notes.txt'
            WHEN doc_id % 50 = 29 THEN 'VA__x.sql'
            WHEN doc_id % 50 = 39 THEN 'V__.sql'
            ELSE 'B' || v || '__base.sql' END AS name
FROM (SELECT doc_id, text, lang, source,
             CAST(doc_id % 41 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '_' ELSE '.' END || CAST(doc_id % 5 AS STRING) AS v
      FROM documents) d
"""

JOURNAL = """
SELECT l_orderkey AS migration_id, CAST(l_linenumber AS BIGINT) AS statement_index, CAST(l_quantity AS BIGINT) * 3 % 50 AS execution_time,
       l_returnflag <> 'R' AS success, 'stmt ' || CAST(l_partkey AS STRING) AS statement, l_linestatus AS object_type,
       'obj' || CAST(l_suppkey % 10 AS STRING) AS object_name
FROM lineitem
"""

#: Messages of failed statements: seven for each dialect, with the name of the exception where that says more.
_MESSAGES = {
    "postgresql": (("ERROR SQLSTATE 08006", ""), ("SQLSTATE 57P01 shutdown", ""), ("sqlstate 40P01 deadlock", ""), ("SQLSTATE 42601 at or near", ""), ("SQLSTATE 57014", ""), ("permission denied", ""), ("odd", "TimeoutError")),
    "oracle": (("ORA-12541: no listener", ""), ("ORA-12170: connect timeout", ""), ("ORA-00054: busy", ""), ("ora-00942", ""), ("ORA-01653: unable to extend", ""), ("ORA-99999", ""), ("broken  pipe", "")),
    "mysql": (("2006 MySQL server has gone away", ""), ("1205 Lock wait timeout exceeded", ""), ("Lock wait timeout exceeded", ""), ("1062 Duplicate entry", ""), ("12062 Duplicate entry", ""), ("1054 Unknown column", ""), ("1045 Access denied", "")),
    "db2": (("SQLSTATE=08001", ""), ("lost", "DisconnectException"), ("SQL0911N rolled back", ""), ("sqlstate=23505", ""), ("sqlstate=57014", ""), ("x", "Y"), ("Communication  error", "")),
    "any": (("Connection timed out", ""), ("DEADLOCK found", ""), ("permission denied for t", ""), ("Statement timeout", ""), ("syntax error", ""), ("Broken  pipe", ""), ("authentication failed", "")),
}
_CASE = lambda values: "CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
ERROR_MESSAGES = " UNION ALL ".join(
    f"SELECT migration_id, statement_index, execution_time, k, '{dialect}' AS dialect, {_CASE([m for m, _ in cases])} AS message, {_CASE([x for _, x in cases])} AS exception "
    f"FROM (SELECT *, (migration_id + statement_index) % 7 AS k FROM ({JOURNAL}) j) e"
    for dialect, cases in _MESSAGES.items()
)

EDGES = """
SELECT 'public.table.t' || CAST(s_suppkey AS STRING) AS src, 'public.table.t' || CAST(CAST(floor(s_suppkey / 2.0) AS BIGINT) AS STRING) AS dst
FROM supplier WHERE s_suppkey >= 2
UNION ALL SELECT 'public.view.v' || CAST(n_nationkey AS STRING), 'public.table.t' || CAST(n_nationkey + 1 AS STRING) FROM nation
UNION ALL SELECT 'public.view.v' || CAST(n_nationkey AS STRING), 'public.view.v' || CAST(n_regionkey + 100 AS STRING) FROM nation
"""

CYCLIC_EDGES = """
SELECT 'n' || CAST(n_nationkey AS STRING) AS src, 'n' || CAST((n_nationkey * 3 + 1) % 25 AS STRING) AS dst FROM nation
"""

# Rings of seven with chords, ways in, out and on to the next ring, and nodes that need themselves.
TANGLED_EDGES = """
SELECT 'm' || CAST(s_suppkey AS STRING) AS src, 'm' || CAST(CAST(floor(s_suppkey / 7.0) AS BIGINT) * 7 + (s_suppkey + 1) % 7 AS STRING) AS dst FROM supplier
UNION ALL SELECT 'm' || CAST(s_suppkey AS STRING), 'm' || CAST(CAST(floor(s_suppkey / 7.0) AS BIGINT) * 7 + (s_suppkey * 3) % 7 AS STRING) FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'm' || CAST(s_suppkey AS STRING), 'm' || CAST(s_suppkey + 7 AS STRING) FROM supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT 'q' || CAST(s_suppkey AS STRING), 'm' || CAST(s_suppkey AS STRING) FROM supplier
UNION ALL SELECT 'm' || CAST(s_suppkey AS STRING), 'r' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'q' || CAST(s_suppkey AS STRING), 'q' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 6 = 0
"""

# One chain and a ladder beside it: a node for each order.
LONG_EDGES = """
SELECT 'c' || CAST(o_orderkey AS STRING) AS src, 'c' || CAST(o_orderkey + 1 AS STRING) AS dst FROM orders
UNION ALL SELECT 'c' || CAST(o_orderkey AS STRING), 'leaf' || CAST(o_orderkey AS STRING) FROM orders WHERE o_orderkey % 50 = 0
"""

DEFINITIONS = """
SELECT kind, schema_name, 'Obj' || CAST(k AS STRING) AS name,
       CASE kind WHEN 'view' THEN 'SELECT * FROM Obj' || CAST((k * 7 + 5) % 300 AS STRING) || ' a JOIN sales.obj' || CAST((k * 5 + 2) % 300 AS STRING) || ' b ON a.id = b.id JOIN Elsewhere c ON c.id = a.id'
            WHEN 'procedure' THEN 'BEGIN INSERT INTO t SELECT * FROM hr.OBJ' || CAST((k + 1) % 300 AS STRING) || '; DELETE FROM Obj' || CAST((k + 7) % 300 AS STRING) || '; END' END AS sql_text
FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'view' WHEN 2 THEN 'index' WHEN 3 THEN 'sequence' WHEN 4 THEN 'trigger' ELSE 'procedure' END AS kind,
             CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN 'Sales' ELSE 'hr' END AS schema_name, c_custkey % 300 AS k FROM customer) c
"""

_STATED = "SELECT {0} AS kind, schema_name, name, {1} AS via, {2} AS ref_schema, 'Obj' || CAST((CAST(substring(name, 4) AS BIGINT) {3}) % 300 AS STRING) AS ref_name FROM ({4}) d WHERE kind = {0}"
REFERENCES = " UNION ALL ".join(
    _STATED.format(f"'{kind}'", f"'{via}'", schema, shift, DEFINITIONS)
    for kind, via, schema, shift in (
        ("table", "foreign_key", "CASE WHEN name LIKE '%2' THEN 'SALES' END", "* 5"),
        ("table", "inherits", "CASE WHEN name LIKE '%4' THEN 'hr' END", "+ 12"),
        ("index", "on", "CAST(NULL AS STRING)", "+ 4"),
        ("trigger", "on", "CAST(NULL AS STRING)", "+ 2"),
        ("trigger", "calls", "CASE WHEN name LIKE '%6' THEN 'Hr' END", "+ 1"),
        ("trigger", "follows", "CAST(NULL AS STRING)", "+ 6"),
    )
)

STATEMENTS = """
SELECT p_partkey AS stmt_id,
  CASE p_partkey % 16
   WHEN 0 THEN 'CREATE TABLE s.' || t || ' (id INT)' WHEN 1 THEN '-- note' || chr(10) || 'ALTER TABLE ' || t || ' ADD COLUMN c' || n || ' INT'
   WHEN 2 THEN '/* x */ SELECT * FROM ' || t || ' a JOIN s.other b ON a.id = b.id' WHEN 3 THEN 'INSERT INTO ' || t || ' (id, name) VALUES (1, ''a;b'')'
   WHEN 4 THEN 'UPDATE ' || t || ' SET name = ''x'', price = 2 WHERE id = ' || n WHEN 5 THEN 'DELETE FROM ' || t
   WHEN 6 THEN 'MERGE INTO ' || t || ' t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = 1 WHEN NOT MATCHED THEN INSERT (id) VALUES (1)'
   WHEN 7 THEN 'insert into ' || t || ' (id) values (1) on conflict (id) do update set a = 1' WHEN 8 THEN 'DROP VIEW ' || t WHEN 9 THEN 'CREATE UNIQUE INDEX ix' || n || ' ON ' || t || ' (id)'
   WHEN 10 THEN 'GO' WHEN 11 THEN '-- only a comment' WHEN 12 THEN 'WITH x AS (SELECT 1) SELECT * FROM x' WHEN 13 THEN 'TRUNCATE TABLE ' || t
   WHEN 14 THEN 'UPDATE s.' || t || ' SET b = (1' ELSE 'EXEC proc_' || n END AS sql_text
FROM (SELECT p_partkey, 'tab' || CAST(p_partkey % 7 AS STRING) AS t, CAST(p_partkey % 5 AS STRING) AS n FROM part) p
"""

ALTERS = """
SELECT p_partkey AS stmt_id, p_partkey % 14 AS k, 'ALTER TABLE S.Tab' || CAST(p_partkey % 7 AS STRING) || CASE p_partkey % 14
   WHEN 0 THEN ' ADD COLUMN c1 INT' WHEN 1 THEN ' add column if not exists "c2" INT' WHEN 2 THEN ' ADD CONSTRAINT k1 CHECK (a > 0)' WHEN 3 THEN ' ADD CONSTRAINT k2 PRIMARY KEY (a)'
   WHEN 4 THEN ' ADD CONSTRAINT k3 FOREIGN  KEY (a) REFERENCES t (b)' WHEN 5 THEN ' ADD PRIMARY KEY (a)' WHEN 6 THEN ' DROP COLUMN c3' WHEN 7 THEN ' DROP CONSTRAINT k4' WHEN 8 THEN ' ALTER COLUMN c4 TYPE TEXT'
   WHEN 9 THEN ' MODIFY COLUMN c5 INT' WHEN 10 THEN ' RENAME TO New1' WHEN 11 THEN ' RENAME COLUMN old1 TO new2' WHEN 12 THEN ' ENABLE TRIGGER ALL' ELSE ' DROP  PRIMARY KEY' END AS sql_text
FROM part
"""

DEFINED = """
SELECT p_partkey AS stmt_id, p_partkey % 12 AS k, CASE p_partkey % 12 WHEN 0 THEN 'CREATE TABLE IF NOT EXISTS ' WHEN 1 THEN 'create or replace view ' WHEN 2 THEN 'CREATE MATERIALIZED VIEW ' WHEN 3 THEN 'CREATE UNIQUE INDEX ' WHEN 4 THEN 'DROP SEQUENCE IF EXISTS ' WHEN 5 THEN 'CREATE TRIGGER '
   WHEN 6 THEN 'CREATE OR REPLACE PROCEDURE ' WHEN 7 THEN '-- f' || chr(10) || 'CREATE FUNCTION ' WHEN 8 THEN 'CREATE TEMPORARY TABLE ' WHEN 9 THEN 'ALTER TYPE ' WHEN 10 THEN 'DROP SCHEMA ' ELSE 'SELECT ' END
   || CASE WHEN p_partkey % 5 = 0 THEN 'x.' WHEN p_partkey % 5 = 1 THEN '"Y".' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '"Obj1"' ELSE 'obj2' END || ' rest of it' AS sql_text
FROM part
"""

OPTIONS = """
SELECT 't' || CAST(s_suppkey % 30 AS STRING) AS tab, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, CASE s_suppkey % 3 WHEN 0 THEN 'Temporary' WHEN 1 THEN 'tablespace' ELSE 'system_versioned' END AS option,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'v' || CAST(s_suppkey % 4 AS STRING) END AS value FROM supplier
UNION ALL SELECT 't' || CAST(s_suppkey % 30 AS STRING), 'b', 'temporary', 'v' || CAST(s_suppkey % 4 AS STRING) FROM supplier WHERE s_suppkey % 2 = 0
"""

BATCHES = """
SELECT o_orderkey AS script_id, 'SELECT ' || CAST(o_custkey AS STRING) || chr(10) || 'GO' || chr(10) || 'INSERT INTO t VALUES (' || CAST(o_orderkey AS STRING) || ');' || chr(10) || '  go -- next' || chr(10)
   || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || 'GO' || chr(10) ELSE 'DELETE FROM $' || '{tab:orders} WHERE s = ''$' || '{state}''' END AS content, o_orderstatus AS state
FROM orders
"""

TYPES = """
SELECT p_partkey AS type_id, p_partkey % 8 AS d,
  CASE p_partkey % 24 WHEN 0 THEN 'VARCHAR2(30)' WHEN 1 THEN 'NUMBER(10,2)' WHEN 2 THEN 'NUMBER(10,0)' WHEN 3 THEN 'TINYINT(1)' WHEN 4 THEN 'int4' WHEN 5 THEN 'timestamp(6)'
   WHEN 6 THEN 'DATETIME2(7)' WHEN 7 THEN 'bool' WHEN 8 THEN 'TEXT' WHEN 9 THEN 'DOUBLE' WHEN 10 THEN 'bytea' WHEN 11 THEN 'INT8' WHEN 12 THEN 'CHAR(3)' WHEN 13 THEN 'uuid'
   WHEN 14 THEN 'NUMERIC(18, 4)' WHEN 15 THEN 'serial' WHEN 16 THEN 'NUMBER(10)' WHEN 17 THEN 'NUMERIC(18, 0)' WHEN 18 THEN 'NUMERIC(18,0)' WHEN 19 THEN 'JSONB' WHEN 20 THEN 'timestamptz'
   WHEN 21 THEN 'MEDIUMINT' WHEN 22 THEN 'UNIQUEIDENTIFIER' ELSE 'NUMBER(20)' END AS type_name
FROM part
"""

COLUMNS = """
SELECT 't' || CAST(s_suppkey % 20 AS STRING) AS tab, 'a' AS side, 'C' || CAST(s_suppkey AS STRING) AS col, CASE WHEN s_suppkey % 4 = 0 THEN 'INT' ELSE 'VARCHAR' END AS type, s_suppkey % 3 = 0 AS nullable,
       CASE WHEN s_suppkey % 5 = 0 THEN '0' END AS dflt, s_suppkey AS pos FROM supplier WHERE s_suppkey % 11 <> 0
UNION ALL
SELECT 't' || CAST(s_suppkey % 20 AS STRING), 'b', 'c' || CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 6 = 0 THEN 'INT' ELSE 'VARCHAR' END, s_suppkey % 6 = 0, CASE WHEN s_suppkey % 10 = 0 THEN '0' END, s_suppkey FROM supplier WHERE s_suppkey % 13 <> 0
"""

OBJECTS = """
SELECT CASE c_custkey % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'view' WHEN 2 THEN 'index' WHEN 3 THEN 'sequence' WHEN 4 THEN 'trigger' ELSE 'procedure' END AS kind,
       CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN 'Sales' ELSE 'hr' END AS schema_name, 'Obj' || CAST(c_custkey % 300 AS STRING) AS name,
       CAST(c_custkey % 9 AS BIGINT) AS captured, CAST(c_custkey % 9 + c_custkey % 2 AS BIGINT) AS total, c_custkey AS object_id
FROM customer
"""

CONSTRAINTS = """
SELECT 't' || CAST(o_custkey % 50 AS STRING) AS tab, CASE o_orderkey % 4 WHEN 0 THEN 'PRIMARY KEY' WHEN 1 THEN 'UNIQUE' WHEN 2 THEN 'CHECK' ELSE 'FOREIGN KEY' END AS type,
       'k' || CAST(o_orderkey % 9 AS STRING) AS name, CAST(o_orderkey % 3 AS BIGINT) AS pos, 'c' || CAST((o_orderkey + o_custkey) % 6 AS STRING) AS col, CASE WHEN o_orderkey % 8 = 2 THEN '1=1' ELSE 'x > 0' END AS expr
FROM orders
"""

TABLE_COLUMNS = """
SELECT 't' || CAST(t AS STRING) AS tab, 'C' || CAST(c AS STRING) AS col, (t * c) % 4 = 0 AS nullable, c = 4 AS computed, CASE WHEN c = 4 AND t % 3 <> 0 THEN 'c1 + 1' END AS expr
FROM (SELECT DISTINCT o_custkey % 50 AS t, o_orderkey % 6 AS c FROM orders) o WHERE (t + c) % 7 <> 0 AND t % 13 <> 5
"""

FOREIGN_KEYS = """
SELECT DISTINCT 't' || CAST(o_custkey % 50 AS STRING) AS tab, 'k' || CAST(o_orderkey % 9 AS STRING) AS name, CAST((o_orderkey + o_custkey) % 3 AS BIGINT) AS pos, 'c' || CAST((o_orderkey + o_custkey) % 6 AS STRING) AS col,
       CASE WHEN o_custkey % 50 % 9 <> 0 THEN 't' || CAST((o_custkey % 50) * 7 % 50 AS STRING) END AS ref_tab,
       CASE WHEN o_orderkey % 9 = 5 OR (o_orderkey % 9 = 4 AND (o_orderkey + o_custkey) % 3 = 1) THEN NULL ELSE 'C' || CAST((o_orderkey + o_custkey * 7) % 6 AS STRING) END AS ref_col
FROM orders WHERE o_orderkey % 4 = 3 AND o_custkey % 50 * 3 % 9 <> 4
"""

#: Histories and script folders with gaps.
FOREIGN_HISTORY = f"SELECT * FROM ({HISTORY}) h WHERE installed_rank % 2 = 0"
SPARSE_HISTORY = f"SELECT * FROM ({HISTORY}) h WHERE installed_rank % 18 = 1"
PARTIAL_HISTORY = f"SELECT * FROM ({HISTORY}) h WHERE db <> 4"
FEW_SCRIPTS = f"SELECT * FROM ({SCRIPTS}) s WHERE db < 3"

TABLES = {"foreign_history": "events", "sparse_history": "events", "partial_history": "events", "few_scripts": "documents", "history": "events", "scripts": "documents", "journal": "lineitem", "error_messages": "lineitem", "edges": "supplier nation", "cyclic_edges": "nation", "tangled_edges": "supplier", "long_edges": "orders", "definitions": "customer", "references": "customer", "statements": "part", "alters": "part", "defined": "part", "options": "supplier", "batches": "orders", "types": "part", "columns": "supplier", "objects": "customer", "constraints": "orders", "table_columns": "orders", "foreign_keys": "orders"}
SQL = {"foreign_history": FOREIGN_HISTORY, "sparse_history": SPARSE_HISTORY, "partial_history": PARTIAL_HISTORY, "few_scripts": FEW_SCRIPTS, "history": HISTORY, "scripts": SCRIPTS, "journal": JOURNAL, "error_messages": ERROR_MESSAGES, "edges": EDGES, "cyclic_edges": CYCLIC_EDGES, "tangled_edges": TANGLED_EDGES, "long_edges": LONG_EDGES, "definitions": DEFINITIONS, "references": REFERENCES, "statements": STATEMENTS, "alters": ALTERS, "defined": DEFINED, "options": OPTIONS, "batches": BATCHES, "types": TYPES, "columns": COLUMNS, "objects": OBJECTS, "constraints": CONSTRAINTS, "table_columns": TABLE_COLUMNS, "foreign_keys": FOREIGN_KEYS}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the relations over the tables of ``sf_dir``."""
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name].split()}
    text = SQL[name].replace("{", "{{").replace("}", "}}")
    for t in sources:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **sources)
