"""Run registered queries beside their DuckDB text and report differences: python tests/compare.py [SF_DIR] [NAME...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in values)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, run, sql):
    """A message about the first difference, or an empty one."""
    df = run(spark, sf_dir)
    got = df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    a, b = rows(got, df.columns), rows(found.fetchall(), names)
    if a == b:
        return ""
    from collections import Counter

    left, right = Counter(a) - Counter(b), Counter(b) - Counter(a)
    return f"{len(a)} and {len(b)} rows; only Spark: {list(left)[:2]}; only DuckDB: {list(right)[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries = connect(sf_dir), __spark_entry__.queries()
    for name, sql in __spark_entry__.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            said = compare(spark, con, sf_dir, queries[name], sql)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if not said else "DIFF", name, f"{time.time() - began:.1f}s", said, flush=True)
