"""Run registered queries against their oracle SQL: python tests/compare.py SF_DIR [NAME...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([cell(r[i]) for i in order] for r in rows), key=str)


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-6 * max(1, abs(a))
    return a == b


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows_of(list(rel.columns), rel.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if not all(map(close, a, b))]
    return f"{len(bad)} of {len(mine[1])} rows differ: {bad[0]}" if bad else ""


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    at, names = sys.argv[1], sys.argv[2:]
    con, oracles = connect(at), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            said = compare(spark, con, at, query, oracles[name]) or "ok" if name in oracles else f"{query(spark, at).count()} rows, no oracle"
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
