"""Run registered queries next to their SQL twins and compare every value.

Usage: python tests/compare.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6)
    if isinstance(value, (int, str)):
        return value
    return str(value)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    types = {d[0]: str(d[1]) for d in cur.description}
    rows = Counter(tuple(normal(r[i]) for i in order) for r in cur.fetchall())
    return sorted(names), rows, types


def spark_rows(df):
    names = sorted(df.columns)
    rows = Counter(tuple(normal(v) for v in r) for r in df.select(*names).collect())
    return names, rows


TIMES = {}
#: Queries whose tables are too small at a scale to hold what they look for.
THIN = {"sf0.001": {"duplicate_key_rule"}}


def compare(spark, con, key, run, sql, sf_dir):
    """Difference as text, or an empty text when both give the same rows."""
    started = time.time()
    df = run(spark, sf_dir)
    names, got = spark_rows(df)
    TIMES["spark"] = time.time() - started
    if sql is None:
        return "", sum(got.values())
    sql_names, want, types = sql_rows(con, sql)
    if names != sql_names:
        return f"columns {names} != {sql_names}", sum(got.values())
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}, columns {names}\n"
            f"   only spark {sum(extra.values())}: {list(extra)[:3]}\n"
            f"   only sql   {sum(missing.values())}: {list(missing)[:3]}"
        ), sum(got.values())
    if not got and key not in THIN.get(sf_dir.rsplit("/", 1)[-1], ()):
        return "no rows on either side: nothing is compared", 0
    spark_types = dict(df.dtypes)
    pairs = {n: (spark_types[n], types[n]) for n in names}
    odd = {n: p for n, p in pairs.items() if not same_type(*p)}
    return (f"types {odd}" if odd else ""), sum(got.values())


def same_type(spark_type: str, sql_type: str) -> bool:
    sql_type = sql_type.upper()
    kinds = {
        "string": ("VARCHAR", "STRING"),
        "bigint": ("BIGINT", "NUMBER"),
        "int": ("INTEGER", "NUMBER"),
        "double": ("DOUBLE", "NUMBER"),
        "boolean": ("BOOLEAN", "BOOL"),
    }
    return sql_type in kinds.get(spark_type, (spark_type.upper(),))


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from vigilog.session import get_session

    spark = get_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    todo, twins = queries(), oracle_sql()
    bad = []
    for key in args.keys or todo:
        start, TIMES["spark"] = time.time(), 0.0
        try:
            diff, rows = compare(spark, con, key, todo[key], twins.get(key), sf_dir)
        except Exception as e:
            diff, rows = f"{type(e).__name__}: {str(e)[:900]}", -1
        mark = "BAD" if diff else ("ok" if key in twins else "rows")
        if diff:
            bad.append(key)
        print(f"{mark:4} {key:28} rows={rows:<7} {TIMES['spark']:5.1f}s spark "
              f"{time.time() - start:5.1f}s all {diff}", flush=True)
    print(f"{len(args.keys or todo)} queries, {len(bad)} differ: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
