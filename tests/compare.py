"""Run registered queries beside their SQL in DuckDB and compare the rows.

Command line: python tests/compare.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SF_DIR = os.environ.get("CREDITLENS_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (2, "nan") if math.isnan(f) else (2, f"{f + 0.0:.9g}")
    return (3, str(v))


def normal_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql, sf_dir):
    """List of differences, empty if the results agree."""
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} != {sorted(rel.columns)}"], len(got)
    kinds = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for f in df.schema:
        spark_type, duck_type = f.dataType.simpleString(), kinds[f.name]
        same = {"int": ["INTEGER"], "bigint": ["BIGINT"], "double": ["DOUBLE"], "string": ["VARCHAR"], "boolean": ["BOOLEAN"]}
        if duck_type not in same.get(spark_type, []):
            problems.append(f"type of {f.name}: {spark_type} / {duck_type}")
    a, b = normal_rows(got, df.columns), normal_rows(want, rel.columns)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"rows {len(a)} / {len(b)}; spark only {len(only_a)}, sql only {len(only_b)}: {only_a[:2]} | {only_b[:2]}")
    return problems, len(got)


def main(argv):
    import __spark_entry__ as entry
    from creditlens import build_session

    sf_dir = SF_DIR
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            if name in oracles:
                problems, n = compare(spark, con, run, oracles[name], sf_dir)
            else:
                n, problems = len(run(spark, sf_dir).collect()), []
        except Exception as e:  # report and go on with the next query
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool([p for p in problems if not p.startswith("type")])
        print(f"{'ok ' if not problems else 'BAD'} {name:34s} {n:7d} rows {time.time() - start:6.2f}s {'' if name in oracles else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
