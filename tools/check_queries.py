"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tools/check_queries.py [--dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

from callscope.queries import ORACLES, QUERIES  # noqa: E402
from callscope.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.dir}/{name}.parquet'")
    failed = []
    for name in args.names or QUERIES:
        started = time.time()
        try:
            frame = QUERIES[name](spark, args.dir)
            found = frame.collect()
            spent = time.time() - started
            if name not in ORACLES:
                print(f"rows  {name}: {len(found)} rows, {spent:.2f}s", flush=True)
                continue
            result = duck.execute(ORACLES[name])
            columns = [c[0] for c in result.description]
            wanted = result.fetchall()
            problem = ""
            if sorted(columns) != sorted(frame.columns):
                problem = f"columns {sorted(frame.columns)} != {sorted(columns)}"
            else:
                ours, theirs = rows_of(frame.columns, found), rows_of(columns, wanted)
                if ours != theirs:
                    a = [r for r in ours if r not in set(theirs)][:3]
                    b = [r for r in theirs if r not in set(ours)][:3]
                    problem = f"{len(ours)} vs {len(theirs)} rows\n   spark {a}\n   sql   {b}"
                kinds = dict(zip(columns, (str(c[1]) for c in result.description)))
                spark_kinds = dict(frame.dtypes)
                same = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}
                odd = {c: (spark_kinds[c], k) for c, k in kinds.items() if same.get(k, spark_kinds.get(c)) != spark_kinds.get(c)}
                if odd and not problem:
                    print(f"types {name}: {odd}")
        except Exception as error:  # the report goes on with the next query
            problem, found, spent = f"{type(error).__name__}: {str(error)[:1500]}", [], time.time() - started
        if problem:
            failed.append(name)
            print(f"FAIL  {name} ({spent:.2f}s): {problem}", flush=True)
        else:
            print(f"ok    {name}: {len(found)} rows, {spent:.2f}s", flush=True)
    print(f"{len(args.names or QUERIES) - len(failed)} fine, {len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
