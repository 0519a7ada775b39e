"""Compare registered queries with their oracle SQL: python tests/check_oracles.py [sf] [key ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from vintager.session import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normalised(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value: object) -> str:
        if isinstance(value, float):
            return repr(value)
        return str(value)

    return sorted("|".join(text(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir: str, key: str) -> tuple[bool, str]:
    started = time.time()
    df = entry.queries()[key](spark, sf_dir)
    got = normalised(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = db.execute(entry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    want = normalised(names, result.fetchall())
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    types = {d[0]: str(d[1]) for d in result.description}
    odd = {n: (k, types.get(n)) for n, k in df.dtypes if kinds.get(k) != types.get(n)}
    note = f"{took:6.2f}s rows={len(got)}"
    if sorted(df.columns) != sorted(names):
        return False, f"{note} columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return False, f"{note} / {len(want)} {diff}"
    return not odd, f"{note} {odd or ''}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    keys = sys.argv[2:] or list(entry.queries())
    failed = []
    for key in keys:
        try:
            ok, note = compare(spark, f"/root/testdata/sf{sf}", key)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", key, note, flush=True)
        if not ok:
            failed.append(key)
    print(len(keys) - len(failed), "of", len(keys), "match", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
