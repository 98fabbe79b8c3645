"""Run every query next to its SQL: ``python tests/check_proofs.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(df, relation) -> list[str]:
    """What differs between a Spark result and a DuckDB result."""
    ours, theirs = df.columns, relation.columns
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} / {sorted(theirs)}"]
    a, b = rows_of(ours, df.collect()), rows_of(theirs, relation.fetchall())
    found = []
    if len(a) != len(b):
        found.append(f"rows {len(a)} / {len(b)}")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        found.append(f"values {only_a} / {only_b}")
    if not a:
        found.append("no rows")
    return found


def types_of(df, relation) -> str:
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "date": "DATE"}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    return ", ".join(f"{n}: {k} / {theirs.get(n)}" for n, k in df.dtypes
                     if names.get(k, k) != theirs.get(n))


def main(folder: str, chosen: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    from shoplore.session import build_session

    spark = build_session(**{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                             "spark.master": "local[8]", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, oracles, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if chosen and name not in chosen:
            continue
        begun = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                relation = db.sql(oracles[name])
                found, kinds = compare(df, relation), types_of(df, relation)
            else:
                n = len(df.collect())
                found, kinds = ([] if n else ["no rows"]), f"{n} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            found, kinds = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        bad += bool(found)
        print(f"{'BAD' if found else 'ok':4}{name:30}{time.time() - begun:6.1f}s  {kinds}", flush=True)
        for line in found:
            print("      ", line[:1500], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(where, sys.argv[2:]) else 0)
