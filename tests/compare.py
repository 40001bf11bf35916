"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def differences(spark_df, db, sql: str) -> str | None:
    """None if both sides give the same columns and rows, else what differs."""
    ours = [tuple(r) for r in spark_df.collect()]
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    left = [spark_df.columns.index(c) for c in sorted(names)]
    right = [names.index(c) for c in sorted(names)]
    a = sorted((tuple(plain(r[i]) for i in left) for r in ours), key=repr)
    b = sorted((tuple(plain(r[i]) for i in right) for r in theirs), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(c, p, q) for c, p, q in zip(sorted(names), x, y) if p != q]
            return f"first difference {bad} in {x}"
    return None


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, db = local_session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                result = differences(df, db, sqls[name])
                note = "same" if result is None else f"DIFFERENT {result[:600]}"
            else:
                result, note = None, f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            result = note = f"FAILED {str(error)[:900]}"
        failed += result is not None
        print(f"{name}: {note} ({time.time() - start:.1f}s)", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
