"""Compare a registered query with its SQL on the same parquet tables."""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        number = float(value)
        return ("null",) if math.isnan(number) else ("n", number + 0.0)
    if value is None:
        return ("null",)
    if hasattr(value, "isoformat"):
        return ("d", value.isoformat()[:19])
    return ("s", str(value))


def normalised(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """(message, seconds in Spark, seconds in SQL, rows); the message is empty on a match."""
    started = time.time()
    frame = query(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    spark_seconds = time.time() - started
    if sql is None:
        return "", spark_seconds, 0.0, len(got)
    started = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    sql_seconds = time.time() - started
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}", spark_seconds, sql_seconds, len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", spark_seconds, sql_seconds, len(got)
    ours, theirs = normalised(frame.columns, got), normalised(names, want)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    message = f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
    return message, spark_seconds, sql_seconds, len(got)


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from tests.conftest import make_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = make_session()
    con = connect(sf_dir)
    sqls = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            message, s1, s2, rows = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            message, s1, s2, rows = f"ERROR {str(error)[:1500]}", 0, 0, 0
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok ' if not message else 'BAD'} {name:26s} {kind:4s} rows={rows} "
              f"spark={s1:.2f}s sql={s2:.2f}s {message}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
