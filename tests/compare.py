"""Run registered queries against DuckDB on the same parquet files: python tests/compare.py SF [name ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value) if not isinstance(value, (dt.date, str)) else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def kind(name):
    name = name.lower()
    if name in ("double", "float", "real"):
        return "float"
    if any(name.startswith(p) for p in ("bigint", "int", "long", "smallint", "tinyint", "short", "byte")):
        return "int"
    if name.startswith(("hugeint", "decimal", "ubigint", "uint", "uhugeint")):
        return f"unexpected {name}"
    return {"varchar": "string", "bool": "boolean"}.get(name, name)


def compare(spark, con, name, run, sql, sf_dir):
    """Return (problem or None, row count, seconds)."""
    start = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(rows), seconds
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    expected = relation.fetchall()
    types = {d[0]: kind(str(d[1])) for d in relation.description}
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(rows), seconds
    for field in df.schema.fields:
        got = kind(field.dataType.simpleString())
        if got != types[field.name] and not (got.startswith("timestamp") and types[field.name].startswith("timestamp")):
            return f"type of {field.name}: {got} != {types[field.name]}", len(rows), seconds
    got, want = canonical(df.columns, rows), canonical(columns, expected)
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; only here {extra}; only SQL {missing}", len(rows), seconds
    if not rows:
        return "EMPTY on both sides", 0, seconds
    return None, len(rows), seconds


def main(argv):
    import __spark_entry__ as entry
    from foliowire.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    wanted = argv[1:]
    spark = local_session()
    con = oracle_connection(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            problem, n, seconds = compare(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            problem, n, seconds = f"{type(exc).__name__}: {str(exc)[:700]}", 0, 0.0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5}{name:40}{n:8} rows {seconds:7.2f}s {problem or ''}", flush=True)
    print(f"{bad} problems", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
