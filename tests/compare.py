"""Run a named query and its SQL side by side.

    python tests/compare.py [--plain] [--sf 0.01] [name ...]

``--plain`` takes a session with Spark's own defaults instead of the library's.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if value != value else (f"{value:.12g}" if value else "0")
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(cells, key=lambda r: tuple("" if c is None else c for c in r))


def difference(df, sql: str, connection) -> str | None:
    """None when equal, else what differs."""
    spark_names, spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    names, rows = _rows([d[0] for d in result.description], result.fetchall())
    if spark_names != names:
        return f"columns: {spark_names} / {names}"
    for field in df.schema:
        ours, theirs = field.dataType.simpleString(), kinds[field.name]
        alike = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
        if alike.get(ours, ours) not in theirs.upper():
            return f"type of {field.name}: {ours} / {theirs}"
    if len(spark_rows) != len(rows):
        return f"rows: {len(spark_rows)} / {len(rows)}"
    bad = [(a, b) for a, b in zip(spark_rows, rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, first: {names} {bad[0]}"
    return None


def main(arguments: list[str]) -> int:
    import __spark_entry__ as entry
    from tallyspark.session import build_session

    plain = arguments[:1] == ["--plain"]
    arguments = arguments[1:] if plain else arguments
    scale = "0.01"
    if arguments[:1] == ["--sf"]:
        scale, arguments = arguments[1], arguments[2:]
    directory = f"/root/testdata/sf{scale}"
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    if plain:
        spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    else:
        spark = build_session("compare", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    queries, checks = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not arguments or any(n.startswith(a) for a in arguments)]
    failed = 0
    for name in chosen:
        started = time.time()
        try:
            df = queries[name](spark, directory)
            if name in checks:
                problem = difference(df, checks[name], connection)
            else:
                problem = None if df.count() >= 0 else "?"
        except Exception as error:  # reported per query, the run goes on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        print(f"{mark} {name} {time.time() - started:.2f}s {'' if name in checks else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(chosen)} run, {failed} failed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
