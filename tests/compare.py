"""Runs registered queries on Spark and their SQL on DuckDB, and compares the two.

    python -m tests.compare [folder] [name or prefix* …]
"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if hasattr(value, "isoformat"):
        return str(value)
    if isinstance(value, float) and value != value:
        return None
    return value


def compare(spark, con, name: str, query, sql: str | None, folder: str) -> str:
    """Empty when both results are the same rows, else what differs."""
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = sorted(
        (tuple(_plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()),
        key=repr,
    )
    if sql is None:
        return "" if mine else "no rows"
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(names, [str(d[1]) for d in found.description]))
    for c, t in df.dtypes:
        if kinds.get(t) != types[c]:
            return f"type of {c}: {t} against {types[c]}"
    theirs = sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}; {mine[:2]} {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main(argv: list[str]) -> int:
    from lodestat.session import new_session

    import __spark_entry__ as contract

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = new_session(
        "compare", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, failures = connect(folder), 0
    oracles = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and not any(name == w or (w[-1] == "*" and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem)
        state = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{state:4} {name:32} {time.time() - start:6.1f}s {problem[:900]}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
