"""Run a registered query and its SQL on the same parquet files and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from stallwise.sources.tables import SCHEMAS  # noqa: E402

DATA = "/root/testdata"


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def bag(columns: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def family(type_name: str) -> str:
    name = type_name.lower()
    if name in {"int", "integer", "bigint", "smallint", "tinyint"}:
        return "integer"
    return {"varchar": "string", "float": "double"}.get(name, name)


def compare(spark, con, query, sql: str, folder: str) -> tuple[bool, str]:
    began = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    result = con.execute(sql)
    expected = result.fetchall()
    columns = [d[0] for d in result.description]
    got_columns, got = bag(df.columns, rows)
    want_columns, want = bag(columns, expected)
    types = {f.name: family(f.dataType.simpleString()) for f in df.schema.fields}
    want_types = {d[0]: family(str(d[1])) for d in result.description}
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if types != want_types:
        odd = {c: (types[c], want_types[c]) for c in types if types[c] != want_types[c]}
        return False, f"types (spark, sql): {odd}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return False, f"rows {len(rows)} vs {len(expected)}\n  cols {got_columns}\n  spark only {extra}\n  sql only {missing}"
    return True, f"{len(rows)} rows, {took:.2f}s"


def main() -> None:
    from stallwise.session import build_session

    import __spark_entry__ as entry

    scale = "sf0.01"
    names = sys.argv[1:]
    if names and names[0].startswith("sf"):
        scale, names = names[0], names[1:]
    folder = f"{DATA}/{scale}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            ok, note = compare(spark, con, queries[name], sql[name], folder)
        except Exception as error:  # report and go on with the next key
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + f"{name}: {note}", flush=True)
    print(f"{bad} failed; without sql: {sorted(set(queries) - set(sql))}; sql only: {sorted(set(sql) - set(queries))}")


if __name__ == "__main__":
    main()
