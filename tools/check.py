"""Run queries in Spark and their SQL in DuckDB, and compare all rows.

    python tools/check.py <scale folder> [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if value is None:
        return ""
    return str(value)


def rows_of(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(plain(v) for v in row) for row in zip(*columns))


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(df, sql: str | None, con) -> tuple[bool, str]:
    names, mine = rows_of(df.toArrow())
    if sql is None:
        return bool(mine), f"{len(mine)} rows, no SQL"
    result = con.execute(sql).to_arrow_table()
    other_names, other = rows_of(result)
    if names != other_names:
        return False, f"columns {names} != {other_names}"
    if mine == other:
        return True, f"{len(mine)} rows"
    extra = [r for r in mine if r not in set(other)][:2]
    missing = [r for r in other if r not in set(mine)][:2]
    return False, f"{len(mine)} != {len(other)} rows; only here {extra}; only there {missing}"


def main(sf: str, wanted: list[str]) -> int:
    from catalog import all_queries
    from docreg.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name, (query, sql) in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            ok, note = compare(query(spark, sf), sql, con)
        except Exception as problem:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.1f}s {note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
