"""Run the queries against their SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(normal(v) for v in value)
    return value.item() if hasattr(value, "item") else value


def rows_of(arrow) -> tuple[list[str], list[tuple], dict[str, str]]:
    names = sorted(arrow.column_names)
    columns = [[normal(v) for v in arrow.column(n).to_pylist()] for n in names]
    rows = sorted(zip(*columns), key=lambda row: tuple((v is None, str(v)) for v in row))
    return names, rows, {n: str(arrow.schema.field(n).type) for n in names}


def difference(spark_arrow, sql_arrow) -> str | None:
    """What differs, or None. Values must be equal to the last bit; types are compared too."""
    left, right = rows_of(spark_arrow), rows_of(sql_arrow)
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} / {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"values {a} / {b}"
    types = {
        n: (left[2][n], right[2][n])
        for n in left[0]
        if left[2][n].replace("large_", "") != right[2][n].replace("large_", "")
    }
    return f"types {types}" if types else None


def main(folder: str, names: list[str]) -> int:
    from checks import ORACLES, QUERIES
    from perilscope.operators import joins
    from perilscope.session import session

    spark = session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                    spark__ui__enabled="false",
                    spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("NO_BROADCAST"):  # as with tables too large for one
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joins.BROADCAST_BYTES = -1
    con = database(folder)
    bad = 0
    for name in names or sorted(QUERIES):
        start = time.time()
        try:
            result = QUERIES[name](spark, folder).toArrow()
            took = time.time() - start
            if name in ORACLES:
                found = difference(result, con.sql(ORACLES[name]).to_arrow_table())
            else:
                found = None
        except Exception as error:  # noqa: BLE001
            took, found, result = time.time() - start, f"{type(error).__name__}: {str(error)[:700]}", None
        bad += found is not None
        kind = "sql" if name in ORACLES else "rows"
        rows = result.num_rows if result is not None else "-"
        print(f"{'ok  ' if found is None else 'FAIL'} {kind} {took:6.2f}s {rows:>7} {name} {found or ''}",
              flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    at = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(main(at, [a for a in args if "/" not in a]) > 0)
