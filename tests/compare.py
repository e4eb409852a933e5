"""Rows of a query and of its SQL, made comparable. As a script: compare the named queries, or all, over a folder."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, Decimal)):
        return int(x) if int(x) == x else float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else int(x) if x == int(x) else float(f"{x:.9g}")
    if isinstance(x, (bytearray, bytes, memoryview)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return x


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def expected(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    out = con.sql(sql)
    return out.columns, out.fetchall()


def difference(df, folder: str, sql: str) -> str:
    """Empty if both give the same rows under the same names."""
    names, rows = expected(folder, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours, theirs = bag(df.columns, df.collect()), bag(names, rows)
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH")]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    where, chosen = sys.argv[1], sys.argv[2:]
    for q, f in entry.queries().items():
        if (chosen and q not in chosen) or (not chosen and q.startswith(("op", "pipeline"))):
            continue
        began = time.time()
        try:
            sql = entry.oracle_sql().get(q)
            said = difference(f(session, where), where, sql) if sql else f"no SQL, {f(session, where).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__} {str(e)[:600]}"
        print(f"{q}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
