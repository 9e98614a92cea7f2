"""Runs a query of ``__spark_entry__`` and its SQL over the same tables, and compares."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    """A value that compares across the two engines."""
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir: str, name: str, con=None) -> str:
    """Empty if the query and its SQL agree, otherwise what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    mine = rows(df.columns, df.collect())
    cur = (con or duck(sf_dir)).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    theirs = rows(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return f"{len(mine)} and {len(theirs)} rows; only in Spark {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    names = [q for n in names for q in entry.queries() if q == n or q.startswith(f"{n}_")]
    con = duck(sf_dir)
    for name in names:
        began = time.time()
        try:
            if name in entry.oracle_sql():
                said = compare(spark, sf_dir, name, con) or "equal"
            else:
                said = f"{entry.queries()[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001  the report goes on with the next query
            said = f"failed: {str(e)[:900]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
