"""Run queries next to their SQL twins: `python -m checks.compare [--sf 0.01] [name ...]`."""

from __future__ import annotations

import argparse
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.registry import ORACLES, QUERIES
from checks.views import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return int(value)
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(plain(r[i])) for i in order) for r in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str | None:
    """None if equal (or if there is no twin and rows come back), else what differs."""
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        return None if rows else "no rows"
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine, theirs = rows_of(df.columns, rows), rows_of(names, cursor.fetchall())
    if not mine and not theirs:
        return "both empty"
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        return (
            f"{sum(mine.values())} rows against {sum(theirs.values())}; "
            f"only here {sum(extra.values())}: {list(extra)[:3]}; only there: {list(missing)[:3]}"
        )
    return None


def main() -> None:
    import checks  # noqa: F401  (registers the queries)

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} of {len(args.names or QUERIES)} differ")


if __name__ == "__main__":
    main()
