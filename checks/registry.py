"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(
    sql: str | None = None, rounded: Sequence[str] = (), ints: Sequence[str] = (), digits: int = 6
) -> Callable[[Query], Query]:
    """Register a query under its function name.

    On both sides `rounded` columns are rounded (and -0.0 made 0.0) and `ints` cast to bigint,
    so that summation order and integer widths do not matter. A shift far below the last digit
    makes exact halves, which many means of short decimals are, round the same way.
    """
    shift = 1.7 * 10.0 ** -(digits + 3)

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(
                *[
                    (F.round(F.col(f"`{c}`").cast("double") + F.lit(shift), digits) + F.lit(0.0)).alias(c)
                    if c in rounded
                    else F.col(f"`{c}`").cast("bigint").alias(c)
                    if c in ints
                    else F.col(f"`{c}`")
                    for c in df.columns
                ]
            )

        if fn.__name__ in QUERIES:
            raise ValueError(f"two queries named {fn.__name__}")
        QUERIES[fn.__name__] = run
        if sql is not None:
            changes = [f"round(CAST({c} AS DOUBLE) + {shift!r}, {digits}) + 0e0 AS {c}" for c in rounded]
            changes += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
            body = with_views(sql)
            ORACLES[fn.__name__] = f"SELECT * REPLACE ({', '.join(changes)}) FROM (\n{body}\n)" if changes else body
        return fn

    return register
