"""Adapters from the driver tables and the registry of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.worktables import spread

#: Tables whose rows are costly to work on.
TEXTS = ("documents", "pages", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL for the same rows if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0]) if name in TEXTS else df


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Literal rows as a local relation: through Arrow no job is needed to make them."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow))


def sql_values(rows: list[tuple], *names: str) -> str:
    """The same rows as a derived table for the SQL twin."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"
