"""Registration of queries and presentation of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .views import Tables, to_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Six decimals for fractions, text for dates, so that both engines print alike."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            c = c.cast("date").cast("string")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL check."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: present(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = to_sql(sql)
        return fn
    return register


def r6(expression: str, alias: str) -> str:
    """Rounded SQL output column; adding 0.0 turns -0.0 into 0.0."""
    return f"ROUND(CAST({expression} AS DOUBLE), 6) + 0.0 AS {alias}"


def day(expression: str, alias: str) -> str:
    return f"CAST(CAST({expression} AS DATE) AS VARCHAR) AS {alias}"


def drawn(seed: int | str, *cols: str) -> str:
    """SQL of ``relational.seeded_hash``."""
    return f"CAST('0x' || SUBSTR(MD5(CONCAT_WS('|', {', '.join([repr(str(seed)), *cols])})), 1, 15) AS BIGINT)"


def drawn_unit(seed: int | str, *cols: str) -> str:
    """SQL of ``relational.unit_hash``."""
    return f"(CAST({drawn(seed, *cols)} % {1 << 52} AS DOUBLE) / {float(1 << 52)!r})"


def hash_rank(seed: int, *ids: str) -> str:
    """SQL of the rank of ``relational.hash_ranked``: by bucket, hash and id."""
    h = drawn(seed, *ids)
    return f"ROW_NUMBER() OVER (ORDER BY {h} % 65536, {h}, {', '.join(ids)})"
