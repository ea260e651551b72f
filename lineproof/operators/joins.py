"""Joins of tables that grow together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a driver and every executor may hold of one side of a join.
HELD = 100_000
#: Rows that a task groups or joins by key at a time.
DEALT = 1_000_000


def grown(df: DataFrame) -> DataFrame:
    """df as a side of joins with tables that grow as it does; these sort and merge.

    Spark weighs a side by its packed bytes. Notices repeat their forms, so millions of rows pass as small, and their
    table would be built whole on the driver and held by every executor.
    """
    return df.hint("merge")


def sized(df: DataFrame, n: int) -> DataFrame:
    """df of n rows as a side of a join with a table of any size: few rows go to every executor, more sort and merge."""
    return df.hint("broadcast") if n <= HELD else grown(df)


def dealt(df: DataFrame, n: int, *keys: str, most: int = DEALT) -> DataFrame:
    """df of about n rows dealt by keys to tasks of about that many rows each, so that a task's memory stays as the input grows.

    Spark sizes tasks by packed bytes; of keys that pack well, one task would take tens of millions.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // most)), *[F.col(k) for k in keys])
