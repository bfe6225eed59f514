"""Joins with a side whose size is measured, and columns that cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 48 << 20
SALTS = 32


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with its columns named c0, c1, ... by place, and their own
    names: whatever the caller's columns are called, helper columns differ."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), names


def renamed(names: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``numbered`` under their own names again; those named
    like one of ``without`` (in any case) give way to an operator's output."""
    gone = {n.lower() for n in without}
    return [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in gone]


def join_measured(left: DataFrame, right: DataFrame, on: list[str], row_bytes: Column, how: str = "inner",
                  max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """left joined with ``right``, a materialized table with one or few rows a
    key.  Its size is summed first.  Up to ``max_bytes`` it is broadcast, so no
    row of the left side moves.  Beyond that both sides are exchanged on the key
    and a salt: the left side's is its input partition, so any number of rows
    of one key spreads over ``SALTS`` tasks; the right side is repeated for
    each salt."""
    size = right.agg(F.sum(row_bytes).alias("b")).first().b or 0
    if size <= max_bytes:
        return left.join(F.broadcast(right), on, how)
    # a retried task reads the same partition, so its rows get the same salt
    salted = left.withColumn("salt__", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    spread = right.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*on, "salt__"], how).drop("salt__")
