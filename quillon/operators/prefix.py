"""Running sums over an order without one task that holds it all.

Rows go to ranges of the order, each range sums its own, and a range's start is the sum
of the ranges before it: a table of as many rows as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import shuffle_partitions, stage

PART = "_part"


def range_parts(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """``df`` written once with the number ``_part`` of each row's range; equal values share one."""
    n = parts or shuffle_partitions(df.sparkSession)
    return stage(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[str], columns: list[str], descending: bool = False) -> DataFrame:
    """``df`` with ``run_<column>``: sums of each column up to and with the row, within ``by``.

    ``df`` has ``_part`` of range_parts() over the first of ``order`` and one row for each (by, order); rows that
    are equal in both must not be told apart by the caller. Nulls add nothing.
    """
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*by, PART).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(way(PART)).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = df.groupBy(*by, PART).agg(*(F.sum(c).alias(c) for c in columns))
    starts = starts.select(*by, PART, *(F.coalesce(F.sum(c).over(before), zero).alias(f"_s_{c}") for c in columns))
    own = df.select("*", *(F.coalesce(F.sum(c).over(inside), zero).alias(f"_r_{c}") for c in columns))
    # ``by`` may hold nulls
    left, right = own.alias("l"), starts.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, PART]]
    return left.join(right, on).select("l.*", *(F.col(f"r._s_{c}") for c in columns)).withColumns({f"run_{c}": F.col(f"_r_{c}") + F.col(f"_s_{c}") for c in columns}).drop(*(f"_{k}_{c}" for k in "rs" for c in columns))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with row numbers from 0 in ``order``, of which ties are broken anyhow."""
    one = range_parts(df, *order)
    w = Window.partitionBy(PART).orderBy(*order)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = one.groupBy(PART).agg(F.count(F.lit(1)).alias("_n")).select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return one.withColumn("_own", F.row_number().over(w) - 1).join(starts, PART).withColumn(name, F.col("_own") + F.col("_start")).drop("_own", "_start", PART)
