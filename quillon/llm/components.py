"""Connected components of an edge table, and joins of rows with their classes, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import discard, stage

HOT_CLASSES = 10_000


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) for every endpoint of ``edges(u, v)``: the smallest id reachable.

    Labels flow along the edges and then jump to their own label's label, so
    a chain of n ids takes about log n rounds. Each round is written to the
    shared folder. Nulls: an edge with a null end is ignored. An empty table
    gives an empty result.
    """
    pairs = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v")
    both = stage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stage(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("id").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        low = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = stage(low.join(jump, "low").select("id", F.least("low", "far").alias("component"), F.col("component").alias("was")))
        moved = new.where("component <> was").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels.select("id", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``classes`` (which have a ``size``) by ``key``, nulls where there is no class.

    A class of a ten-thousandth of all rows or more goes by broadcast: there are
    HOT_CLASSES of those at most, and no task gets all rows of one. The others are
    shuffled.
    """
    hot = classes.where(F.col("size") * HOT_CLASSES >= max(total, HOT_CLASSES * 100))
    known = rows.where(F.col(key).isNotNull())
    rest = known.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes, key, "left")
    without = rows.where(F.col(key).isNull())
    without = without.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in classes.schema if f.name != key))
    return known.join(F.broadcast(hot), key).unionByName(rest).unionByName(without)
