"""The gap statistic (CLU2): k-means of all replicates and all numbers of clusters at once.

Replicate 0 is the data, the others are null data whose every column is drawn anew from its
own values. A step is one pass: tasks hold the centres of every (replicate, k), give each row
its nearest, and emit sums by cluster; the driver sees as many rows as there are centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.prefix import numbered
from quillon.operators.resampling import uniform
from quillon.session import discard, stage

REPLICATE, POINT = "replicate", "x"


def column_resample(df: DataFrame, row: str, features: list[str], n: int, seed: int = 0) -> DataFrame:
    """(replicate, row, x): the complete rows as replicate 0, and n null tables whose columns are drawn with replacement, each on its own."""
    rows = stage(numbered(df.select(F.col(row).alias("row"), *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features))).na.drop(), ["row"], "_at"))
    total = rows.count()
    x = [f"_x{k}" for k in range(len(features))]
    data = rows.select(F.lit(0).alias(REPLICATE), "row", F.array(*x).alias(POINT))
    if not total or not n:
        return data
    long = rows.select("row", F.explode(F.sequence(F.lit(1), F.lit(n))).alias(REPLICATE)).select("row", REPLICATE, F.explode(F.sequence(F.lit(0), F.lit(len(x) - 1))).alias("_c"))
    long = long.withColumn("_at", F.floor(uniform("row", REPLICATE, "_c", F.lit(seed)) * total))
    values = rows.select("_at", F.posexplode(F.array(*x)).alias("_c", "_v"))
    drawn = long.join(values, ["_at", "_c"]).groupBy(REPLICATE, "row").agg(F.array_sort(F.collect_list(F.struct("_c", "_v"))).alias("_l"))  # one entry for each feature
    return data.unionByName(drawn.select(REPLICATE, "row", F.transform("_l", lambda v: v["_v"]).alias(POINT)))


def _assign(centres: dict[int, list[np.ndarray]]):
    """Sums (replicate, k, cluster, n, ss, sums) of the rows of each batch at given centres: by replicate a list by k."""
    schema = pa.schema([("replicate", pa.int32()), ("k", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("ss", pa.float64()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            replicate = batch.column(0).to_numpy()
            points = batch.column(1).flatten().to_numpy().reshape(len(replicate), -1)
            for r in np.unique(replicate):
                p = points[replicate == r]
                for k, c in enumerate(centres[int(r)], 1):
                    far = ((p[:, None, :] - c[None]) ** 2).sum(2) if len(c) * p.size < 5_000_000 else np.stack([((p - v) ** 2).sum(1) for v in c], 1)
                    near = far.argmin(1)
                    for j in range(len(c)):
                        mine = near == j
                        if mine.any():
                            at = total.setdefault((int(r), k, j), [0, 0.0, np.zeros(p.shape[1])])
                            at[0] += int(mine.sum())
                            at[1] += float(far[mine, j].sum())
                            at[2] += p[mine].sum(0)
        rows = [{"replicate": r, "k": k, "cluster": j, "n": v[0], "ss": v[1], "sums": v[2].tolist()} for (r, k, j), v in total.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def k_means(points: DataFrame, most: int, steps: int = 100, tol: float = 1e-9, seed: int = 0) -> tuple[dict, dict]:
    """Lloyd's k-means of each replicate of ``points(replicate, row, x)`` for 1 to ``most`` clusters: ({(replicate, k): within sum of squares}, {(replicate, k): centres}).

    The first centres are the rows of the lowest hashes with different places. A cluster that empties keeps its centre. Raises where the sums still fall after
    ``steps``.
    """
    features = points.select(F.size(POINT).alias("n")).head()
    if features is None:
        return {}, {}
    low = points.groupBy(REPLICATE, POINT).agg(F.min(F.xxhash64("row", F.lit(seed))).alias("h"))
    ranked = low.withColumn("i", F.row_number().over(Window.partitionBy(REPLICATE).orderBy("h", POINT))).where(F.col("i") <= most)
    first: dict[int, list] = {}
    for r in ranked.orderBy(REPLICATE, "i").collect():  # replicates times clusters
        first.setdefault(r[REPLICATE], []).append(np.array(r[POINT], float))
    centres = {r: [np.stack(v[:k]) for k in range(1, len(v) + 1)] for r, v in first.items()}
    kinds = "replicate int, k int, cluster int, n long, ss double, sums array<double>"
    before: dict[tuple, float] = {}
    for _ in range(steps):
        size = features["n"]
        parts = points.select(REPLICATE, POINT).mapInArrow(_assign(centres), kinds)
        sums = parts.groupBy("replicate", "k", "cluster").agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"), F.array(*(F.sum(F.col("sums")[j]) for j in range(size))).alias("sums")).collect()
        within: dict[tuple, float] = {}
        for s in sums:
            within[s["replicate"], s["k"]] = within.get((s["replicate"], s["k"]), 0.0) + s["ss"]
        if before and all(before[key] - v <= tol * (1 + v) for key, v in within.items()):
            return within, {(r, k): c for r, v in centres.items() for k, c in enumerate(v, 1)}
        before = within
        for s in sums:
            centres[s["replicate"]][s["k"] - 1][s["cluster"]] = np.array(s["sums"]) / s["n"]
    raise RuntimeError(f"k-means did not settle in {steps} steps")


def gap_statistic(df: DataFrame, row: str, features: list[str], most: int = 10, n: int = 10, seed: int = 0) -> DataFrame:
    """(k, log_w, null_mean, error, gap, chosen): log within-cluster sums of squares, their mean and error over n null tables, and the gap.

    The sum of squares about means is that of all pairs' squared distances over twice the size. ``chosen`` is the least k whose gap is at least the next
    one's less its error; none if there is no such k below ``most``. Incomplete rows are left out; a table of fewer different places than ``most`` has as many k. A
    within sum of 0 has no logarithm and is null.
    """
    points = stage(column_resample(df, row, features, n, seed))
    within, _ = k_means(points, most, seed=seed)
    discard(points)
    ln = lambda v: math.log(v) if v and v > 0 else None
    table = []
    for k in sorted({k for r, k in within if r == 0}):
        null = [ln(within.get((r, k))) for r in range(1, n + 1)]
        null = [v for v in null if v is not None]
        w = ln(within[0, k])
        mean = float(np.mean(null)) if null else None
        error = float(np.std(null) * math.sqrt(1 + 1 / len(null))) if null else None
        table.append([k, w, mean, error, None if w is None or mean is None else mean - w])
    chosen = next((a[0] for a, b in zip(table, table[1:]) if None not in (a[4], b[4], b[3]) and a[4] >= b[4] - b[3]), None)
    return df.sparkSession.createDataFrame([(*t, t[0] == chosen) for t in table], "k int, log_w double, null_mean double, error double, gap double, chosen boolean")
