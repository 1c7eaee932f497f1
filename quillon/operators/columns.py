"""Projections, scaling, imputation (PRJ1-PRJ6, NA1-NA2) and scalar label functions."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sanitize_columns(df: DataFrame, mark: str = ".") -> DataFrame:
    """Column names with every character outside letters, digits and ``_`` replaced."""
    return df.toDF(*(re.sub(r"[^0-9A-Za-z_]", mark, c) for c in df.columns))


def strip_prefix(df: DataFrame, separator: str = ".") -> DataFrame:
    """Column names after their last separator."""
    return df.toDF(*(c.rsplit(separator, 1)[-1] for c in df.columns))


def clean_id(column: Column) -> Column:
    """Participant ids as text: no dashes, no trailing ``.0``; null is ``NA``."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(column.cast("string"), "-", ""), r"\.0$", ""), F.lit("NA"))


def composite_key(*columns: str) -> Column:
    return F.concat_ws(" ", *columns)


def min_max(column: str, by: list[str] = (), null_to: float | None = None, cap: float | None = None) -> Column:
    """Scaled to [0, 1] within groups; ``cap`` scales to the ratio to the minimum instead, capped."""
    w = Window.partitionBy(*by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    if cap is not None:
        return F.least(F.col(column) / low, F.lit(cap))
    filled = F.coalesce(column, low if null_to is None else F.lit(null_to)) if null_to is not None else F.col(column)
    return (filled - low) / F.nullif(high - low, F.lit(0.0))


def fit_standardization(df: DataFrame, columns: list[str], median: bool = False) -> dict[str, tuple[float, float]]:
    """Centre and standard deviation (ddof 1) of each column, to be used on other data."""
    mid = F.median if median else F.avg
    row = df.agg(*(mid(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns)).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardize(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / F.nullif(F.lit(s), F.lit(0.0)) for c, (m, s) in fitted.items()})


def floor_log10(column: Column, limit: float | None = None, shift: float = 0.0) -> Column:
    """log10 of a magnitude raised to its limit of detection."""
    return F.log10((column if limit is None else F.greatest(column, F.lit(limit))) + shift)


def _draw(df: DataFrame, c: str, seed: int, buckets: int = 256) -> DataFrame:
    """Nulls of ``c`` filled from its observed values, which are ranked within hash buckets: only the buckets' counts reach the driver."""
    every = [F.col(x) for x in df.columns]
    deal = F.pmod(F.xxhash64(*every, F.lit(seed)), F.lit(buckets))
    seen = df.where(F.col(c).isNotNull()).select(F.col(c).alias("_v"), deal.cast("int").alias("_b"), F.xxhash64(*every).alias("_h"))
    counts = {r["_b"]: r["n"] for r in seen.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return df
    ends = [sum(counts.get(b, 0) for b in range(k + 1)) for k in range(buckets)]
    table = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")  # folded to one constant
    ranked = seen.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_v")) - 1).select("_b", F.col("_k").cast("long").alias("_k"), "_v")
    at = F.pmod(F.xxhash64(*every, F.lit(c), F.lit(seed + 1)), F.lit(total))
    missing = df.where(F.col(c).isNull()).withColumn("_at", at).withColumn("_b", F.size(F.filter(table, lambda e: e <= F.col("_at"))))
    missing = missing.withColumn("_k", F.col("_at") - F.when(F.col("_b") > 0, F.get(table, F.col("_b") - 1)).otherwise(0))
    filled = missing.join(ranked, ["_b", "_k"], "left").withColumn(c, F.col("_v")).select(*df.columns)
    return df.where(F.col(c).isNotNull()).unionByName(filled)


def impute(df: DataFrame, columns: list[str], method: str = "median", drop_share: float | None = None, seed: int = 0) -> DataFrame:
    """Fills nulls: ``median``, ``mean``, ``sample`` (observed values of hashed rank) or ``regression`` on the other columns.

    Rows with fewer than round(columns * drop_share) values go first. ``sample``
    draws with replacement: a null row takes the observed value whose rank its own
    hash names, however the rows are partitioned (rows equal in all columns draw alike). ``regression`` solves the normal equations of mean-filled columns,
    one aggregation for all of them.
    """
    if drop_share is not None:
        df = df.na.drop(thresh=round(len(columns) * drop_share), subset=columns)
    if method in ("median", "mean"):
        f = F.median if method == "median" else F.avg
        row = df.agg(*(f(c).alias(c) for c in columns)).first()
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(row[c])) for c in columns})
    if method == "sample":
        for c in columns:
            df = _draw(df, c, seed)
        return df
    if method != "regression":
        raise ValueError(f"unknown method {method}")
    import numpy as np

    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns}
    terms = [F.lit(1.0), *filled.values()]
    out = df
    new = {}
    for k, c in enumerate(columns):
        use = [t for i, t in enumerate(terms) if i != k + 1]
        row = df.where(F.col(c).isNotNull()).agg(*(F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(use) for j, b in enumerate(use)), *(F.sum(a * F.col(c)).alias(f"y{i}") for i, a in enumerate(use))).first()
        n = len(use)
        beta = np.linalg.lstsq(np.array([[row[f"x{i}_{j}"] for j in range(n)] for i in range(n)], float), np.array([row[f"y{i}"] for i in range(n)], float), rcond=None)[0]
        new[c] = F.coalesce(F.col(c).cast("double"), sum((float(b) * t for b, t in zip(beta, use)), F.lit(0.0)))
    return out.withColumns(new)


def lookup(column: Column, mapping: dict) -> Column:
    """The mapped value; null where there is none."""
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))[column]


def subset_vector(column: Column) -> Column:
    """The signs of a marker combination such as ``IFNg+IL2-`` as an array of 1 and 0."""
    return F.transform(F.regexp_extract_all(column, F.lit("([+-])")), lambda s: (s == "+").cast("int"))


def subset_label(column: Column, markers: list[str], exclude_negative: bool = False) -> Column:
    """An array of 1 and 0 as text over the markers."""
    names = F.array(*map(F.lit, markers))
    signed = F.zip_with(names, column, lambda m, v: F.concat(m, F.when(v == 1, "+").otherwise("-")))
    return F.array_join(F.filter(signed, lambda x: x.endswith("+")) if exclude_negative else signed, "")


def sign_vectors(markers: list[str]) -> list[str]:
    """All combinations of the markers, by number of positives."""
    rows = sorted(product((0, 1), repeat=len(markers)), key=lambda v: (sum(v), v))
    return ["".join(m + "-+"[b] for m, b in zip(markers, v)) for v in rows]
