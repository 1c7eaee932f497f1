"""Predicates and filters (FLT1-FLT13). Every one is a plan that Catalyst can push into the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID_RESIDUES = "-*BX#Z"


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal all the values."""
    return df.where(_all(F.col(c) == v for c, v in values.items()))


def where_in(df: DataFrame, members: Mapping[str, Iterable]) -> DataFrame:
    """Rows whose columns are in all the lists; pushed down as IN."""
    return df.where(_all(F.col(c).isin(*v) for c, v in members.items()))


def where_dimension(fact: DataFrame, dimension: DataFrame, key: str, members: Mapping[str, Iterable]) -> DataFrame:
    """Fact rows whose dimension row passes the IN-lists: the filtered dimension prunes the fact scan."""
    return fact.join(where_in(dimension, members).select(key).distinct(), key, "left_semi")


def keep_frequent(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """Rows in which every listed column's value has a relative frequency above ``share`` of all rows."""
    total = df.count()
    out = df
    for c in columns:
        common = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share * total).select(F.col(c).alias("_v"))
        out = out.join(common, F.col(c).eqNullSafe(F.col("_v")), "left_semi")
    return out


def drop_sparse(df: DataFrame, min_row: int = 1, min_col: int = 1, min_share: float | None = None, keys: list[str] = ()) -> DataFrame:
    """Drops columns with fewer than ``min_col`` values, then rows with fewer than ``min_row``, until nothing changes.

    ``min_share`` sets both as shares of the other dimension. ``keys`` are neither
    counted nor dropped. One aggregation a round; rounds end since each drops something.
    """
    columns = [c for c in df.columns if c not in keys]
    out = df
    before = None
    while columns:
        counts = out.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in columns)).first()
        if (counts["_rows"], len(columns)) == before:
            break
        before = (counts["_rows"], len(columns))
        least = min_col if min_share is None else min_share * counts["_rows"]
        columns = [c for c in columns if counts[c] >= least]
        row_least = min_row if min_share is None else min_share * len(columns)
        present = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))
        out = out.select(*keys, *columns).where(present >= row_least)
    return out


def discard_low(long: DataFrame, feature: str, sample: str, value: str, share: float = 0.005, presence: float = 0.25) -> DataFrame:
    """Keeps features above ``share`` of the grand total that are positive in more than ``presence`` of the samples."""
    whole = long.agg(F.sum(value).alias("t"), F.count_distinct(sample).alias("n")).first()
    kept = long.groupBy(feature).agg(F.sum(value).alias("_t"), F.count_distinct(F.when(F.col(value) > 0, F.col(sample))).alias("_n"))
    kept = kept.where((F.col("_t") > share * (whole["t"] or 0)) & (F.col("_n") > presence * whole["n"]))
    return long.join(kept.select(feature), feature, "left_semi")


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in the columns."""
    return df.na.drop(subset=columns)


def _class(characters: str) -> str:
    return "[" + "".join(c if c.isalnum() else "\\" + c for c in characters) + "]"


def valid_residues(column: Column, invalid: str = INVALID_RESIDUES) -> Column:
    """Whether a sequence has none of the invalid characters; null is invalid."""
    return F.coalesce(~column.rlike(_class(invalid)), F.lit(False))


def strip_residues(column: Column, invalid: str = INVALID_RESIDUES) -> Column:
    return F.regexp_replace(column, _class(invalid), "")


def censor_background(p: Column, background: Column, cutoff: float, scale: float = 100.0) -> Column:
    """``p``, or null where the scaled background exceeds the cutoff."""
    return F.when(scale * background > cutoff, None).otherwise(p)


def keep_significant(df: DataFrame, index: str, p: str, threshold: float, least: int = 1) -> DataFrame:
    """All rows of index values that have ``least`` or more rows with p at most the threshold."""
    hits = df.where(F.col(p) <= threshold).groupBy(index).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(hits.select(index), index, "left_semi")


def any_flag(df: DataFrame, flags: list[str], keep: list[str], fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """The columns ``keep`` of rows with any of the Boolean flags; a Bernoulli sample if the fraction is below 1."""
    out = df.where(_any(F.col(f"`{c}`") for c in flags))
    if fraction < 1:
        out = out.sample(fraction=fraction, seed=seed)
    return out.select(*(f"`{c}`" for c in keep))


def clamp(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(column, F.lit(high)))
