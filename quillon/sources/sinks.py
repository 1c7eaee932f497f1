"""Sinks (SNK1-SNK7): Spark's writers, whose commit protocol keeps a failed write from showing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def merge_frames(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; columns that some lack are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fasta_lines(df: DataFrame, name: str, seq: str, columns: list[str] = (), sep: str = ".") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.concat_ws(sep, name, *columns), F.lit("\n"), F.col(seq)).alias("value"))


def write_fasta(df: DataFrame, path: str, name: str, seq: str, columns: list[str] = (), sep: str = ".") -> None:
    fasta_lines(df, name, seq, columns, sep).write.mode("overwrite").text(path)


def sif_lines(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.concat_ws(" pp ", a, b).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    """Sorted distinct values, one a line."""
    df.distinct().orderBy("value").write.mode("overwrite").text(path)
