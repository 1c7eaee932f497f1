"""The feather data source: round trips, pruning, splits, commits and failures."""

import os

import pyarrow as pa
import pytest
from pyarrow import feather as arrow_feather
from pyspark.sql import functions as F

from quillon.sources import feather

SF = "/root/testdata/sf0.001"


def test_round_trip_of_lineitem(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").repartition(3)
    path = str(tmp_path / "l")
    feather.write(rows, path, compression="zstd")
    back = feather.read(spark, path)
    assert back.schema == rows.schema and back.count() == rows.count()
    assert rows.exceptAll(back).count() == 0 and back.exceptAll(rows).count() == 0
    names = os.listdir(path)
    assert len([n for n in names if n.endswith(".feather")]) == 3 and "_SUCCESS" in names and "_temporary" not in names
    assert arrow_feather.read_table(f"{path}/{sorted(n for n in names if n[0] == 'p')[0]}").num_rows > 0
    # the name alone works, too
    assert spark.read.format("feather").load(path).agg(F.sum("l_quantity")).first()[0] == rows.agg(F.sum("l_quantity")).first()[0]


def test_columns_and_splits(spark, tmp_path):
    path = str(tmp_path / "one.feather")
    batches = pa.table({"a": list(range(1000)), "b": [f"x{k}" for k in range(1000)], "c": [[k] for k in range(1000)]})
    arrow_feather.write_feather(batches, path, chunksize=100)
    df = feather.read(spark, path, ["b"])
    assert df.columns == ["b"] and df.distinct().count() == 1000
    reader = feather.FeatherReader(path, df.schema, {"split_bytes": "4000"})
    parts = reader.partitions()
    read = [b for p in parts for b in reader.read(p)]
    assert len(parts) > 3 and sum(b.num_rows for b in read) == 1000 and read[0].schema.names == ["b"]
    split = spark.read.format("feather").option("split_bytes", 4000).load(path)
    assert split.rdd.getNumPartitions() == len(parts) and split.agg(F.sum("a")).first()[0] == 499_500


def test_missing_columns_are_null_and_modes(spark, tmp_path):
    a, b, out = (str(tmp_path / n) for n in "abo")
    feather.write(spark.createDataFrame([(1, "x"), (2, None)], "k long, v string"), a)
    feather.write(spark.createDataFrame([(3, 0.5)], "k long, w double"), b)
    assert feather.merge(spark, [a, b], out, delete_sources=True) == "feather"
    assert sorted(map(tuple, feather.read(spark, out).collect())) == [(1, "x", None), (2, None, None), (3, None, 0.5)]
    assert not [n for n in os.listdir(a) if n.endswith(".feather")]
    more = spark.createDataFrame([(9, "y", 1.0)], "k long, v string, w double")
    feather.write(more, out, "append")
    assert feather.read(spark, out).count() == 4
    feather.write(more, out)
    assert [tuple(r) for r in feather.read(spark, out).collect()] == [(9, "y", 1.0)]
    feather.write(more.limit(0), out)
    assert feather.read(spark, out).count() == 0 and feather.read(spark, out).columns == ["k", "v", "w"]


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "f")
    feather.write(spark.range(10), path)
    before = sorted(os.listdir(path))
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        feather.write(broken, path)
    assert sorted(os.listdir(path)) == before and feather.read(spark, path).count() == 10


def test_no_files(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        feather.read(spark, str(tmp_path / "none"))
