"""Session helpers: table loading, lineage cuts and their shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` below ``sf_dir``, read by Spark (any Hadoop path)."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver's folder is not theirs.

    On machines that hold the package elsewhere, ship it with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts, visible to driver and executors.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and
    all runs in this process (local tests) a temporary folder is chosen.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later plans read the files, so a lost executor costs nothing that came
    before, and Python work is not repeated by each consumer.
    """
    spark = df.sparkSession
    share_code(spark)
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stage() that nothing reads any more: what came of them is written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
