"""Sources (SRC1-SRC14): delimited, columnar, FASTA, configuration and assay tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.columns import clean_id, floor_log10


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header and a declared schema; leading blanks are dropped. Pruned columns are not parsed."""
    return spark.read.csv(path, header=True, schema=schema, sep=sep, ignoreLeadingWhiteSpace=True)


def read_feather(spark: SparkSession, paths: str, columns: list[str] | None = None) -> DataFrame:
    """Arrow IPC (feather) files below any Hadoop path: one task a file, columns pruned at the read."""
    import io

    import pyarrow as pa
    from pyarrow import feather
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    first = files.limit(1).collect()
    if not first:
        raise FileNotFoundError(paths)
    schema = from_arrow_schema(feather.read_table(io.BytesIO(first[0]["content"]), columns=columns).schema)

    def read(batches):
        for batch in batches:
            for content in batch.column(1):
                table = feather.read_table(io.BytesIO(content.as_py()), columns=columns)
                yield from table.select([f.name for f in schema.fields]).cast(pa.schema([table.schema.field(f.name) for f in schema.fields])).to_batches()

    return files.mapInArrow(read, schema)


def read_fasta(spark: SparkSession, path: str, columns: list[str] = ("clade", "country", "year", "name", "seqid"), sep: str = ".") -> DataFrame:
    """One row a record: the header's parts by name (missing ones empty), the joined sequence, and a unique id."""
    raw = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    head = F.trim(F.regexp_extract("value", r"^([^\n]*)", 1))
    rows = raw.select(head.alias("header"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    parts = F.split("header", "[" + sep + "]")
    named = rows.select("header", *(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)), "seq")
    copy = F.row_number().over(Window.partitionBy("header").orderBy("seq")) - 1
    return named.withColumn("uid", F.concat_ws("_", copy, "header"))


def read_config(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """A small (type, name, value) file as dictionaries by type; a null name is its value."""
    rows = spark.read.csv(path, header=True, schema="type string, name string, value string").select("type", F.coalesce("name", "value").alias("name"), "value").collect()
    out: dict[str, dict[str, str]] = {"subset": {}, "marker": {}, "function": {}, "exclude": {}}
    for r in rows:
        out.setdefault(r["type"], {})[r["name"]] = r["value"]
    return out


def read_batches(spark: SparkSession, pattern: str, fmt: str = "parquet", **options) -> DataFrame:
    """Files of many batch folders in one scan, with their file name and batch (the folder)."""
    return spark.read.format(fmt).options(**options).load(pattern).select("*", F.col("_metadata.file_name").alias("file_name")).withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def wide_signs(df: DataFrame, key: str) -> DataFrame:
    """Wide columns such as ``!A&B`` to long rows: key, markers as an array, signs as 1 and 0, value."""
    cols = [c for c in df.columns if c != key]
    long = df.unpivot([key], cols, "column", "value")
    parts = F.split("column", "&")
    return long.select(key, F.transform(parts, lambda x: F.regexp_replace(x, "^!", "")).alias("markers"), F.transform(parts, lambda x: (~x.startswith("!")).cast("int")).alias("signs"), "value")


def split_id(column: Column) -> list[Column]:
    """``antigen:ptid:visit`` in quotes, by part."""
    p = F.split(F.regexp_replace(column, '"', ""), ":")
    return [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("antigen", "ptid", "visit"))]


def parse_assay(df: DataFrame, kind: str, ptid: str, magnitude: str, limit: float | None = None) -> DataFrame:
    """Clean ids and a log10 magnitude: ics is floored at 0.00025, bama at its limit with 1 added, nab not at all."""
    m = F.col(magnitude)
    value = {"ics": lambda: floor_log10(m, 0.00025), "bama": lambda: floor_log10(m, limit, 1.0), "nab": lambda: floor_log10(m)}[kind]()
    return df.withColumn(ptid, clean_id(F.col(ptid))).withColumn(magnitude, value)
