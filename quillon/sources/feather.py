"""Feather (Arrow IPC) files as a Spark data source: ``spark.read.format("feather")`` and ``df.write.format("feather")``.

Reading: a file is one partition, or several of whole record batches if it is larger than
``split_bytes``; of a schema given to the reader only its columns are read. Writing: each task
writes one file to a folder of its job, and the commit moves the files of the attempts that
succeeded. A job that fails leaves what was there.

Folders are those that every machine sees by pyarrow: local or mounted paths, and stores that
pyarrow has a client for. ``readers.read_feather`` reads through Spark's own file systems.
"""

from __future__ import annotations

import fnmatch
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, SUFFIX, TEMPORARY = "feather", ".feather", "_temporary"


def _store(path: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the visible files of a folder, a pattern of names in a folder, or one file; in order of path."""
    from pyarrow import fs

    store, at = _store(path)
    folder, _, name = at.rpartition("/")
    if "*" in name or "?" in name:
        found = [f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if fnmatch.fnmatch(f.base_name, name)]
    else:
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(at, recursive=True))
            found = [f for f in found if not any(p.startswith(("_", ".")) for p in f.path.removeprefix(at).split("/"))]
        else:
            found = [info]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)


@dataclass
class Part(InputPartition):
    """The ``k``-th of ``n`` runs of a file's record batches."""

    path: str
    k: int
    n: int


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.arrow = path, to_arrow_schema(schema)
        self.split = int(options.get("split_bytes", 128 << 20))

    def partitions(self) -> list[Part]:
        return [Part(path, k, n) for path, size in list_files(self.path) for n in [max(1, -(-size // self.split))] for k in range(n)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as file:
            names = pa.ipc.open_file(file).schema.names
            wanted = [i for i, n in enumerate(names) if n in self.arrow.names]
            source = pa.ipc.open_file(file, options=pa.ipc.IpcReadOptions(included_fields=wanted))
            total = source.num_record_batches
            for k in range(total * partition.k // partition.n, total * (partition.k + 1) // partition.n):
                batch = source.get_batch(k)
                have = {n: batch.column(j) for j, n in enumerate(batch.schema.names)}
                columns = [have[f.name].cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in self.arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, f.type) for f in self.arrow]))


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class FeatherWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, options, overwrite: bool):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.arrow, self.overwrite = path, to_arrow_schema(schema), overwrite
        self.compression = options.get("compression", "lz4")
        self.job = uuid.uuid4().hex
        if self.compression not in ("lz4", "zstd", "uncompressed"):
            raise ValueError(f"no such compression of feather files: {self.compression}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = _store(self.path)
        task = TaskContext.get()
        first = next(iterator, None)
        if first is None and task.partitionId():
            return Written(None, 0)
        name, rows = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}{SUFFIX}", 0
        store.create_dir(f"{at}/{TEMPORARY}/{self.job}", recursive=True)
        options = pa.ipc.IpcWriteOptions(compression=None if self.compression == "uncompressed" else self.compression)
        with store.open_output_stream(f"{at}/{TEMPORARY}/{self.job}/{name}") as out, pa.ipc.new_file(out, self.arrow, options=options) as sink:
            while first is not None:
                sink.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(first.columns, self.arrow)], schema=self.arrow))
                rows += first.num_rows
                first = next(iterator, None)
        return Written(name, rows)

    def commit(self, messages: list[Written]) -> None:
        store, at = _store(self.path)
        old = [p for p, _ in list_files(self.path)] if self.overwrite and store.get_file_info(at).type.name == "Directory" else []
        for m in messages:
            if m is not None and m.name:
                store.move(f"{at}/{TEMPORARY}/{self.job}/{m.name}", f"{at}/{m.name}")
        for path in old:
            store.delete_file(path)
        self._clear()
        with store.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        mine = f"{at}/{TEMPORARY}/{self.job}"
        if store.get_file_info(mine).type == fs.FileType.Directory:
            store.delete_dir(mine)
        left = fs.FileSelector(f"{at}/{TEMPORARY}", allow_not_found=True)
        if store.get_file_info(f"{at}/{TEMPORARY}").type == fs.FileType.Directory and not store.get_file_info(left):
            store.delete_dir(f"{at}/{TEMPORARY}")


class FeatherSource(DataSource):
    """Options: ``path``, ``split_bytes`` (read), ``compression`` (write: lz4, zstd or uncompressed)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files = list_files(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        store, _ = _store(self.options["path"])
        with store.open_input_file(files[0][0]) as file:
            return from_arrow_schema(pa.ipc.open_file(file).schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> FeatherReader:
        return FeatherReader(self.options["path"], schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FeatherWriter:
        return FeatherWriter(self.options["path"], schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. The classes travel by value, so that no worker needs this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FeatherSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Feather files below ``path``; of ``columns`` alone if they are given. Files that lack a column have nulls in it."""
    register(spark)
    if columns is None:
        return spark.read.format(NAME).load(path)
    whole = spark.read.format(NAME).load(path).schema
    return spark.read.format(NAME).schema(StructType([whole[c] for c in columns])).load(path)


def write(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "lz4") -> None:
    register(df.sparkSession)
    df.write.format(NAME).mode(mode).option("compression", compression).save(path)


def merge(spark: SparkSession, paths: list[str], out: str, delete_sources: bool = False) -> str:
    """Unites feather folders by column name, missing columns null, as one feather folder; returns the format written.

    If that fails (a type that the format lacks, a store that pyarrow does not reach) the rows are written as CSV. Sources are
    deleted only after one of the two has succeeded.
    """
    from quillon.sources.sinks import merge_frames, write_csv

    rows = merge_frames([read(spark, p) for p in paths])
    try:
        write(rows, out)
        made = NAME
    except Exception as failed:
        try:
            write_csv(rows, out)
        except Exception:
            raise failed from None
        made = "csv"
    if delete_sources:
        for p in paths:
            store, at = _store(p)
            for path, _ in list_files(p):
                store.delete_file(path)
    return made
