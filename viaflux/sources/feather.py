"""Feather (Arrow IPC) files, read and written by the tasks, batch by batch.

Where Arrow itself knows the file system (`ARROW_SCHEMES`), no data passes the
driver: a task writes its partition as a part and names it, the driver removes
the parts of lost attempts, and a reading task takes some record batches of one
file. Other file systems are written through the driver, part by part, and
read as binary values, which bounds a file there to 2 GB.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from . import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: File systems that Arrow opens in a task by the same address as Spark.
ARROW_SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs")
#: Record batches that one reading task takes.
BATCHES_A_TASK = 64


def _plain(table: pa.Table) -> pa.Table:
    """Without dictionaries and views, which Spark's rows don't have."""
    arrays, fields = [], []
    for f, c in zip(table.schema, table.columns, strict=True):
        kind = f.type.value_type if pa.types.is_dictionary(f.type) else f.type
        kind = pa.string() if pa.types.is_large_string(kind) else kind
        arrays.append(c.cast(kind))
        fields.append(pa.field(f.name, kind))
    return pa.table(arrays, schema=pa.schema(fields))


def _schema_of(source) -> T.StructType:
    with ipc.open_file(source) as f:
        return from_arrow_schema(_plain(f.schema.empty_table()).schema, prefer_timestamp_ntz=False)


def _open(address: str):
    system, at = pafs.FileSystem.from_uri(address)
    return system.open_input_file(at)


def _cast(batch: pa.RecordBatch, kind: pa.Schema) -> list[pa.RecordBatch]:
    return _plain(pa.Table.from_batches([batch])).cast(kind).to_batches()


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Feather file, or a folder of such files; each task reads some record batches of one file."""
    fs = files.FileSystem(spark, path)
    names = [path] if not fs.is_dir(path) else [f"{path}/{n}" for n in fs.names(path) if n.endswith(".feather")]
    if not names:
        raise FileNotFoundError(path)
    addresses = [fs.qualified(n) for n in names]
    if urlsplit(addresses[0]).scheme not in ARROW_SCHEMES:
        return _read_binary(spark, names)
    with _open(addresses[0]) as source:
        schema = _schema_of(source)
    kind = to_arrow_schema(schema)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                with _open(address) as source, ipc.open_file(source) as f:
                    begins = list(range(0, f.num_record_batches, BATCHES_A_TASK))
                yield pa.RecordBatch.from_arrays([pa.array([address] * len(begins), pa.string()), pa.array(begins, pa.int32())], names=["address", "begin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["address"]) as source, ipc.open_file(source) as f:
                    for k in range(row["begin"], min(row["begin"] + BATCHES_A_TASK, f.num_record_batches)):
                        yield from _cast(f.get_batch(k), kind)

    listed = spark.createDataFrame([(a,) for a in addresses], "address string").repartition(min(len(addresses), 1000))
    # names and numbers only: one small row for each of a task's spans
    found = sorted(tuple(r) for r in listed.mapInArrow(spans, "address string, begin int").collect())
    if not found:
        return spark.createDataFrame([], schema)
    plan = spark.sparkContext.parallelize(found, len(found))
    return spark.createDataFrame(plan, "address string, begin int").mapInArrow(run, schema)


def _read_binary(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    binary = spark.read.format("binaryFile").load(list(names))
    schema = _schema_of(pa.BufferReader(bytes(binary.select("content").first()["content"])))
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with ipc.open_file(pa.BufferReader(content.as_py())) as f:
                    for k in range(f.num_record_batches):
                        yield from _cast(f.get_batch(k), kind)

    return binary.select("content").mapInArrow(run, schema)


def _encoded(batch: pa.RecordBatch, known: dict[str, pa.Array]) -> pa.RecordBatch:
    """`batch` with dictionaries for the columns of `known`, each an extension of the one before."""
    for name, values in known.items():
        k = batch.schema.get_field_index(name)
        column = batch.column(k)
        fresh = pc.unique(column).drop_null()
        fresh = fresh.filter(pc.invert(pc.is_in(fresh, value_set=values)))
        known[name] = values = pa.concat_arrays([values, fresh])
        batch = batch.set_column(k, name, pa.DictionaryArray.from_arrays(pc.index_in(column, value_set=values), values))
    return batch


def _pour(first: pa.RecordBatch, rest: Iterable[pa.RecordBatch], sink, codec: str | None, categorical: Sequence[str]) -> None:
    """Writes batches one at a time; dictionaries grow by deltas."""
    known = {n: pa.array([], first.schema.field(n).type) for n in categorical}
    head = _encoded(first, known)
    options = ipc.IpcWriteOptions(compression=codec, emit_dictionary_deltas=True)
    with ipc.new_file(sink, head.schema, options=options) as out:
        out.write_batch(head)
        for batch in rest:
            out.write_batch(_encoded(batch, known))


def write(fs: files.FileSystem, df: DataFrame, path: str, compression: str, categorical: Sequence[str] = ()) -> None:
    """A folder of Feather parts, one for each partition that has rows; texts of `categorical` get a dictionary."""
    codec = None if compression == "uncompressed" else compression
    address = fs.qualified(path)
    if urlsplit(address).scheme in ARROW_SCHEMES:
        wrote = _write_by_tasks(fs, df, path, address, codec, categorical)
    else:
        wrote = _write_by_driver(fs, df, path, codec, categorical)
    if not wrote:
        sink = io.BytesIO()
        with ipc.new_file(sink, to_arrow_schema(df.schema)):
            pass
        fs.write_bytes(f"{path}/part-00000.feather", sink.getvalue())


def _write_by_tasks(fs: files.FileSystem, df: DataFrame, path: str, address: str, codec: str | None, categorical: Sequence[str]) -> bool:
    fs.make(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.feather"
        system, at = pafs.FileSystem.from_uri(address)
        with system.open_output_stream(f"{at}/{name}") as sink:
            _pour(first, batches, sink, codec, categorical)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    won = {r["name"] for r in df.mapInArrow(run, "name string").collect()}
    for name in fs.names(path):
        if name not in won:  # a lost or doubled attempt's
            fs.delete(f"{path}/{name}")
    return bool(won)


def _write_by_driver(fs: files.FileSystem, df: DataFrame, path: str, codec: str | None, categorical: Sequence[str]) -> bool:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        sink = io.BytesIO()
        _pour(first, batches, sink, codec, categorical)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary())], names=["content"])

    wrote = False
    for row in df.mapInArrow(run, "content binary").withColumn("part", F.spark_partition_id()).toLocalIterator():
        fs.write_bytes(f"{path}/part-{row['part']:05d}.feather", bytes(row["content"]))
        wrote = True
    return wrote
