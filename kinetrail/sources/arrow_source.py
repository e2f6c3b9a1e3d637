"""``format("arrowfile")``: Arrow IPC files as a Spark data source.

A file of the IPC file format has its record batches listed at its end: a partition is a range of ``batches`` of them (16 by default), of
which only the wanted columns are read; the IPC stream format has no such list, so that a file is a partition. Columns are those of the
schema given to ``spark.read.schema(...)``, else all of the first file's. A file that lacks one, or has it with another type, fails the job.
Writing gives one file of the IPC file format a task, moved into place at the commit.

    arrow_source.register(spark)
    spark.read.format("arrowfile").schema("index long, joints array<double>").load(path)
    frames.write.format("arrowfile").mode("append").save(path)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from kinetrail.sources.mcap_source import listed, opened, stored_at

MAGIC = b"ARROW1"
BATCHES = 16


@dataclass
class Part(ds.InputPartition):
    """Batches [begin, end) of a file; of a stream (end -1) all."""

    uri: str
    begin: int
    end: int
    value: object = field(default=None)


def _is_file(source) -> bool:
    head = source.read_at(min(len(MAGIC), source.size()), 0)
    source.seek(0)
    return head == MAGIC


def schema_of(uri: str) -> pa.Schema:
    with opened(uri) as source:
        return pa.ipc.open_file(source).schema if _is_file(source) else pa.ipc.open_stream(source).schema


class ArrowReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[Part]:
        step = int(self.options.get("batches", BATCHES))
        out = []
        for uri in listed([self.options["path"]], (".arrow", ".feather", ".ipc")):
            with opened(uri) as source:
                if not _is_file(source):
                    out.append(Part(uri, 0, -1))
                    continue
                n = pa.ipc.open_file(source).num_record_batches
            out += [Part(uri, k, min(k + step, n)) for k in range(0, n, step)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        with opened(part.uri) as source:
            whole = schema_of(part.uri)
            if missing := [n for n in wanted.names if n not in whole.names]:
                raise ValueError(f"{part.uri} has no column {missing[0]}")
            options = pa.ipc.IpcReadOptions(included_fields=sorted(whole.get_field_index(n) for n in wanted.names))
            if part.end < 0:
                batches: Iterator[pa.RecordBatch] = iter(pa.ipc.open_stream(source, options=options))
            else:
                file = pa.ipc.open_file(source, options=options)
                batches = (file.get_batch(k) for k in range(part.begin, part.end))
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in wanted]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)


@dataclass
class Written(ds.WriterCommitMessage):
    name: str


class ArrowWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.options, self.schema, self.overwrite, self.job = options, schema, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = stored_at(self.options["path"])
        store.create_dir(f"{path}/_staged-{self.job}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.arrow"
        kept = to_arrow_schema(self.schema)
        with store.open_output_stream(f"{path}/_staged-{self.job}/{name}") as out, pa.ipc.new_file(out, kept) as file:
            for batch in batches:
                file.write_batch(pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns, kept, strict=True)], schema=kept))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = stored_at(self.options["path"])
        if self.overwrite:
            for f in store.get_file_info(stores.FileSelector(path)):
                if f.type == stores.FileType.File and f.path.endswith(".arrow"):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(f"{path}/_staged-{self.job}/{m.name}", f"{path}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = stored_at(self.options["path"])
        if store.get_file_info(staged := f"{path}/_staged-{self.job}").type == stores.FileType.Directory:
            store.delete_dir(staged)


class ArrowSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrowfile"

    def schema(self) -> StructType:
        files = listed([self.options["path"]], (".arrow", ".feather", ".ipc"))
        if not files:
            raise ValueError("no Arrow file, so no schema: give one")
        return from_arrow_schema(schema_of(files[0]))

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowSource)
