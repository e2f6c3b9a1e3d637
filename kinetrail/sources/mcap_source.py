"""``format("mcap")``: MCAP logs as a Spark data source, read by their chunk index and written with one.

A file's index stands at its end: the source reads the last bytes and the summary section, never the messages, to plan.
Chunks outside the wanted times, or without a wanted topic, are left out; what is left is dealt to partitions of about
``partitionBytes`` consecutive bytes, so that a long log is many tasks, and each task seeks to its own chunks. Filters on ``topic`` and
``log_time`` are pushed down and hold for every row. A file without an index (cut short, or written so) is read from its start in one task.

``path`` is a file, a folder (all ``*.mcap`` below it) or a list of them, in any store that pyarrow.fs opens by its URI. Options, besides
filters: ``topics`` (comma-joined), ``offset`` and ``duration`` in ns from each file's first message (end exclusive).

Writing: each task writes one file in its row order, chunk by chunk, under a name of its attempt; the commit moves the files of
successful attempts into place and removes others, so that a lost executor leaves nothing that is read.

    mcap_source.register(spark)
    spark.read.format("mcap").load(path).where("topic = '/joints' and log_time >= 5")
    rows.write.format("mcap").mode("overwrite").save(path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from kinetrail.sources import mcap

PARTITION_BYTES = 64 << 20
ROWS = 5_000
TAIL = 64 << 10
ARROW = pa.schema([("path", pa.string()), ("topic", pa.string()), ("schema", pa.string()), ("encoding", pa.string()), ("sequence", pa.int64()), ("log_time", pa.int64()), ("publish_time", pa.int64()), ("data", pa.binary())])


@dataclass
class Wanted:
    """Topics and half-open times that rows must have; None is no bound."""

    topics: frozenset[str] | None = None
    low: int | None = None
    high: int | None = None

    def only(self, topics: Sequence[str]) -> None:
        self.topics = frozenset(topics) if self.topics is None else self.topics & frozenset(topics)

    def since(self, low: int) -> None:
        self.low = low if self.low is None else max(self.low, low)

    def until(self, high: int) -> None:
        self.high = high if self.high is None else min(self.high, high)

    def misses(self, start: int, end: int, topics: set[str] | None = None) -> bool:
        """Nothing with times in [start, end] and one of ``topics`` can be wanted."""
        return (self.low is not None and end < self.low) or (self.high is not None and start >= self.high) or (self.topics is not None and topics is not None and not self.topics & topics)


@dataclass
class Part(ds.InputPartition):
    """Chunks of one file, as (offset, length), with the channels they use; without chunks, the file from its start."""

    uri: str
    chunks: list[tuple[int, int]] | None
    channels: dict[int, tuple[str, str, str]]
    wanted: Wanted
    value: object = field(default=None)


def stored_at(uri: str) -> tuple[stores.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return stores.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (stores.LocalFileSystem(), uri)


def opened(uri: str):
    store, path = stored_at(uri)
    return store.open_input_file(path)


def listed(paths: Sequence[str], endings: tuple[str, ...] = (".mcap",)) -> list[str]:
    """Files to read, in order."""
    out = []
    for uri in paths:
        store, path = stored_at(uri)
        head = "file://" if uri.startswith("file:") else uri[: uri.index("://") + 3] if "://" in uri else ""
        info = store.get_file_info(path)
        if info.type == stores.FileType.NotFound:
            raise FileNotFoundError(uri)
        if info.type == stores.FileType.File:
            out.append(uri)
            continue
        found = store.get_file_info(stores.FileSelector(path, recursive=True))
        kept = [f for f in found if f.type == stores.FileType.File and f.path.endswith(endings) and not f.base_name.startswith(("_", "."))]
        out += sorted(head + f.path for f in kept if "/_staged-" not in f.path)  # files of a write that is not committed
    return out


def indexed(uri: str) -> tuple[list[dict], dict[int, tuple[str, str, str]]] | None:
    """(chunks, channels) of a file by its summary; None if it has none. Reads the file's end only."""
    with opened(uri) as file:
        size = file.size()
        tail = file.read_at(min(size, TAIL), max(size - TAIL, 0))
        start = mcap._summary(tail)
        if not start:
            return None
        if size - start <= len(tail):
            raw = tail[len(tail) - (size - start) :]
        else:
            raw = file.read_at(size - start, start)
    schemas, channels, chunks = {0: ""}, {}, []
    for kind, body in mcap._records(raw[: -len(mcap.MAGIC)]):
        if kind == mcap.CHUNK_INDEX:
            chunks.append(mcap.chunk_index(body))
        else:
            mcap.declared(kind, body, schemas, channels)
    return (chunks, channels) if chunks else None


class McapReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options = options
        self.wanted = Wanted()
        if options.get("topics"):
            self.wanted.only([t.strip() for t in options["topics"].split(",")])

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Takes bounds of log_time and sets of topics; gives back the others."""
        for f in filters:
            kind, column = type(f), f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "topic" and kind is ds.EqualTo:
                self.wanted.only([f.value])
            elif column == "topic" and kind is ds.In:
                self.wanted.only([v for v in f.value if v is not None])
            elif column == "log_time" and kind in (ds.GreaterThanOrEqual, ds.GreaterThan):
                self.wanted.since(f.value + (kind is ds.GreaterThan))
            elif column == "log_time" and kind in (ds.LessThan, ds.LessThanOrEqual):
                self.wanted.until(f.value + (kind is ds.LessThanOrEqual))
            elif column == "log_time" and kind is ds.EqualTo:
                self.wanted.since(f.value)
                self.wanted.until(f.value + 1)
            elif kind is not ds.IsNotNull:  # no column of a log is null
                yield f

    def partitions(self) -> list[Part]:
        paths = self.options["path"]
        files = listed(json.loads(paths) if paths.startswith("[") else [paths])
        with ThreadPoolExecutor(16) as pool:  # an index is a read or two of a few KB
            found = pool.map(indexed, files)
            return [p for uri, index in zip(files, found, strict=True) for p in self._parts(uri, index)]

    def _parts(self, uri: str, index) -> list[Part]:
        offset, duration = (int(self.options[k]) if k in self.options else None for k in ("offset", "duration"))
        wanted = Wanted(self.wanted.topics, self.wanted.low, self.wanted.high)
        if index is None:
            if offset is not None or duration is not None:
                raise ValueError(f"{uri} has no index, so that its first time is not known")
            return [Part(uri, None, {}, wanted)]
        chunks, channels = index
        if offset is not None or duration is not None:
            first = min(c["start"] for c in chunks) + (offset or 0)
            wanted.since(first)
            if duration is not None:
                wanted.until(first + duration)
        at_most = int(self.options.get("partitionBytes", PARTITION_BYTES))
        parts: list[list[tuple[int, int]]] = []
        filled = at_most
        for c in sorted(chunks, key=lambda c: c["offset"]):
            topics = {channels[k][0] for k in c["channels"]} if c["channels"] else None
            if wanted.misses(c["start"], c["end"], topics):
                continue
            if filled + c["length"] > at_most:
                parts.append([])
                filled = 0
            parts[-1].append((c["offset"], c["length"]))
            filled += c["length"]
        return [Part(uri, p, channels, wanted) for p in parts]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._messages(part):
            rows.append((part.uri, *row))
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    @staticmethod
    def _messages(part: Part) -> Iterator[tuple]:
        w = part.wanted
        with opened(part.uri) as file:
            if part.chunks is None:
                yield from mcap.parsed(file.read(), w.topics, w.low, w.high)
                return
            for offset, length in part.chunks:
                record = file.read_at(length, offset)
                body = mcap._unpacked(record[9:], w.low, w.high)
                yield from mcap.chunk_messages(body, dict(part.channels), w.topics, w.low, w.high)


@dataclass
class Written(ds.WriterCommitMessage):
    name: str | None


class McapWriter(ds.DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        names = [f.name for f in schema]
        missing = {"topic", "log_time", "data"} - set(names)
        if missing:
            raise ValueError(f"a log needs the columns {sorted(missing)}")
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def _store(self) -> tuple[stores.FileSystem, str]:
        return stored_at(self.options["path"])

    def write(self, rows: Iterator) -> Written:
        store, path = self._store()
        store.create_dir(f"{path}/_staged-{self.job}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.mcap"
        encoding, chunk, how = self.options.get("encoding", "json"), int(self.options.get("chunk", 1000)), self.options.get("compression", "zstd")
        messages = ((r["topic"], r["log_time"], bytes(r["data"]) if not isinstance(r["data"], str) else r["data"].encode()) for r in rows)
        some = False
        with store.open_output_stream(f"{path}/_staged-{self.job}/{name}") as out:
            for piece in mcap.pieces(messages, encoding, chunk, how):
                out.write(piece)
                some = some or piece[0] == mcap.CHUNK
        return Written(name if some else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = self._store()
        if self.overwrite:
            for f in store.get_file_info(stores.FileSelector(path)) if store.get_file_info(path).type == stores.FileType.Directory else []:
                if f.type == stores.FileType.File and f.path.endswith(".mcap"):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{path}/_staged-{self.job}/{m.name}", f"{path}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = self._store()
        if store.get_file_info(staged := f"{path}/_staged-{self.job}").type == stores.FileType.Directory:
            store.delete_dir(staged)


class McapSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        return mcap.ROW

    def reader(self, schema: StructType) -> McapReader:
        return McapReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> McapWriter:
        return McapWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("mcap")`` known, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(McapSource)
