"""MCAP logs as message rows, and message rows as MCAP bytes.

Files come through Spark's binary reader, one a row, so any store that Spark reads will do; a
file must fit in a task (Spark's limit for one is 2 GB). Topics and times cut a file down
before its messages become rows. Where a file's summary repeats its channels, chunks outside the
time range are not even decompressed; without, an early chunk may declare what later ones use.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the public container format.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, DATA_END = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0F
MESSAGE_INDEX, CHUNK_INDEX, STATISTICS = 0x07, 0x08, 0x0B
ROW = "path string, topic string, schema string, encoding string, sequence long, log_time long, publish_time long, data binary"


def _records(raw: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 9 <= len(raw):
        kind, size = struct.unpack_from("<BQ", raw, at)
        yield kind, raw[at + 9 : at + 9 + size]
        at += 9 + size


def _text(raw: bytes, at: int) -> tuple[str, int]:
    (size,) = struct.unpack_from("<I", raw, at)
    return raw[at + 4 : at + 4 + size].decode(), at + 4 + size


def _summary(raw: bytes) -> int:
    """Where the summary section begins; 0 if there is none or the file is cut short."""
    at = len(raw) - len(MAGIC) - 29
    if at < 0 or not raw.endswith(MAGIC) or raw[at] != FOOTER:
        return 0
    return struct.unpack_from("<Q", raw, at + 9)[0]


def _unpacked(chunk: bytes, low: int | None, high: int | None) -> bytes:
    """The records of a chunk, none if it lies outside the times."""
    start, end, size, _ = struct.unpack_from("<QQQI", chunk)
    if (low is not None and end < low) or (high is not None and start >= high):
        return b""
    how, at = _text(chunk, 28)
    body = chunk[at + 8 :]
    if how == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    if how == "lz4":
        return pa.Codec("lz4").decompress(body, size, asbytes=True)
    if how:
        raise ValueError(f"compression {how} is not supported")
    return body


def declared(kind: int, body: bytes, schemas: dict, channels: dict) -> None:
    """Notes the name of a schema record, or (topic, schema, encoding) of a channel record."""
    if kind == SCHEMA:
        schemas[struct.unpack_from("<H", body)[0]] = _text(body, 2)[0]
    elif kind == CHANNEL:
        number, schema = struct.unpack_from("<HH", body)
        topic, at = _text(body, 4)
        channels[number] = (topic, schemas.get(schema, ""), _text(body, at)[0])


def chunk_index(body: bytes) -> dict:
    """start, end (times), offset, length of a chunk, and the numbers of its channels."""
    start, end, offset, length, size = struct.unpack_from("<QQQQI", body)
    return {"start": start, "end": end, "offset": offset, "length": length, "channels": [struct.unpack_from("<H", body, 36 + k)[0] for k in range(0, size, 10)]}


def _row(body: bytes, channels: dict, wanted: frozenset | set | None, low: int | None, high: int | None) -> tuple | None:
    number, sequence, log_time, publish_time = struct.unpack_from("<HIQQ", body)
    channel = channels[number]
    if (wanted is None or channel[0] in wanted) and (low is None or log_time >= low) and (high is None or log_time < high):
        return (*channel, sequence, log_time, publish_time, body[22:])
    return None


def chunk_messages(body: bytes, channels: dict, wanted: frozenset | set | None, low: int | None, high: int | None) -> Iterator[tuple]:
    """Messages of an opened chunk; ``channels`` knows those that other chunks declare."""
    schemas = {0: ""}
    for kind, record in _records(body):
        if kind == MESSAGE:
            if row := _row(record, channels, wanted, low, high):
                yield row
        elif kind == SCHEMA or (kind == CHANNEL and struct.unpack_from("<H", record)[0] not in channels):
            declared(kind, record, schemas, channels)


def parsed(raw: bytes, topics: Iterable[str] | None = None, low: int | None = None, high: int | None = None) -> Iterator[tuple]:
    """Messages of a file: (topic, schema, encoding, sequence, log_time, publish_time, data), low <= log_time < high."""
    if not raw.startswith(MAGIC):
        raise ValueError("not an MCAP file")
    wanted, schemas, channels = None if topics is None else set(topics), {0: ""}, {}
    summary = _summary(raw)
    for kind, body in _records(raw[: -len(MAGIC)], summary) if summary else ():
        declared(kind, body, schemas, channels)
    span = (low, high) if channels else (None, None)
    stack = [_records(raw, len(MAGIC))]
    while stack:
        for kind, body in stack[-1]:
            declared(kind, body, schemas, channels)
            if kind == MESSAGE:
                if row := _row(body, channels, wanted, low, high):
                    yield row
            elif kind == CHUNK:
                stack.append(_records(_unpacked(body, *span)))
                break
            elif kind == DATA_END:
                return
        else:
            stack.pop()


def read(spark: SparkSession, path: str, topics: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Messages of all files at ``path``, within topics and [low, high) of log time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["topic", "schema", "encoding", "sequence", "log_time", "publish_time", "data"]
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                out = []
                for message in parsed(raw, topics, low, high):
                    out.append(message)
                    if len(out) == 5_000:
                        yield pd.DataFrame(out, columns=names).assign(path=name)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=names).assign(path=name)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.mcap").load(path).select("path", "content").mapInPandas(rows, ROW)


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(body)) + body


def _string(text: str) -> bytes:
    return struct.pack("<I", len(text.encode())) + text.encode()


def pieces(messages: Iterable[tuple[str, int, bytes]], encoding: str = "json", chunk: int = 1000, compression: str = "zstd", summary: bool = True) -> Iterator[bytes]:
    """The bytes of a file of (topic, log_time, data) in order, a record or a few at a time.

    Channels are declared where they are first used. The summary repeats them and has an index of the chunks (their
    times, places and channels) and counts. A piece that begins a chunk begins with its record's kind.
    """
    numbers: dict[str, int] = {}
    counts: dict[int, int] = {}
    index: list[bytes] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def channel(topic: str) -> bytes:
        return _record(CHANNEL, struct.pack("<HH", numbers[topic], 0) + _string(topic) + _string(encoding) + struct.pack("<I", 0))

    def pairs(kind: str, rows: Iterable[tuple[int, int]]) -> bytes:
        body = b"".join(struct.pack(kind, *r) for r in rows)
        return struct.pack("<I", len(body)) + body

    def closed(held: list[tuple[str, int, bytes]]) -> tuple[bytes, bytes]:
        """A chunk of messages and its message indexes."""
        fresh = sorted({m[0] for m in held} - set(numbers))
        numbers.update({topic: len(numbers) + 1 + k for k, topic in enumerate(fresh)})
        body = bytearray(b"".join(map(channel, fresh)))
        places: dict[int, list[tuple[int, int]]] = {}
        for k, (topic, time, data) in enumerate(held):
            places.setdefault(numbers[topic], []).append((time, len(body)))
            body += _record(MESSAGE, struct.pack("<HIQQ", numbers[topic], k, time, time) + data)
        size, raw = len(body), bytes(body)
        if compression == "zstd":
            import zstandard

            raw = zstandard.ZstdCompressor().compress(raw)
        elif compression == "lz4":
            raw = pa.Codec("lz4").compress(raw, asbytes=True)
        times = [m[1] for m in held]
        spans.append((min(times), max(times)))
        record = _record(CHUNK, struct.pack("<QQQI", *spans[-1], size, 0) + _string(compression) + struct.pack("<Q", len(raw)) + raw)
        after, where = bytearray(), []
        for number, rows in places.items():
            counts[number] = counts.get(number, 0) + len(rows)
            where.append((number, at + len(record) + len(after)))
            after += _record(MESSAGE_INDEX, struct.pack("<H", number) + pairs("<QQ", rows))
        index.append(_record(CHUNK_INDEX, struct.pack("<QQQQ", *spans[-1], at, len(record)) + pairs("<HQ", where) + struct.pack("<Q", len(after)) + _string(compression) + struct.pack("<QQ", len(raw), size)))
        return record, bytes(after)

    first = MAGIC + _record(HEADER, _string("") + _string("kinetrail"))
    at += len(first)
    yield first
    held: list[tuple[str, int, bytes]] = []
    for message in messages:
        held.append(message)
        if len(held) == chunk:
            for piece in closed(held):
                at += len(piece)
                yield piece
            held = []
    if held:
        for piece in closed(held):
            at += len(piece)
            yield piece
    end = _record(DATA_END, struct.pack("<I", 0))
    at += len(end)
    yield end
    start = at if numbers and summary else 0
    if start:
        yield b"".join(map(channel, numbers))
        yield _record(STATISTICS, struct.pack("<QHIIIIQQ", sum(counts.values()), 0, len(numbers), 0, 0, len(index), min(s for s, _ in spans), max(e for _, e in spans)) + pairs("<HQ", counts.items()))
        yield b"".join(index)
    yield _record(FOOTER, struct.pack("<QQI", start, 0, 0)) + MAGIC


def packed(messages: Iterable[tuple[str, int, bytes]], encoding: str = "json", chunk: int = 1000, compression: str = "zstd", summary: bool = True) -> bytes:
    """A file of (topic, log_time, data) in order."""
    return b"".join(pieces(messages, encoding, chunk, compression, summary))
