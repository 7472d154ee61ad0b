"""Binary event logs, write-ahead logs, market-data packets and book snapshots as tables."""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

from bookloom.operators.book import Book
from bookloom.schema import EVENT_COLUMNS
from bookloom.sources.itch import _DDL, _TYPES, _files, _Range, _tables, list_files, open_store

# ---- Event log: 40-byte little-endian records, numbered from 1 ---------------------------------

RECORD = struct.Struct("<QQQQIBB2x")  # ts, price, qty, order id, instrument, type, side
SIZE = RECORD.size


class CorruptLog(ValueError):
    """A log whose size is no multiple of a record."""


def pack_event(event: tuple) -> bytes:
    _, instrument, et, side, price, qty, order_id, ts = event
    return RECORD.pack(ts, price, qty, order_id & (2**64 - 1), instrument, et, side)


def unpack_log(raw: bytes) -> Iterator[tuple]:
    if len(raw) % SIZE:
        raise CorruptLog(f"{len(raw)} bytes are no whole number of {SIZE}-byte records")
    for i, (ts, price, qty, order_id, instrument, et, side) in enumerate(RECORD.iter_unpack(raw)):
        yield i + 1, instrument, et, side, price, qty, order_id - (1 << 64) if order_id >= 1 << 63 else order_id, ts


def _decoded(spark: SparkSession, path: str, decode: Callable[[bytes], Iterable[tuple]], ddl: str, types: list, names: list[str]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _tables(decode(raw), name, names, types)

    return _files(spark, path).mapInArrow(run, ddl)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, unpack_log, _DDL, _TYPES, ["path", *EVENT_COLUMNS])


class EventLogSource(DataSource):
    """``format("eventlog")``: folders of 40-byte records that batches append to, and logs of any size.

    Reading: every task takes a range of whole records of one file; seq is the record's place
    in its file, from 1. Writing appends a file for each task, which a reader meets whole or
    not at all; name and path are in order of the job's time, then of the task.
    """

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("an event log is only appended to")
        return _LogWriter(self.options["path"], [f.name for f in schema])


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split_bytes", 64 << 20)) // SIZE * SIZE or SIZE

    def partitions(self):
        out = []
        for path, size in list_files(self.path):
            if size % SIZE:
                raise CorruptLog(f"{path}: {size} bytes are no whole number of {SIZE}-byte records")
            out += [_Range(path, at, min(at + self.split, size), size) for at in range(0, size, self.split)]
        return out

    def read(self, partition):
        store, path = open_store(partition.path)
        with store.open_input_file(path) as file:
            file.seek(partition.start)
            raw = file.read(partition.stop - partition.start)
        rows = ((partition.start // SIZE + e[0], *e[1:]) for e in unpack_log(raw))
        yield from _tables(rows, partition.path, ["path", *EVENT_COLUMNS], _TYPES)


@dataclass
class _Part(WriterCommitMessage):
    hidden: str
    final: str


class _LogWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.at = path, [names.index(c) for c in EVENT_COLUMNS]
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator):
        from pyspark import TaskContext

        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"log-{self.job}-{task.partitionId():06d}"
        hidden = f"{folder}/.{name}-{task.taskAttemptId()}"
        n = 0
        with store.open_output_stream(hidden) as file:
            for row in iterator:
                file.write(pack_event(tuple(row[i] for i in self.at)))
                n += 1
        if not n:
            store.delete_file(hidden)
        return _Part(hidden if n else "", f"{folder}/{name}.log")

    def commit(self, messages):
        store, _ = open_store(self.path)
        for m in messages:
            if m is not None and m.hidden:
                store.move(m.hidden, m.final)

    def abort(self, messages):
        store, _ = open_store(self.path)
        for m in messages:
            if m is not None and m.hidden:
                store.delete_file(m.hidden)


def append_event_log(events: DataFrame, path: str) -> None:
    """Append events in order of sequence; a range of sequences is a file."""
    events.sparkSession.dataSource.register(EventLogSource)
    rows = events.select(*EVENT_COLUMNS).repartitionByRange("seq").sortWithinPartitions("seq")
    rows.write.format("eventlog").mode("append").save(path)


# ---- Write-ahead log: segments of [length][crc32][payload], little endian ----------------------

_WAL_HEAD = struct.Struct("<II")


def wal_record(payload: bytes) -> bytes:
    return _WAL_HEAD.pack(len(payload), zlib.crc32(payload)) + payload


def wal_payloads(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) up to the first torn or damaged record."""
    at = 0
    while at + 8 <= len(raw):
        size, crc = _WAL_HEAD.unpack_from(raw, at)
        payload = raw[at + 8 : at + 8 + size]
        if len(payload) < size or zlib.crc32(payload) != crc:
            return
        yield at, payload
        at += 8 + size


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, payload of whole records; order by path (segment number) and offset."""
    names, types = ["path", "offset", "payload"], [pa.string(), pa.int64(), pa.binary()]
    return _decoded(spark, path, wal_payloads, "path string, offset long, payload binary", types, names)


def checked(records: DataFrame) -> DataFrame:
    """Rows of (payload, crc) whose check sum holds, by the built-in function."""
    return records.filter(F.crc32("payload") == F.col("crc"))


class Wal:
    """A rotating log in a folder; opening it again cuts a damaged tail."""

    def __init__(self, folder: str, segment_bytes: int = 64 << 20):
        self.folder, self.segment_bytes = Path(folder), segment_bytes
        self.folder.mkdir(parents=True, exist_ok=True)
        segments = sorted(self.folder.glob("wal-*.log"))
        self.number = int(segments[-1].stem[4:]) if segments else 0
        if segments:
            raw = segments[-1].read_bytes()
            whole = sum(8 + len(p) for _, p in wal_payloads(raw))
            if whole < len(raw):
                segments[-1].write_bytes(raw[:whole])
        self._open()

    def _open(self) -> None:
        self.file = (self.folder / f"wal-{self.number:020d}.log").open("ab")

    def append(self, payload: bytes) -> None:
        if self.file.tell() and self.file.tell() + 8 + len(payload) > self.segment_bytes:
            self.file.close()
            self.number += 1
            self._open()
        self.file.write(wal_record(payload))

    def close(self) -> None:
        self.file.close()


# ---- Packets: session[10], sequence, count, then [length][message] each, big endian ------------

_PACKET_HEAD = struct.Struct(">10sQH")
HEARTBEAT, END_OF_SESSION = 0, 0xFFFF


class BadPacket(ValueError):
    """A short header, a body where none may be, or messages that do not fill the packet."""


def packet(session: str, sequence: int, payloads: list[bytes], count: int | None = None) -> bytes:
    body = b"".join(struct.pack(">H", len(p)) + p for p in payloads)
    return _PACKET_HEAD.pack(session.ljust(10).encode(), sequence, len(payloads) if count is None else count) + body


def parse_packet(raw: bytes) -> tuple[str, int, int, list[bytes]]:
    """(session, first sequence, count, messages); heartbeats and the end of session have none."""
    if len(raw) < _PACKET_HEAD.size:
        raise BadPacket("the header is cut off")
    session, sequence, count = _PACKET_HEAD.unpack_from(raw)
    at, found = _PACKET_HEAD.size, []
    if count in (HEARTBEAT, END_OF_SESSION):
        if at != len(raw):
            raise BadPacket("a control packet has a body")
        return session.decode("ascii", "replace").rstrip(), sequence, count, found
    for _ in range(count):
        if at + 2 > len(raw):
            raise BadPacket("a message length is cut off")
        size = raw[at] << 8 | raw[at + 1]
        at += 2
        if at + size > len(raw):
            raise BadPacket("a message is cut off")
        found.append(raw[at : at + size])
        at += size
    return session.decode("ascii", "replace").rstrip(), sequence, count, found


def explode_packets(packets: DataFrame) -> DataFrame:
    """``packets`` (arrival long, packet binary) as messages: session, seq, arrival, payload; malformed ones go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for arrival, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    session, first, _, found = parse_packet(raw)
                except BadPacket:
                    continue
                rows += [(session, first + i, arrival, m) for i, m in enumerate(found)]
            columns = zip(*rows) if rows else ([], [], [], [])
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["session", "seq", "arrival", "payload"])

    return packets.select("arrival", "packet").mapInArrow(run, "session string, seq long, arrival long, payload binary")


# ---- Snapshots: magic, version, sequence, state hash, length, book -----------------------------

_SNAP_HEAD = struct.Struct("<4sIQQI")
MAGIC, VERSION = b"BLSN", 1


class BadSnapshot(ValueError):
    """Cut off, of another kind or version, or with a wrong length."""


def snapshot(seq: int, book: Book) -> bytes:
    data = book.to_bytes()
    return _SNAP_HEAD.pack(MAGIC, VERSION, seq, book.l2_hash(), len(data)) + data


def restore(raw: bytes) -> tuple[int, Book]:
    """(sequence, book); the book's hash must be the stored one."""
    if len(raw) < _SNAP_HEAD.size:
        raise BadSnapshot("cut off")
    magic, version, seq, state, size = _SNAP_HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise BadSnapshot("not a snapshot of this version")
    if size > len(raw) - _SNAP_HEAD.size:
        raise BadSnapshot("the book is cut off")
    book = Book.from_bytes(raw[_SNAP_HEAD.size : _SNAP_HEAD.size + size])
    if book.l2_hash() != state:
        raise BadSnapshot("the book's hash differs")
    return seq, book


def write_snapshot(path: str, seq: int, book: Book) -> None:
    """Under another name first, so that a reader never meets half of it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_bytes(snapshot(seq, book))
    part.replace(target)


def read_snapshot(path: str) -> tuple[int, Book]:
    return restore(Path(path).read_bytes())
