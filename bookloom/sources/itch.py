"""ITCH 5.0 captures as event tables: decoder, reader over any file system, and ``format("itch")``.

A file is a run of messages, bare (``unframed``) or each behind a big-endian two-byte
length (``binaryfile``). Adds, deletes, partial cancels, executions and non-cross trades
become events; all other known types carry none (replace only with ``decode_replace``).

``read_itch`` takes files of any Hadoop file system whole, so they must stay under 2 GiB.
``format("itch")`` reads files of any size in blocks: a task holds one block. With
``split_bytes``, framed files are read by many tasks, each from the first place in its
range where a long run of frames fits; ``numbered`` then gives events their numbers.
"""

from __future__ import annotations

import random
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bookloom.schema import ADD, ASK, BID, CANCEL, EVENT_COLUMNS, MODIFY, TRADE

# Message lengths in bytes by type.
LENGTHS = {
    "S": 12, "R": 39, "H": 25, "Y": 20, "L": 26, "V": 35, "W": 12, "K": 28, "J": 35, "h": 21, "A": 36,
    "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40, "B": 19, "I": 50, "N": 20,
}
_LENGTH = [0] * 256
for _type, _n in LENGTHS.items():
    _LENGTH[ord(_type)] = _n
_HEAD = struct.Struct(">xH2xHIQ")  # locate, 48 bits of time, order reference
_ADD = struct.Struct(">cI8sI")
_A, _F, _E, _C, _X, _D, _U, _P, _R = b"AFECXDUPR"


class ItchError(ValueError):
    """An unknown type or a cut-off message in a strict read."""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def decode(m: bytes | memoryview, replace: bool = False) -> tuple | None:
    """(instrument, event type, side, price, quantity, order id, ns since midnight), or None."""
    kind = m[0]
    if len(m) < _LENGTH[kind] or kind not in b"AFECXDPU" or (kind == _U and not replace):
        return None
    locate, high, low, ref = _HEAD.unpack_from(m)
    ts, ref = high << 32 | low, _signed(ref)
    if kind in (_A, _F, _P):
        way, shares, _, price = _ADD.unpack_from(m, 19)
        return locate, TRADE if kind == _P else ADD, BID if way == b"B" else ASK, price, shares, ref, ts
    if kind == _D:
        return locate, CANCEL, 0, 0, 0, ref, ts
    if kind == _U:
        _, shares, price = struct.unpack_from(">QII", m, 19)
        return locate, MODIFY, 0, price, shares, ref, ts
    shares = struct.unpack_from(">I", m, 19)[0]
    if kind == _X:
        return locate, CANCEL, 0, 0, shares, ref, ts
    return locate, TRADE, 0, struct.unpack_from(">I", m, 32)[0] if kind == _C else 0, shares, ref, ts


class Framer:
    """Cuts blocks of a file into (offset, message).

    Loose reads skip an unknown byte (or a frame of odd length) and end at a cut-off tail.
    """

    def __init__(self, framing: str = "unframed", strict: bool = False, offset: int = 0):
        if framing not in ("unframed", "binaryfile"):
            raise ValueError(f"unknown framing {framing!r}")
        self.strict, self.offset, self.rest, self.ended = strict, offset, b"", False
        self.cut = self._frames if framing == "binaryfile" else self._bare

    def feed(self, block: bytes) -> Iterator[tuple[int, memoryview]]:
        raw = self.rest + bytes(block) if self.rest else block
        at = yield from self.cut(memoryview(raw))
        self.rest, self.offset = bytes(raw[at:]), self.offset + at

    def end(self) -> None:
        if self.strict and self.rest and not self.ended:
            raise ItchError("the last message is cut off")

    def _frames(self, view: memoryview) -> Iterator[tuple[int, memoryview]]:
        at, n = 0, len(view)
        while not self.ended and at + 2 <= n:
            size = view[at] << 8 | view[at + 1]
            if not size:
                self.ended = True
            elif at + 2 + size > n:
                break
            else:
                if _LENGTH[view[at + 2]] == size:
                    yield self.offset + at, view[at + 2 : at + 2 + size]
                elif self.strict:
                    raise ItchError("a frame's length is not its type's")
                at += 2 + size
        return n if self.ended else at

    def _bare(self, view: memoryview) -> Iterator[tuple[int, memoryview]]:
        at, n = 0, len(view)
        while at < n:
            size = _LENGTH[view[at]]
            if not size:
                if self.strict:
                    raise ItchError("unknown message type")
                at += 1
            elif at + size > n:
                break
            else:
                yield self.offset + at, view[at : at + size]
                at += size
        return at


def messages(raw: bytes, framing: str = "unframed", strict: bool = False) -> Iterator[memoryview]:
    """Messages of a whole buffer."""
    framer = Framer(framing, strict)
    for _, message in framer.feed(raw):
        yield message
    framer.end()


#: Frames that must fit one after the other to be believed, and how far apart in time the first two may be.
_RUN, _NEAR_NS = 64, 3_600_000_000_000


def first_frame(block: bytes, whole: bool) -> int | None:
    """Where the first run of fitting frames begins in a block of a framed file; shorter runs count at the file's end."""
    view, n = memoryview(block), len(block)
    for start in range(n - 2):
        at, run, times = start, 0, []
        while run < _RUN and at + 2 < n:
            size = view[at] << 8 | view[at + 1]
            if not size or _LENGTH[view[at + 2]] != size or at + 2 + size > n:
                break
            if run < 2:
                times.append(int.from_bytes(view[at + 7 : at + 13], "big"))
            at, run = at + 2 + size, run + 1
        if len(times) == 2 and abs(times[1] - times[0]) > _NEAR_NS:
            continue
        if run == _RUN or (run and whole and at == n):
            return start
    return None


def events_of(raw: bytes, framing: str = "unframed", start_at_ns: int = 0, strict: bool = False, replace: bool = False) -> Iterator[tuple]:
    """Events of a buffer in the order of ``EVENT_COLUMNS``; seq numbers the decoded events from 1."""
    seq = 0
    for m in messages(raw, framing, strict):
        e = decode(m, replace)
        if e is not None:
            seq += 1
            if e[6] >= start_at_ns:
                yield seq, *e


def directory_of(raw: bytes, framing: str = "unframed") -> Iterator[tuple[int, str]]:
    """(instrument, symbol) of the stock directory messages."""
    for m in messages(raw, framing):
        if m[0] == _R:
            yield m[1] << 8 | m[2], bytes(m[11:19]).decode("ascii", "replace").rstrip()


def _tables(rows: Iterable[tuple], path: str, names: list[str], types: list[pa.DataType], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    for row in rows:
        block.append((path, *row))
        if len(block) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names=names)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names=names)


_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_DDL = "path string, seq long, instrument_id int, et int, side int, price long, qty long, order_id long, ts_ns long"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_itch(spark: SparkSession, path: str, framing: str = "unframed", start_at_ns: int = 0, strict: bool = False, replace: bool = False) -> DataFrame:
    """Events of all files at ``path`` (any file system): path and the event columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _tables(events_of(raw, framing, start_at_ns, strict, replace), name, ["path", *EVENT_COLUMNS], _TYPES)

    return _files(spark, path).mapInArrow(run, _DDL)


def read_directory(spark: SparkSession, path: str, framing: str = "unframed") -> DataFrame:
    """instrument_id, symbol: the last directory entry of each instrument."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = ((i, *r) for i, r in enumerate(directory_of(raw, framing)))
                yield from _tables(rows, name, ["path", "at", "instrument_id", "symbol"], [pa.string(), pa.int64(), pa.int32(), pa.string()])

    found = _files(spark, path).mapInArrow(run, "path string, at long, instrument_id int, symbol string")
    return found.groupBy("instrument_id").agg(F.max_by("symbol", F.struct("path", "at")).alias("symbol"))


def instrument_of(directory: DataFrame, symbol: str) -> DataFrame:
    """The directory's rows of a symbol, whatever its case."""
    return directory.filter(F.upper("symbol") == symbol.strip().upper())


def project_fixed(frames: DataFrame) -> DataFrame:
    """Adds and trades decoded by column expressions from a table of single messages (``message`` binary)."""
    number = lambda at, n: F.conv(F.hex(F.substring("message", at + 1, n)), 16, 10).cast("long")
    kind = F.substring("message", 1, 1).cast("string")
    return frames.filter(kind.isin("A", "F", "P")).select(
        number(1, 2).cast("int").alias("instrument_id"),
        F.when(kind == "P", TRADE).otherwise(ADD).alias("et"),
        F.when(F.substring("message", 20, 1).cast("string") == "B", BID).otherwise(ASK).alias("side"),
        number(32, 4).alias("price"), number(20, 4).alias("qty"),
        F.conv(F.hex(F.substring("message", 12, 8)), 16, -10).cast("long").alias("order_id"), number(5, 6).alias("ts_ns"),
    )


def open_store(path: str):
    """(file system, path) of a local path or of a URL that Arrow's file systems know."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files of a folder by name."""
    from pyarrow import fs

    store, at = open_store(path)
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    return [(prefix + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File]


class ItchSource(DataSource):
    """``spark.read.format("itch").option("framing", ...).load(path)``.

    Options: framing, start_at_ns, block_bytes, and split_bytes for framed files. seq numbers
    a file's events, or, in split files, is the place of an event's frame in the file plus 1.
    """

    @classmethod
    def name(cls) -> str:
        return "itch"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return _ItchReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        self.path, self.start, self.stop, self.size = path, start, stop, size


class _ItchReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.framing = options["path"], options.get("framing", "unframed")
        self.start, self.block = int(options.get("start_at_ns", "0")), int(options.get("block_bytes", 8 << 20))
        self.split = int(options.get("split_bytes", "0"))
        if self.split and self.framing != "binaryfile":
            raise ValueError("only framed files can be split")

    def partitions(self):
        out = []
        for path, size in list_files(self.path):
            step = self.split or max(size, 1)
            out += [_Range(path, at, min(at + step, size), size) for at in range(0, max(size, 1), step)]
        return out

    def read(self, partition):
        yield from _tables(self._events(partition), partition.path, ["path", *EVENT_COLUMNS], _TYPES)

    def _events(self, part: _Range) -> Iterator[tuple]:
        store, path = open_store(part.path)
        with store.open_input_file(path) as file:
            at = part.start
            if at:
                file.seek(at)
                found = first_frame(file.read(self.block), at + self.block >= part.size)
                if found is None:
                    return
                at += found
            file.seek(at)
            framer, seq = Framer(self.framing, offset=at), 0
            while not framer.ended and framer.offset < part.stop and (block := file.read(self.block)):
                for place, message in framer.feed(block):
                    if place >= part.stop:
                        return
                    event = decode(message)
                    if event is not None:
                        seq += 1
                        if event[6] >= self.start:
                            yield place + 1 if self.split else seq, *event


def numbered(events: DataFrame) -> DataFrame:
    """Events of split files with seq 1, 2, ... over all files in order of path and place."""
    from bookloom.functions.ranking import global_row_number

    return global_row_number(events.withColumnRenamed("seq", "place"), ["path", "place"], "seq").select("path", *EVENT_COLUMNS)


# ---- Encoding, for captures of our own --------------------------------------------------------


def random_capture(n: int, seed: int, instrument: int = 1, mid: int = 10_000) -> bytes:
    """``n`` messages: three adds to a deletion and a print, roughly.

    Prints carry the reference that the next add will use, so a book that has not seen it yet
    passes over them.
    """
    rng, out, live, next_id = random.Random(seed), [], [], 1
    for k in range(n):
        kind, side = rng.random(), rng.randrange(2)
        price = mid + (1 if side else -1) * rng.randint(1, 50)
        if live and kind < 0.25:
            out.append(encode(CANCEL, instrument, k * 1000, live.pop(rng.randrange(len(live)))))
        elif kind < 0.40:
            out.append(encode(TRADE, instrument, k * 1000, next_id, side, price, rng.randint(1, 100)))
        else:
            out.append(encode(ADD, instrument, k * 1000, next_id, side, price, rng.randint(1, 1000)))
            live.append(next_id)
            next_id += 1
    return b"".join(out)


def encode(et: int, instrument: int, ts: int, order_id: int, side: int = 0, price: int = 0, qty: int = 0, stock: str = "") -> bytes:
    """One message: add (A), full or partial cancel (D, X), execution (E) or print with a price (P)."""
    def head(kind: str) -> bytes:
        return struct.pack(">cHHHIQ", kind.encode(), instrument, 0, ts >> 32, ts & 0xFFFFFFFF, order_id & (2**64 - 1))

    way = b"B" if side == BID else b"S"
    if et == ADD:
        return head("A") + struct.pack(">cI8sI", way, qty, stock.ljust(8).encode(), price)
    if et == CANCEL:
        return head("X") + struct.pack(">I", qty) if qty else head("D")
    if et == TRADE and price:
        return head("P") + struct.pack(">cI8sIQ", way, qty, stock.ljust(8).encode(), price, 0)
    if et == TRADE:
        return head("E") + struct.pack(">IQ", qty, 0)
    raise ValueError(f"no message for event type {et}")


def encode_directory(instrument: int, symbol: str) -> bytes:
    return struct.pack(">cHHHI", b"R", instrument, 0, 0, 0) + symbol.ljust(8).encode() + bytes(LENGTHS["R"] - 19)


def framed(parts: Iterable[bytes]) -> bytes:
    return b"".join(struct.pack(">H", len(p)) + p for p in parts)
