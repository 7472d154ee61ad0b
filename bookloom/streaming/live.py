"""A live feed as a stream: landed packets, put in sequence, decoded; and files replayed at a pace.

A receiver (outside Spark) appends the packets it gets to files of checked records (see
``records.wal_record``) and moves each file into a folder when it is whole. Whatever comes
twice or late through a second receiver or a retransmission is landed in the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bookloom.schema import EVENT, EVENT_COLUMNS
from bookloom.sources.itch import decode
from bookloom.sources.records import BadPacket, parse_packet, wal_payloads
from bookloom.streaming.folds import sequence

_FILES = T.StructType().add("path", T.StringType()).add("modificationTime", T.TimestampType()).add("length", T.LongType()).add("content", T.BinaryType())
MESSAGE = "session string, seq long, payload binary"


def _messages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            rows = []
            for _, packet in wal_payloads(raw.as_py()):
                try:
                    session, first, _, found = parse_packet(packet)
                except BadPacket:
                    continue
                rows += [(session, first + i, m) for i, m in enumerate(found)]
            columns = zip(*rows) if rows else ([], [], [])
            types = [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["session", "seq", "payload"])


def landed_messages(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Messages of all packets in a folder, as a stream: session, seq, payload; malformed packets go."""
    files = spark.readStream.schema(_FILES).format("binaryFile").option("maxFilesPerTrigger", str(files_per_batch)).load(folder)
    return files.select("content").mapInArrow(_messages, MESSAGE)


def _events(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for seq, payload in zip(batch.column("seq").to_pylist(), batch.column("payload").to_pylist()):
            event = decode(payload) if payload else None
            if event is not None:
                rows.append((seq, *event))
        columns = zip(*rows) if rows else [()] * len(EVENT_COLUMNS)
        types = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in EVENT]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=EVENT_COLUMNS)


def live_events(spark: SparkSession, folder: str, expected: int = 1, capacity: int = 16_384, files_per_batch: int = 64) -> DataFrame:
    """Events of a landed feed in gapless sequence, without duplicates, up to the first open gap; seq is the message's."""
    ordered = sequence(landed_messages(spark, folder, files_per_batch), "session", expected, capacity)
    return ordered.select("seq", "payload").mapInArrow(_events, EVENT)


def replayed(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Event tables (Parquet) as a stream, a fixed number of files at a time; the trigger of the query sets the pace."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)
