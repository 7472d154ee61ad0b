"""The batch folds as streaming operators, and the sequencer that must stand before them.

A micro-batch's rows of a key are sorted by sequence and stepped through the fold; its
state is kept between batches in the state store, so a restarted query goes on where its
checkpoint ends and gives what one uninterrupted batch gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bookloom.operators.book import TOP, TopOfBook
from bookloom.operators.detectors import Chain
from bookloom.operators.fold import Fold
from bookloom.operators.sequential import DECISION, RISK_COLUMNS, VPIN, Limits, RiskGate, VpinBuckets
from bookloom.schema import EVENT_COLUMNS, FLAG, KINDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = T.StructType().add("blob", T.BinaryType())


def prepare(spark: SparkSession) -> SparkSession:
    """Use the state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class _Stateful(StatefulProcessor):
    """Keeps one pickled object for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def close(self) -> None:
        pass

    def _load(self) -> bytes | None:
        found = self.state.get() if self.state.exists() else None
        return None if found is None else bytes(found[0])


class FoldProcessor(_Stateful):
    def __init__(self, make: Callable[[], Fold], columns: list[str], schema: T.StructType):
        self.make, self.columns, self.schema = make, columns, schema

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))[self.columns].sort_values("seq")
        fold, state = self.make(), self._load()
        if state is not None:
            fold.load(state)
        out = [r for e in zip(*(frame[c].tolist() for c in self.columns)) for r in fold.step(e)]
        self.state.update((fold.dump(),))
        yield _frame(out, self.schema)


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    whole = {T.LongType: "Int64", T.IntegerType: "Int32"}
    columns = list(zip(*rows)) if rows else [() for _ in schema]
    return pd.DataFrame(
        {f.name: pd.Series(list(c), dtype=whole.get(type(f.dataType), "float64" if isinstance(f.dataType, T.DoubleType) else object)) for f, c in zip(schema, columns)}
    )


def stream_fold(events: DataFrame, make: Callable[[], Fold], schema: T.StructType, key: str = "instrument_id", columns: list[str] | None = None) -> DataFrame:
    columns = columns or EVENT_COLUMNS
    grouped = events.select(*columns).groupBy(key)
    return grouped.transformWithStateInPandas(FoldProcessor(make, columns, schema), schema, "Append", "None")


def stream_top_of_book(events: DataFrame, every: int = 1, depth: int = 10) -> DataFrame:
    return stream_fold(events, lambda: TopOfBook(every, depth), TOP)


def stream_chain(events: DataFrame, parameters: dict[str, dict] | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    return stream_fold(events, lambda: Chain(parameters, kinds), FLAG)


def stream_risk(actions: DataFrame, limits: Limits | None = None) -> DataFrame:
    return stream_fold(actions, lambda: RiskGate(limits), DECISION, "desk", RISK_COLUMNS)


def stream_vpin(trades: DataFrame, size: int = 10_000) -> DataFrame:
    """Closed volume buckets; ``trades``: seq, instrument_id, qty, sign."""
    return stream_fold(trades, lambda: VpinBuckets(size), VPIN, columns=["seq", "instrument_id", "qty", "sign"])


class Sequencer(_Stateful):
    """Passes a channel's rows on in gapless sequence; later ones wait, up to ``capacity``, in the state."""

    def __init__(self, schema: T.StructType, expected: int, capacity: int):
        self.schema, self.expected, self.capacity = schema, expected, capacity

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self._load()
        expected, pending = pickle.loads(state) if state is not None else (self.expected, {})
        names = [f.name for f in self.schema]
        at = names.index("seq")
        out = []
        for frame in rows:
            for row in zip(*(frame[c].tolist() for c in names)):
                seq = row[at]
                if seq < expected or seq in pending or (seq > expected and len(pending) >= self.capacity):
                    continue
                pending[seq] = row
                while expected in pending:
                    out.append(pending.pop(expected))
                    expected += 1
        self.state.update((pickle.dumps((expected, pending)),))
        yield _frame(out, self.schema)


def sequence(messages: DataFrame, channel: str, expected: int = 1, capacity: int = 16_384) -> DataFrame:
    """``messages`` (with ``channel`` and seq) in order, without duplicates, up to the first open gap."""
    processor = Sequencer(messages.schema, expected, capacity)
    return messages.groupBy(channel).transformWithStateInPandas(processor, messages.schema, "Append", "None")


def stream_rates(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Events and trades of each instrument and second of event time, once the watermark has passed."""
    rows = events.withColumn("event_time", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long"))).withWatermark("event_time", late)
    return rows.groupBy("instrument_id", F.window("event_time", "1 second").alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.sum((F.col("et") == 4).cast("long")).alias("trades")
    ).select("instrument_id", F.col("w.start").alias("second"), "events", "trades")
