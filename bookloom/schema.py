"""Event columns, codes and labels shared by all market operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event types, sides and pattern kinds by code.
ADD, CANCEL, MODIFY, TRADE, SNAPSHOT = 1, 2, 3, 4, 5
BID, ASK = 0, 1
EVENT_LABELS = {1: "add", 2: "cancel", 3: "modify", 4: "trade", 5: "snapshot"}
SIDE_LABELS = {0: "bid", 1: "ask"}
KINDS = (
    "QuoteStuff",
    "Spoof",
    "PhantomLiquidity",
    "CancellationStorm",
    "MomentumIgnition",
    "FlashCrash",
    "LatencyArbitrage",
)
REGIMES = ("Calm", "Volatile", "Aggressive", "Crisis")

#: One market event; prices are integer ticks, order_id keeps all 64 bits.
EVENT = (
    T.StructType()
    .add("seq", T.LongType())
    .add("instrument_id", T.IntegerType())
    .add("et", T.IntegerType())
    .add("side", T.IntegerType())
    .add("price", T.LongType())
    .add("qty", T.LongType())
    .add("order_id", T.LongType())
    .add("ts_ns", T.LongType())
)
EVENT_COLUMNS = [f.name for f in EVENT]

FLAG = (
    T.StructType()
    .add("instrument_id", T.IntegerType())
    .add("emit_seq", T.LongType())
    .add("detector_ord", T.IntegerType())
    .add("kind", T.StringType())
    .add("start_seq", T.LongType())
    .add("end_seq", T.LongType())
    .add("start_ts_ns", T.LongType())
    .add("end_ts_ns", T.LongType())
    .add("severity", T.DoubleType())
    .add("initiator", T.LongType())
    .add("event_count", T.LongType())
    .add("duration_ns", T.LongType())
    .add("cancel_trade_ratio", T.DoubleType())
    .add("price_displacement", T.LongType())
    .add("depth_removed", T.LongType())
)


def label(code: Column, labels: dict[int, str]) -> Column:
    """The label of a code, null if there is none."""
    out = F.lit(None).cast("string")
    for value, name in labels.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out
