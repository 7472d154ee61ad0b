"""Small-state folds: VPIN buckets, velocity baseline, episodes, the risk gate, the gap tracker."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bookloom.functions import scalars
from bookloom.operators.fold import Fold, run

# ---- VPIN -------------------------------------------------------------------------------------

VPIN = (
    T.StructType()
    .add("instrument_id", T.IntegerType()).add("seq", T.LongType()).add("bucket", T.LongType())
    .add("buy", T.LongType()).add("sell", T.LongType())
)


class VpinBuckets(Fold):
    """Volume buckets of signed trades; a bucket that closes discards its overflow.

    Input: seq, instrument, quantity, sign. Sign 0 splits the print, the odd unit is a sell.
    """

    def __init__(self, size: int):
        self.size, self.buy, self.sell, self.n = size, 0, 0, 0

    def step(self, event: tuple) -> Iterable[tuple]:
        seq, instrument, qty, sign = event
        if not qty:
            return ()
        bought = qty if sign == 1 else 0 if sign == -1 else qty // 2
        self.buy += bought
        self.sell += qty - bought
        if self.buy + self.sell < self.size:
            return ()
        self.n += 1
        row = (instrument, seq, self.n, self.buy, self.sell)
        self.buy = self.sell = 0
        return (row,)


def vpin(trades: DataFrame, size: int = 10_000, buckets: int = 50) -> DataFrame:
    """instrument_id, seq, bucket, buy, sell, vpin at each closed bucket; ``trades``: seq, qty, sign."""
    closed = run(trades, lambda: VpinBuckets(size), VPIN, columns=["seq", "instrument_id", "qty", "sign"])
    frame = Window.partitionBy("instrument_id").orderBy("bucket").rowsBetween(1 - buckets, 0)
    skew = F.sum(F.abs(F.col("buy") - F.col("sell"))).over(frame)
    return closed.withColumn("vpin", skew / (F.count(F.lit(1)).over(frame) * size))


def signed_trades(tops: DataFrame) -> DataFrame:
    """seq, instrument_id, qty, sign of trades with the quotes before them (``pre_bid``, ``pre_ask``).

    A print's price, or the best of its side if it has none, tells the aggressor. Where neither
    is known no print is shown, and the raw side stands for the sign: a bid buys.
    """
    price = scalars.repaired_price(F.col("price"), F.col("side"), F.col("pre_bid"), F.col("pre_ask"))
    raw = F.when(F.col("side") == 0, 1).otherwise(-1)
    sign = F.when(price.isNull(), raw).otherwise(scalars.aggressor(price, F.col("pre_bid"), F.col("pre_ask")))
    return tops.filter("et = 4").select("seq", "instrument_id", "qty", sign.cast("int").alias("sign"))


# ---- Velocity ---------------------------------------------------------------------------------


VELOCITY = (
    T.StructType()
    .add("instrument_id", T.IntegerType()).add("second", T.LongType()).add("trades", T.LongType())
    .add("baseline", T.DoubleType()).add("velocity", T.DoubleType())
)


class Velocity(Fold):
    """Input, a row a second: second, instrument, trades."""

    def __init__(self, keep: float):
        self.keep, self.base = keep, 0.0

    def step(self, event: tuple) -> Iterable[tuple]:
        second, instrument, trades = event
        self.base = self.base * self.keep + trades * (1 - self.keep) if self.base else float(trades)
        return ((instrument, second, trades, self.base, trades / self.base if self.base > 0 else 0.0),)


def velocity(rates: DataFrame, keep: float = 0.875) -> DataFrame:
    """Trades a second against their exponential mean, seeded by the first second with trades.

    ``rates``: instrument_id, second, trades.
    """
    rows = rates.select(F.col("second").alias("seq"), "instrument_id", F.col("trades").cast("long").alias("trades"))
    return run(rows, lambda: Velocity(keep), VELOCITY, columns=["seq", "instrument_id", "trades"])


# ---- Episodes ---------------------------------------------------------------------------------

EPISODE = (
    T.StructType()
    .add("instrument_id", T.IntegerType()).add("episode", T.LongType()).add("kind", T.StringType()).add("initiator", T.LongType())
    .add("start_seq", T.LongType()).add("end_seq", T.LongType()).add("start_ts_ns", T.LongType()).add("end_ts_ns", T.LongType())
    .add("seq", T.LongType()).add("severity", T.DoubleType())
)
#: Two kinds that make one episode whoever is behind them.
_PAIR = frozenset({"FlashCrash", "MomentumIgnition"})


@dataclass
class _Episode:
    kind: str
    initiator: int | None
    end: int
    end_ts: int

    def admits(self, kind: str, initiator: int | None) -> bool:
        same = (kind, initiator) == (self.kind, self.initiator) and initiator is not None
        return same or frozenset({kind, self.kind}) == _PAIR

    def extend(self, end: int, end_ts: int) -> None:
        self.end, self.end_ts = max(self.end, end), max(self.end_ts, end_ts)


class Clusterer(Fold):
    """Tags each flag with its episode and the episode's bounds so far.

    Input, by place in start order: place, instrument, start, end, start_ts, end_ts, kind, initiator, severity.
    A flag joins the current episode if it starts within a gap (of sequence or of time; 0
    switches one off) of its end, and is of the same kind and known initiator, or if the two
    kinds are a crash and an ignition.
    """

    def __init__(self, gap: int, gap_ns: int = 0):
        self.gap, self.gap_ns = gap, gap_ns
        self.n = 0
        self.now: _Episode | None = None

    def step(self, event: tuple) -> Iterable[tuple]:
        _, instrument, start, end, start_ts, end_ts, kind, initiator, severity = event
        now = self.now
        gaps = () if now is None else ((self.gap, start - now.end), (self.gap_ns, start_ts - now.end_ts))
        if any(most and far <= most for most, far in gaps) and now.admits(kind, initiator):
            now.extend(end, end_ts)
        else:
            self.n += 1
            now = self.now = _Episode(kind, initiator, end, end_ts)
        return ((instrument, self.n, now.kind, now.initiator, start, now.end, start_ts, now.end_ts, start, severity),)


def episodes(flags: DataFrame, gap: int = 64, gap_ns: int = 0) -> DataFrame:
    """Episodes of flags (schema.FLAG): bounds, kind and initiator of the first flag, count, severities."""
    # Ties of the start keep the order of emission.
    place = F.row_number().over(Window.partitionBy("instrument_id").orderBy("start_seq", "emit_seq", "detector_ord"))
    columns = ["seq", "instrument_id", "start_seq", "end_seq", "start_ts_ns", "end_ts_ns", "kind", "initiator", "severity"]
    tagged = run(flags.withColumn("seq", place.cast("long")), lambda: Clusterer(gap, gap_ns), EPISODE, columns=columns)
    out = tagged.groupBy("instrument_id", "episode").agg(
        F.first("kind").alias("kind"), F.first("initiator").alias("initiator"), F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq"),
        F.min("start_ts_ns").alias("start_ts_ns"), F.max("end_ts_ns").alias("end_ts_ns"), F.count(F.lit(1)).alias("n_flags"),
        F.max("severity").alias("peak_severity"), F.avg("severity").alias("mean_severity"),
    )
    return out.withColumn("composite_severity", F.col("peak_severity") * (1 + F.log(F.col("n_flags"))))


# ---- Risk gate --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """None switches a check off."""

    orders_per_sec: int | None = 5_000
    position: int | None = 10_000
    loss: int | None = 5_000_000_000
    order_to_trade: float | None = 100.0
    order_to_trade_warmup: int = 100
    gaps: int | None = 16
    gap_window_ns: int = 60_000_000_000


DECISION = (
    T.StructType()
    .add("desk", T.IntegerType()).add("seq", T.LongType()).add("action", T.StringType()).add("allowed", T.BooleanType())
    .add("reason", T.StringType()).add("orders", T.LongType()).add("trades", T.LongType()).add("cash", T.LongType()).add("exposure", T.LongType())
)
RISK_COLUMNS = ["seq", "desk", "ts_ns", "action", "instrument_id", "side", "qty", "price"]


# The reasons that halt a desk.
RATE, POSITION, LOSS, RATIO, GAP, MANUAL = "RateLimit", "PositionCap", "DailyLossFloor", "OrderToTradeRatio", "FeedGap", "Manual"


class TokenBucket:
    """``rate`` tokens at most, refilled at ``rate`` a second of event time."""

    def __init__(self, rate: int):
        self.rate, self.left, self.last = float(rate), float(rate), None

    def take(self, ts: int) -> bool:
        if self.last is not None:
            self.left = min(self.left + (ts - self.last) / 1e9 * self.rate, self.rate)
        self.last = ts
        enough = self.left >= 1
        self.left -= enough
        return enough


class RiskGate(Fold):
    """A latching pre-trade gate over intents, fills, gaps and controls, on event time.

    An intent goes through a list of checks; the first one that fails latches its reason, and
    all intents are blocked until a reset. A check whose limit is None is not in the list.
    """

    def __init__(self, limits: Limits | None = None):
        self.limits = limits = limits or Limits()
        self.bucket = None if limits.orders_per_sec is None else TokenBucket(limits.orders_per_sec)
        self.reason: str | None = None
        self.clear()

    def clear(self) -> None:
        self.orders = self.trades = self.cash = 0
        self.positions: dict[int, int] = {}
        self.gaps: deque = deque()

    def _passes(self, ts: int, instrument: int, signed: int) -> Iterable[tuple[str, bool]]:
        """Each check's reason and whether it lets the intent pass; later ones are not made if one does not."""
        limits = self.limits
        if self.bucket is not None:
            yield RATE, self.bucket.take(ts)
        if limits.position is not None:
            yield POSITION, abs(self.positions.get(instrument, 0) + signed) <= limits.position
        if limits.loss is not None:
            yield LOSS, self.cash >= -limits.loss
        if limits.order_to_trade is not None:
            early = self.orders < limits.order_to_trade_warmup
            yield RATIO, early or self.orders / max(self.trades, 1) <= limits.order_to_trade

    def step(self, event: tuple) -> Iterable[tuple]:
        seq, desk, ts, action, instrument, side, qty, price = event
        signed = -qty if side else qty
        allowed = None
        if action == "intent":
            if self.reason is None:
                self.reason = next((reason for reason, passed in self._passes(ts, instrument, signed) if not passed), None)
                self.orders += self.reason is None
            allowed = self.reason is None
        elif action == "fill":
            self.trades += 1
            self.cash -= signed * price
            self.positions[instrument] = self.positions.get(instrument, 0) + signed
        elif action == "gap" and self.limits.gaps is not None:
            self.gaps.append(ts)
            while self.gaps[0] < ts - self.limits.gap_window_ns:
                self.gaps.popleft()
            if len(self.gaps) >= self.limits.gaps:
                self.reason = self.reason or GAP
        elif action == "manual_halt":
            self.reason = self.reason or MANUAL
        elif action == "reset":
            self.reason = None
        elif action == "start_of_day":
            self.reason = None
            self.clear()
        return ((desk, seq, action, allowed, self.reason, self.orders, self.trades, self.cash, sum(map(abs, self.positions.values()))),)


def risk_decisions(actions: DataFrame, limits: Limits | None = None) -> DataFrame:
    """A row for each action of each desk: allowed (intents only), the latched reason, and the counters."""
    return run(actions, lambda: RiskGate(limits), DECISION, key="desk", columns=RISK_COLUMNS)


# ---- Gap tracker ------------------------------------------------------------------------------


class GapTracker(Fold):
    """In-order delivery of numbered messages with a bounded buffer.

    Input: (arrival, channel, sequence). Rows: (channel, sequence, arrival at which it is
    delivered). ``stats`` counts; a gap counts as closed only while others stay open.
    """

    def __init__(self, expected: int = 1, capacity: int = 16_384):
        self.expected, self.capacity = expected, capacity
        self.pending: set[int] = set()
        self.stats = {"duplicates": 0, "buffered": 0, "overflow": 0, "gaps_opened": 0, "gaps_closed": 0, "delivered": 0}

    def step(self, event: tuple) -> Iterable[tuple]:
        arrival, channel, seq = event
        if seq < self.expected:
            self.stats["duplicates"] += 1
            return ()
        if seq > self.expected:
            self.stats["gaps_opened"] += not self.pending
            if len(self.pending) >= self.capacity:
                self.stats["overflow"] += 1
            elif seq in self.pending:
                self.stats["duplicates"] += 1
            else:
                self.stats["buffered"] += 1
                self.pending.add(seq)
            return ()
        out, had = [], bool(self.pending)
        while True:
            out.append((channel, self.expected, arrival))
            self.expected += 1
            if self.expected not in self.pending:
                break
            self.pending.remove(self.expected)
        self.stats["gaps_closed"] += had and bool(self.pending) and len(out) > 1
        self.stats["delivered"] += len(out)
        return out

    def open_gap(self) -> tuple[int, int] | None:
        return (self.expected, min(self.pending) - 1) if self.pending else None


GAP_STATS = T.StructType().add("channel", T.IntegerType())
for _name in ("delivered", "duplicates", "buffered", "overflow", "gaps_opened", "gaps_closed", "open_from", "open_to"):
    GAP_STATS = GAP_STATS.add(_name, T.LongType())


class GapCounter(Fold):
    """The tracker's counts and open gap after a channel's last message; input: arrival, channel, sequence."""

    def __init__(self, expected: int, capacity: int):
        self.tracker, self.channel = GapTracker(expected, capacity), None

    def step(self, event: tuple) -> Iterable[tuple]:
        self.channel = event[1]
        self.tracker.step(event)
        return ()

    def finish(self) -> Iterable[tuple]:
        counts = self.tracker.stats
        return ((self.channel, *(counts[f.name] for f in GAP_STATS[1:7]), *(self.tracker.open_gap() or (None, None))),)


def gap_stats(messages: DataFrame, expected: int = 1, capacity: int = 16_384) -> DataFrame:
    """One row for each channel; ``messages``: channel, seq (the message's number), arrival (unique in the channel)."""
    rows = messages.select(F.col("arrival").alias("seq"), F.col("channel").cast("int").alias("channel"), F.col("seq").alias("number"))
    return run(rows, lambda: GapCounter(expected, capacity), GAP_STATS, key="channel", columns=["seq", "channel", "number"])
