"""Running statistics, state hashes and the sampled frames of a live view."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bookloom.functions import scalars
from bookloom.functions.scalars import trade_sign
from bookloom.operators.book import Book
from bookloom.operators.fold import Fold, run
from bookloom.operators.sequential import VpinBuckets
from bookloom.schema import TRADE

_KEY = "instrument_id"
_NS = 1_000_000_000


def running_stats(rows: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample variance (0 for one value), least and most of all values so far."""
    w = Window.partitionBy(_KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    return rows.select(
        _KEY, "seq", F.count(v).over(w).alias("n"), F.avg(v).over(w).alias("mean"),
        F.coalesce(F.var_samp(v).over(w), F.lit(0.0)).alias("variance"), F.min(v).over(w).alias("least"), F.max(v).over(w).alias("most"),
    )


STATE = T.StructType().add("instrument_id", T.IntegerType()).add("seq", T.LongType()).add("state_hash", T.StringType()).add("gap", T.BooleanType())


class StateHash(Fold):
    """A hash chained over sequence and record of every event; a gap in ``iseq`` order stops a strict chain."""

    def __init__(self, every: int = 1, strict: bool = False):
        self.every, self.strict = every, strict
        self.value, self.n, self.last, self.stopped = 0, 0, None, False

    def step(self, event: tuple) -> Iterable[tuple]:
        import xxhash

        from bookloom.sources.records import pack_event

        seq = event[0]
        gap = self.last is not None and seq != self.last + 1
        if self.stopped or (gap and self.strict):
            self.stopped = True
            return ()
        self.last, self.n = seq, self.n + 1
        data = self.value.to_bytes(8, "little") + seq.to_bytes(8, "little") + pack_event(event)
        self.value = xxhash.xxh3_64_intdigest(data)
        return ((event[1], seq, f"{self.value:016x}", gap),) if self.n % self.every == 0 else ()


def state_hashes(events: DataFrame, every: int = 1, strict: bool = False) -> DataFrame:
    return run(events, lambda: StateHash(every, strict), STATE)


def same_state(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two hash chains differ or one lacks a row; empty if they agree."""
    both = left.select(_KEY, "seq", F.col("state_hash").alias("a")).join(right.select(_KEY, "seq", F.col("state_hash").alias("b")), [_KEY, "seq"], "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))


def mid_drift(tops: DataFrame) -> DataFrame:
    """Each second's last mid (also of crossed books) against the one before it, in basis points."""
    rows = tops.filter("bid is not null and ask is not null").select(
        _KEY, F.floor(F.col("ts_ns") / _NS).cast("long").alias("second"), "seq", F.floor((F.col("bid") + F.col("ask")) / 2).cast("long").alias("mid")
    )
    last = rows.groupBy(_KEY, "second").agg(F.max_by("mid", "seq").alias("mid"))
    before = F.lag("mid").over(Window.partitionBy(_KEY).orderBy("second"))
    drift = F.when(before.isNull() | (F.col("mid") == 0), 0.0).otherwise(F.abs(F.col("mid") - before) / F.col("mid") * 1e4)
    return last.select(_KEY, "second", "mid", drift.alias("drift_bps"))


TICK = T.StructType()
for _name, _type in (
    ("instrument_id", T.IntegerType()), ("bucket", T.LongType()), ("seq", T.LongType()), ("ts_ns", T.LongType()),
    ("bid", T.LongType()), ("ask", T.LongType()), ("bid_size", T.LongType()), ("ask_size", T.LongType()),
    ("bid_depth", T.LongType()), ("ask_depth", T.LongType()), ("vpin", T.DoubleType()), ("blowout", T.DoubleType()),
):
    TICK = TICK.add(_name, _type)


class TickFrames(Fold):
    """The last two-sided quote of each period, and the toxicity and spread blow-out known by then."""

    def __init__(self, period_ns: int, vpin_size: int, vpin_buckets: int, spread_width: int, depth: int = 10):
        self.period_ns, self.depth, self.book = period_ns, depth, Book()
        self.volume, self.skews = VpinBuckets(vpin_size), deque(maxlen=vpin_buckets)
        self.spreads, self.total = deque(maxlen=spread_width), 0
        self.vpin, self.blowout = 0.0, 1.0
        self.bucket, self.frame = None, None

    def step(self, event: tuple) -> Iterable[tuple]:
        seq, instrument, et, side, price, qty, order_id, ts = event
        bucket, out = ts // self.period_ns, ()
        if bucket != self.bucket:
            out, self.bucket = self.finish(), bucket
        book = self.book
        if et == TRADE:
            self._traded(seq, instrument, qty, trade_sign(price, side, book.best_bid, book.best_ask))
        book.apply(et, side, price, qty, order_id)
        bid, ask = book.best_bid, book.best_ask
        if bid is not None and ask is not None and bid < ask:
            self._quoted(ask - bid)
            sizes = book.size_at(0, bid), book.size_at(1, ask), book.depth(0, self.depth), book.depth(1, self.depth)
            self.frame = (instrument, bucket, seq, ts, bid, ask, *sizes, self.vpin, self.blowout)
        return out

    def _traded(self, seq: int, instrument: int, qty: int, sign: int) -> None:
        for *_, buy, sell in self.volume.step((seq, instrument, qty, sign)):
            self.skews.append(abs(buy - sell))
            self.vpin = sum(self.skews) / (len(self.skews) * self.volume.size)

    def _quoted(self, spread: int) -> None:
        if len(self.spreads) == self.spreads.maxlen:
            self.total -= self.spreads[0]
        self.spreads.append(spread)
        self.total += spread
        self.blowout = spread * len(self.spreads) / self.total

    def finish(self) -> Iterable[tuple]:
        frame, self.frame = self.frame, None
        return () if frame is None else (frame,)


def ticks(events: DataFrame, period_ns: int = 20_000_000, vpin_size: int = 10_000, vpin_buckets: int = 50, spread_width: int = 256) -> DataFrame:
    """The view's frames: the last quote of each period with spread, microprice, imbalance, VPIN and blow-out so far.

    One fold feeds everything; periods without a two-sided quote have no frame.
    """
    rows = run(events, lambda: TickFrames(period_ns, vpin_size, vpin_buckets, spread_width), TICK)
    bid, ask = F.col("bid"), F.col("ask")
    return rows.select(
        _KEY, "bucket", "seq", "ts_ns", scalars.mid(bid, ask).alias("mid"), scalars.spread(bid, ask).alias("spread"),
        scalars.spread_bps(bid, ask).alias("spread_bps"), scalars.microprice(bid, F.col("bid_size"), ask, F.col("ask_size")).alias("microprice"),
        "bid_depth", "ask_depth", scalars.imbalance(F.col("bid_depth"), F.col("ask_depth")).alias("imbalance"), "vpin", "blowout",
    )


LADDERS = (
    T.StructType().add("instrument_id", T.IntegerType()).add("bucket", T.LongType()).add("seq", T.LongType())
    .add("bids", T.ArrayType(T.StructType().add("price", T.LongType()).add("qty", T.LongType()).add("orders", T.LongType())))
    .add("asks", T.ArrayType(T.StructType().add("price", T.LongType()).add("qty", T.LongType()).add("orders", T.LongType())))
)


class LadderFrames(Fold):
    """The best levels of both sides when a period of event time ends, at its last event."""

    def __init__(self, period_ns: int, depth: int):
        self.period_ns, self.depth, self.book = period_ns, depth, Book()
        self.instrument, self.bucket, self.seq = None, None, 0

    def step(self, event: tuple) -> Iterable[tuple]:
        seq, self.instrument, et, side, price, qty, order_id, ts = event
        bucket = ts // self.period_ns
        out = self.finish() if bucket != self.bucket else ()
        self.book.apply(et, side, price, qty, order_id)
        self.bucket, self.seq = bucket, seq
        return out

    def finish(self) -> Iterable[tuple]:
        if self.bucket is None:
            return ()
        sides = [[dict(zip(("price", "qty", "orders"), x)) for x in self.book.levels(s, self.depth)] for s in (0, 1)]
        return ((self.instrument, self.bucket, self.seq, *sides),)


def ladder_frames(events: DataFrame, period_ns: int = 100_000_000, depth: int = 10) -> DataFrame:
    """One row for each instrument and period with events: bids and asks as arrays, best first."""
    return run(events, lambda: LadderFrames(period_ns, depth), LADDERS)


def ladder_rows(frames: DataFrame) -> DataFrame:
    """Ladder frames as one row for each level: instrument_id, bucket, seq, side, lvl (from 1), price, qty, orders."""
    sides = [frames.select(_KEY, "bucket", "seq", F.lit(s).alias("side"), F.posexplode(c).alias("lvl", "x")) for s, c in enumerate(("bids", "asks"))]
    rows = sides[0].unionByName(sides[1])
    return rows.select(_KEY, "bucket", "seq", "side", (F.col("lvl") + 1).alias("lvl"), "x.price", "x.qty", "x.orders")


def risk_frames(decisions: DataFrame, times: DataFrame, period_ns: int = 100_000_000) -> DataFrame:
    """The gate's last state of each desk and period: latched reason, counters, exposure, orders to trades.

    ``times``: desk, seq, ts_ns of the actions that ``decisions`` decides.
    """
    rows = decisions.join(times.select("desk", "seq", "ts_ns"), ["desk", "seq"])
    state = F.struct("reason", "orders", "trades", "cash", "exposure")
    rows = rows.groupBy("desk", F.floor(F.col("ts_ns") / period_ns).cast("long").alias("bucket")).agg(
        F.max("seq").alias("seq"), F.max_by(state, "seq").alias("s"), F.count(F.when(~F.col("allowed"), 1)).alias("blocked")
    )
    ratio = F.col("s.orders") / F.greatest(F.col("s.trades"), F.lit(1))
    return rows.select("desk", "bucket", "seq", "s.*", ratio.alias("order_to_trade"), "blocked")


def valid_run_id(name: Column) -> Column:
    """Whether a run's name is a UTC time such as 2024-01-31T09-30-00Z."""
    return name.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z$")
