"""Detectors and statistics that are plain windows: no Python in the plan, but for locks that arm anew."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bookloom.functions import scalars
from bookloom.operators.fold import Fold, run

_KEY = "instrument_id"


def with_iseq(events: DataFrame, segment: int | None = None) -> DataFrame:
    """``iseq``: the event's place among its instrument's events.

    A task holds an instrument; with ``segment``, only that many sequence numbers of it.
    """
    return _placed(events, "seq", "iseq", segment)


def _placed(rows: DataFrame, order: str, name: str, segment: int | None) -> DataFrame:
    if segment is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(_KEY).orderBy(order)).cast("long"))
    part = F.floor(F.col(order) / segment).cast("long")
    # One row for each instrument and segment; places go on from the segments before.
    before = Window.partitionBy(_KEY).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(_KEY, part.alias("_segment")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(_KEY, "_segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    there = F.row_number().over(Window.partitionBy(_KEY, "_segment").orderBy(order))
    out = rows.withColumn("_segment", part).withColumn("_there", there).join(counts, [_KEY, "_segment"])
    return out.select(*rows.columns, (F.col("_before") + F.col("_there")).cast("long").alias(name))


def trailing(rows: DataFrame, sums: dict[str, Column], width: int, order: str = "seq", segment: int | None = None) -> DataFrame:
    """``rows`` with sums over the last ``width`` rows of the instrument, their number ``n_rows`` and the first one's ``start``.

    Each is a running sum less the one ``width`` rows back, so a row costs the same for any
    width; a sliding frame would add up its rows anew for each of them. The values must be
    whole numbers. With ``segment``, an instrument is cut into runs of that many rows (``width``
    at least), each of which also sees the last rows of the run before it.
    """
    names, keys = rows.columns, [_KEY]
    rows = rows.withColumns({f"_{name}": value for name, value in sums.items()})
    if segment is None:
        rows = rows.withColumn("_own", F.lit(True))
    else:
        size = max(segment, width)
        rows = _placed(rows, order, "_place", segment)
        run, tail = F.floor((F.col("_place") - 1) / size), F.pmod(F.col("_place") - 1, F.lit(size)) > size - width
        rows = rows.withColumn("_runs", F.when(tail, F.array(run, run + 1)).otherwise(F.array(run))).withColumn("_first", run)
        rows = rows.withColumn("_run", F.explode("_runs")).withColumn("_own", F.col("_run") == F.col("_first"))
        keys = [_KEY, "_run"]
    w = Window.partitionBy(*keys).orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    less = lambda c: F.col(c) - F.coalesce(F.lag(c, width).over(w), F.lit(0))
    rows = rows.withColumn("n_rows", F.least(F.row_number().over(w), F.lit(width)).cast("long"))
    rows = rows.withColumn("start", F.coalesce(F.lag(order, width - 1).over(w), F.first(order).over(w)))
    rows = rows.withColumns({f"_{name}": F.sum(f"_{name}").over(running) for name in sums})
    rows = rows.withColumns({name: less(f"_{name}") for name in sums})
    return rows.filter("_own").select(*names, "n_rows", "start", *sums)


def quote_stuff(events: DataFrame, size: int = 48, ratio: float = 8.0, segment: int | None = None) -> DataFrame:
    """instrument_id, seq, start_seq, n_events, cancels, trades, severity of each flagged event."""
    rows = events.filter("et in (1, 2, 4)").select(_KEY, "seq", "et")
    of = lambda et: (F.col("et") == et).cast("long")
    rows = trailing(rows, {"cancels": of(2), "trades": of(4)}, size, segment=segment)
    rows = rows.select(_KEY, "seq", F.col("start").alias("start_seq"), F.col("n_rows").alias("n_events"), "cancels", "trades")
    r = F.col("cancels") / F.greatest("trades", F.lit(1))
    rows = rows.withColumn("r", r).filter((F.col("r") >= ratio) & (F.col("n_events") >= size // 2))
    return rows.withColumn("severity", F.least(F.col("r") / ratio / 2.0, F.lit(1.0))).drop("r")


def spoof(events: DataFrame, large: int = 1000, within: int = 64, segment: int | None = None) -> DataFrame:
    """instrument_id, order_id, start_seq, end_seq, qty, severity: large adds first cancelled within a span.

    Spans are in per-instrument sequence. One aggregation by order replaces a join of adds
    and cancels; order ids are not re-used.
    """
    own = with_iseq(events, segment).filter("et in (1, 2) and order_id <> 0")
    of = lambda et: F.min(F.when(F.col("et") == et, F.struct("iseq", "seq", "qty")))
    pairs = own.groupBy(_KEY, "order_id").agg(of(1).alias("a"), of(2).alias("c"))
    pairs = pairs.filter((F.col("a.qty") >= large) & (F.col("c.iseq") > F.col("a.iseq")) & (F.col("c.iseq") - F.col("a.iseq") <= within))
    return pairs.select(
        _KEY, "order_id", F.col("a.iseq").alias("start_seq"), F.col("c.iseq").alias("end_seq"), F.col("a.qty").alias("qty"),
        F.least(F.col("a.qty") / large / 5.0, F.lit(1.0)).alias("severity"),
    )


def cancel_rate(events: DataFrame, span: int = 2048, least: int = 128, segment: int | None = None) -> DataFrame:
    """instrument_id, iseq, n_events, cancels: the window a storm detector looks at, where it is full enough."""
    counted = F.col("et").isin(1, 2, 4)
    own = with_iseq(events, segment).select(_KEY, "iseq", "et")
    # Places are gapless, so a span of places is a number of rows.
    sums = {"n_events": counted.cast("long"), "cancels": (F.col("et") == 2).cast("long")}
    out = trailing(own, sums, span + 1, "iseq", segment).filter(counted & (F.col("n_events") >= least))
    return out.select(_KEY, "iseq", "n_events", "cancels")


def rolling_spread(tops: DataFrame, width: int = 256, segment: int | None = None) -> DataFrame:
    """instrument_id, seq, spread, mean_spread, blowout over two-sided samples; ``tops`` has seq, bid, ask."""
    rows = tops.withColumn("spread", scalars.spread(F.col("bid"), F.col("ask"))).filter("spread is not null")
    rows = trailing(rows.select(_KEY, "seq", "spread"), {"s": F.col("spread")}, width, segment=segment).withColumnRenamed("n_rows", "n")
    mean = F.col("s") / F.col("n")
    blowout = F.when(F.col("s") == 0, 1.0).otherwise(F.col("spread") * F.col("n") / F.col("s"))
    return rows.select(_KEY, "seq", "spread", mean.alias("mean_spread"), blowout.alias("blowout"))


def carried(rows: DataFrame, value: str, order: str = "seq") -> Column:
    """The last known ``value`` up to each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(_KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def tracked(events: DataFrame, instrument: int) -> DataFrame:
    """One instrument's events, numbered from 1 as ``eseq``."""
    own = Window.partitionBy(_KEY).orderBy("seq")
    return events.filter(F.col(_KEY) == instrument).withColumn("eseq", F.row_number().over(own).cast("long"))


def auto_lock(events: DataFrame, trades: int = 5) -> DataFrame:
    """Events of the first instrument to reach ``trades`` trades, from that trade on, with ``eseq`` from 1."""
    nth = F.row_number().over(Window.partitionBy(_KEY).orderBy("seq"))
    lock = events.filter("et = 4").select(_KEY, "seq", nth.alias("nth")).filter(F.col("nth") == trades)
    lock = lock.agg(F.min(F.struct(F.col("seq"), F.col(_KEY))).alias("lock"))  # one row
    chosen = events.join(F.broadcast(lock), (F.col(_KEY) == F.col("lock.instrument_id")) & (F.col("seq") >= F.col("lock.seq"))).drop("lock")
    return chosen.withColumn("eseq", F.row_number().over(Window.partitionBy(_KEY).orderBy("seq")).cast("long"))


class _Locks(Fold):
    """Input, trades in order: seq, channel, instrument, time. Rows: from which sequence on which instrument is tracked."""

    def __init__(self, trades: int, stale_ns: int):
        self.trades, self.stale_ns = trades, stale_ns
        self.locked, self.last, self.counts = None, 0, Counter()

    def step(self, event: tuple) -> Iterable[tuple]:
        seq, channel, instrument, ts = event
        if self.locked is not None:
            if ts - self.last <= self.stale_ns:
                self.last = ts if instrument == self.locked else self.last
                return ()
            self.locked, self.counts = None, Counter()
        self.counts[instrument] += 1
        if self.counts[instrument] < self.trades:
            return ()
        self.locked, self.last = instrument, ts
        return ((channel, instrument, seq),)


def rearming_locks(events: DataFrame, trades: int = 5, stale_ns: int = 5_000_000_000) -> DataFrame:
    """instrument_id, from_seq, to_seq: ``auto_lock`` that looks for an instrument anew.

    A lock ends at the first trade of any instrument that comes more than ``stale_ns`` of event
    time after the locked one's last. Only trades are looked at, in one task, as each lock
    depends on those before it.
    """
    schema = T.StructType().add("channel", T.IntegerType()).add(_KEY, T.IntegerType()).add("from_seq", T.LongType())
    rows = events.filter("et = 4").select("seq", F.lit(0).cast("int").alias("channel"), _KEY, "ts_ns")
    locks = run(rows, lambda: _Locks(trades, stale_ns), schema, key="channel", columns=["seq", "channel", _KEY, "ts_ns"])
    following = F.lead("from_seq").over(Window.partitionBy("channel").orderBy("from_seq"))
    return locks.select(_KEY, "from_seq", (following - 1).alias("to_seq"))


def tick_samples(events: DataFrame, period_ns: int) -> DataFrame:
    """The last event of each instrument in each period of event time, without a sort."""
    rows = events.withColumn("bucket", F.floor(F.col("ts_ns") / period_ns).cast("long"))
    last = rows.groupBy(_KEY, "bucket").agg(F.max_by(F.struct("et", "side", "price", "qty"), "seq").alias("e"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_events"))
    return last.select(_KEY, "bucket", "seq", "e.*", "n_events")


def rolling_quantiles(rows: DataFrame, value: str, width: int = 256) -> DataFrame:
    """p50, p99, p999 and max of the last ``width`` values, at index round((n - 1) q) of the sorted ones."""
    frame = Window.partitionBy(_KEY).orderBy("seq").rowsBetween(1 - width, 0)
    rows = rows.select(_KEY, "seq", F.sort_array(F.collect_list(value).over(frame)).alias("v"))
    at = lambda q: F.element_at("v", (F.floor((F.size("v") - 1) * q + 0.5) + 1).cast("int")).cast("long")
    return rows.select(_KEY, "seq", at(0.5).alias("p50"), at(0.99).alias("p99"), at(0.999).alias("p999"), F.element_at("v", -1).cast("long").alias("most"))


def gap_report(events: DataFrame, key: str = _KEY) -> DataFrame:
    """Missing sequence ranges of each key: gap_start, gap_end, missing."""
    before = F.lag("seq").over(Window.partitionBy(key).orderBy("seq"))
    rows = events.select(key, "seq", before.alias("before")).filter("seq > before + 1")
    return rows.select(
        key, (F.col("before") + 1).alias("gap_start"), (F.col("seq") - 1).alias("gap_end"), (F.col("seq") - F.col("before") - 1).alias("missing")
    )


def before_first_gap(events: DataFrame, key: str = _KEY) -> DataFrame:
    """Strict replay: each key's events before its first gap."""
    w = Window.partitionBy(key).orderBy("seq")
    rows = events.withColumn("_gap", (F.col("seq") - F.coalesce(F.lag("seq").over(w), F.col("seq") - 1) != 1).cast("int"))
    return rows.withColumn("_gaps", F.sum("_gap").over(w)).filter("_gaps = 0").drop("_gap", "_gaps")


def delivery(packets: DataFrame, key: str = _KEY) -> DataFrame:
    """How a sequencer delivers first arrivals: in_order if every smaller sequence came before; delivered_at, its arrival.

    ``packets`` has ``key``, seq and arrival; later arrivals of a sequence are duplicates.
    """
    first = packets.groupBy(key, "seq").agg(F.min("arrival").alias("arrival"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    w = Window.partitionBy(key).orderBy("seq")
    so_far = F.max("arrival").over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(w)
    start = F.min("seq").over(Window.partitionBy(key))
    rows = first.select(key, "seq", "arrival", "duplicates", so_far.alias("delivered_at"), (F.col("seq") - start + 1 == place).alias("contiguous"))
    return rows.select(key, "seq", "arrival", F.col("duplicates").cast("long"), "delivered_at", (F.col("delivered_at") == F.col("arrival")).alias("in_order"), "contiguous")


def stress_windows(tagged: DataFrame, least: int = 1, merge_gap: int = 64) -> DataFrame:
    """Islands of rows at or above a regime: start_seq, end_seq, regime, severity, n_flags.

    ``tagged``: instrument_id, seq, regime, n_flags, severity_sum. An island ends at a row
    below the regime or where sequences are more than ``merge_gap`` apart.
    """
    w = Window.partitionBy(_KEY).orderBy("seq")
    rows = tagged.withColumn("_high", F.col("regime") >= least)
    fresh = ~F.coalesce(F.lag("_high").over(w), F.lit(False)) | (F.col("seq") - F.lag("seq").over(w) > merge_gap)
    rows = rows.withColumn("_new", (F.col("_high") & fresh).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w)).filter("_high")
    out = rows.groupBy(_KEY, "_island").agg(
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.max("regime").alias("regime"),
        F.sum("severity_sum").alias("s"), F.sum("n_flags").cast("long").alias("n_flags"),
    )
    severity = F.when(F.col("n_flags") > 0, F.col("s") / F.col("n_flags")).otherwise(0.0)
    return out.select(_KEY, "start_seq", "end_seq", "regime", severity.alias("severity"), "n_flags")


def event_rates(events: DataFrame) -> DataFrame:
    """Events, trades and order-to-trade ratio of each instrument in each second of event time."""
    rows = events.withColumn("second", F.floor(F.col("ts_ns") / 1_000_000_000).cast("long"))
    orders = F.sum((F.col("et") == 1).cast("long"))
    trades = F.sum((F.col("et") == 4).cast("long"))
    out = rows.groupBy(_KEY, "second").agg(F.count(F.lit(1)).alias("events"), trades.alias("trades"), orders.alias("orders"))
    return out.withColumn("otr", F.col("orders") / F.greatest("trades", F.lit(1)))


def positions_cash(fills: DataFrame) -> DataFrame:
    """Running position and cash after each fill: instrument_id, seq, position, cash."""
    signed = F.when(F.col("side") == 0, F.col("qty")).otherwise(-F.col("qty"))
    w = Window.partitionBy(_KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = fills.withColumn("_signed", signed)
    return rows.select(
        _KEY, "seq", F.sum("_signed").over(w).cast("long").alias("position"), F.sum(-F.col("_signed") * F.col("price")).over(w).cast("long").alias("cash")
    )
