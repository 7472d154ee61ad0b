"""Row-wise market formulas as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid(bid: Column, ask: Column) -> Column:
    """Integer mid price, only where the ask is above the bid."""
    return F.when(ask > bid, F.floor((bid + ask) / 2)).cast("long")


def spread(bid: Column, ask: Column) -> Column:
    return F.when(ask > bid, ask - bid).cast("long")


def spread_bps(bid: Column, ask: Column) -> Column:
    m = mid(bid, ask)
    return F.when(m > 0, spread(bid, ask) / m * 1e4).otherwise(0.0)


def imbalance(bid_depth: Column, ask_depth: Column) -> Column:
    """(B - A) / (B + A), 0 when both are empty."""
    total = bid_depth + ask_depth
    return F.when(total == 0, 0.0).otherwise((bid_depth - ask_depth) / total)


def microprice(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    """Size-weighted price in whole ticks; the mid where no size stands."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = wide(bid) * wide(ask_size) + wide(ask) * wide(bid_size)
    total = bid_size + ask_size
    return F.when(ask <= bid, F.lit(None)).when(total > 0, F.floor(top / total)).otherwise(mid(bid, ask)).cast("long")


def bps_move(before: Column, after: Column) -> Column:
    moved = F.floor(F.abs(after - before).cast("decimal(19,0)") * 10_000 / F.when(before != 0, before))
    return F.coalesce(moved, F.lit(0)).cast("long")


def aggressor(price: Column, bid: Column, ask: Column) -> Column:
    """+1 at or above the ask, -1 at or below the bid, 0 inside and in crossed, locked or one-sided books."""
    return F.when(F.coalesce(ask <= bid, F.lit(True)), 0).when(price >= ask, 1).when(price <= bid, -1).otherwise(0).cast("int")


def aggressor_of(price: int, bid: int | None, ask: int | None) -> int:
    """``aggressor`` of plain values, for folds."""
    if bid is None or ask is None or ask <= bid:
        return 0
    return (price >= ask) - (price <= bid)


def trade_sign(price: int, side: int, bid: int | None, ask: int | None) -> int:
    """The sign of a trade's volume: of its price or its side's best one, else of its raw side (a bid buys)."""
    price = price or (ask if side == 1 else bid) or 0
    return aggressor_of(price, bid, ask) if price else 1 - 2 * (side != 0)


def repaired_price(price: Column, side: Column, bid: Column, ask: Column) -> Column:
    """A print's price: its own, else the best of its side before it; null if there is none."""
    best = F.when(side == 1, ask).otherwise(bid)
    return F.when(price > 0, price).otherwise(F.when(best > 0, best)).cast("long")


def regime_score(
    blowout: Column, imbalance: Column, vpin: Column, velocity: Column, depletion: Column, drift: Column,
    events_per_sec: Column, crossed: Column,
) -> Column:
    """The weighted stress score; thin seconds (under 30 events) count in proportion."""
    book = F.when(crossed, 0.0).otherwise(F.greatest(blowout - 1.0, F.lit(0.0)) + 3.0 * F.abs(imbalance))
    flow = 5.0 * vpin + 0.6 * F.abs(velocity - 1.0) + 0.3 * drift + 3.0 * depletion
    full = F.when(events_per_sec == 0, 1.0).otherwise(F.least(events_per_sec / 30.0, F.lit(1.0)))
    return (book + flow) * full


def regime_class(score: Column) -> Column:
    return F.when(score >= 3.0, 3).when(score >= 1.5, 2).when(score >= 0.6, 1).otherwise(0).cast("int")


def latency_bin(ns: Column) -> Column:
    """One of 192 log-linear bins: eight for each power of two, the last for all beyond."""
    power = F.when(ns > 0, F.least(F.length(F.bin(ns)) - 1, F.lit(23))).otherwise(0)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), power.cast("int"))
    fine = F.floor((ns - low) * 8 / low)
    return F.when(ns <= 0, 0).otherwise(F.least(power * 8 + fine, F.lit(191))).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def lerp(low: float, high: float, t: Column) -> Column:
    """From ``low`` to ``high`` as ``t`` goes from 0 to 1, and no farther."""
    return low + (high - low) * clamp(t, 0.0, 1.0)


def cycles(duration_ns: Column, cycle_ns: int) -> Column:
    """Whole cycles in a duration, one at least."""
    return F.greatest(F.floor(duration_ns / F.lit(max(cycle_ns, 1))), F.lit(1)).cast("long")


REGIME_SQL = """
create or replace temporary function regime_score(
    blowout double, imbalance double, vpin double, velocity double, depletion double, drift double,
    events_per_sec bigint, crossed boolean)
returns double return
    ((case when crossed then 0 else greatest(blowout - 1, 0) + 3 * abs(imbalance) end)
     + 5 * vpin + 0.6D * abs(velocity - 1) + 0.3D * drift + 3 * depletion)
    * case when events_per_sec = 0 then 1 else least(events_per_sec / 30D, 1D) end
"""


def register(spark) -> None:
    """Make the stress score callable from SQL text."""
    spark.sql(REGIME_SQL)
