"""Order-book state machines: the level-capped book, its hash, and order resolution for detectors."""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bookloom.operators.fold import Fold, run
from bookloom.schema import ADD, CANCEL, MODIFY, TRADE

MAX_LEVELS = 256


class Book:
    """Levels by price and orders by id of one instrument.

    ``modify="additive"`` cancels and re-adds with the same event, so a smaller quantity
    leaves the difference at the old level; ``"clean"`` removes the whole order first.
    ``cap=None`` never drops a level.
    """

    __slots__ = ("cap", "modify", "orders", "prices", "sides")

    def __init__(self, cap: int | None = MAX_LEVELS, modify: str = "additive"):
        self.cap, self.modify = cap, modify
        self.sides: tuple[dict, dict] = ({}, {})  # price -> [quantity, orders]
        self.orders: dict[int, list] = {}  # id -> [side, price, quantity]
        self.prices: tuple[list, list] = ([], [])  # in ascending order

    def apply(self, et: int, side: int, price: int, qty: int, order_id: int) -> bool:
        if et == ADD:
            return self._add(side, price, qty, order_id)
        if et == CANCEL:
            return self._cancel(side, price, qty, order_id)
        if et == TRADE:
            return self._trade(side, price, qty, order_id)
        if et == MODIFY:
            cut = 0 if self.modify == "clean" and order_id else qty
            self._cancel(side, price, cut, order_id)
            return self._add(side, price, qty, order_id)
        return False

    def apply_lanes(self, events: Iterable[tuple]) -> None:
        """All adds, then all trades, then all cancels of (type, side, price, quantity, order id).

        The end is that of the events in order where ids are unique, no order is cut before its
        add and none is modified (see ``ladder.lane_licence``).
        """
        events = list(events)
        for lane in (ADD, TRADE, CANCEL):
            for event in events:
                if event[0] == lane:
                    self.apply(*event)

    def _add(self, side: int, price: int, qty: int, order_id: int) -> bool:
        own = int(side != 0)
        levels = self.sides[own]
        level = levels.get(price)
        if level is not None:
            level[0] += qty
            level[1] += 1
        elif self.cap is not None and len(levels) >= self.cap:
            return False
        else:
            levels[price] = [qty, 1]
            insort(self.prices[own], price)
        if order_id:
            self.orders[order_id] = [own, price, qty]
        return True

    def _reduce(self, own: int, price: int, qty: int, leaves: bool) -> bool:
        levels = self.sides[own]
        level = levels.get(price)
        if level is None:
            return False
        level[0] = max(level[0] - qty, 0)
        if leaves:
            level[1] = max(level[1] - 1, 0)
            if not level[1]:
                del levels[price]
                prices = self.prices[own]
                del prices[bisect_left(prices, price)]
        return True

    def _cancel(self, side: int, price: int, qty: int, order_id: int) -> bool:
        if not order_id:
            return self._reduce(int(side != 0), price, qty, True)
        order = self.orders.get(order_id)
        if order is None:
            return False
        if qty == 0 or qty >= order[2]:
            del self.orders[order_id]
            return self._reduce(order[0], order[1], order[2], True)
        order[2] -= qty
        return self._reduce(order[0], order[1], qty, False)

    def _trade(self, side: int, price: int, qty: int, order_id: int) -> bool:
        if not order_id:
            own = int(side != 0)
            level = self.sides[own].get(price)
            return level is not None and self._reduce(own, price, qty, level[0] <= qty)
        order = self.orders.get(order_id)
        if order is None:
            return False
        fill = min(qty, order[2])
        order[2] -= fill
        if not order[2]:
            del self.orders[order_id]
        return self._reduce(order[0], order[1], fill, not order[2])

    @property
    def best_bid(self) -> int | None:
        return self.prices[0][-1] if self.prices[0] else None

    @property
    def best_ask(self) -> int | None:
        return self.prices[1][0] if self.prices[1] else None

    def size_at(self, side: int, price: int | None) -> int:
        return self.sides[side][price][0] if price is not None else 0

    def best_prices(self, side: int, n: int | None = None) -> list[int]:
        """The ``n`` best prices of a side (all by default), best first."""
        prices = self.prices[side]
        if side:
            return prices[:n]
        return prices[::-1] if n is None else prices[: -n - 1 : -1]

    def levels(self, side: int, n: int | None = None) -> list[tuple[int, int, int]]:
        """(price, quantity, orders), best first."""
        levels = self.sides[side]
        return [(p, *levels[p]) for p in self.best_prices(side, n)]

    def depth(self, side: int, n: int) -> int:
        levels = self.sides[side]
        return sum([levels[p][0] for p in self.best_prices(side, n)])

    def l2_hash(self, tag: bytes = b"L2-v1") -> int:
        """A 64-bit XXH3 of the levels from best to worst, bids then asks; ``tag`` is its name space."""
        import xxhash

        h = xxhash.xxh3_64_intdigest(tag)
        for side in (0, 1):
            if side:
                h = xxhash.xxh3_64_intdigest(b"|", h)
            for price, qty, _ in self.levels(side):
                h ^= xxhash.xxh3_64_intdigest(struct.pack("<QQ", price, qty), h)
        return h

    def state(self) -> tuple:
        """Comparable state; equal books give equal states."""
        return self.levels(0), self.levels(1), sorted((i, *o) for i, o in self.orders.items())

    def to_bytes(self) -> bytes:
        """The whole state; equal books give equal bytes whatever their history."""
        bids, asks, orders = self.state()
        head = struct.pack("<qBIIQ", -1 if self.cap is None else self.cap, self.modify == "clean", len(bids), len(asks), len(orders))
        levels = b"".join(struct.pack("<QQQ", *x) for x in (*bids, *asks))
        return head + levels + b"".join(struct.pack("<qBQQ", *x) for x in orders)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Book:
        head, level, order = (struct.Struct(f) for f in ("<qBIIQ", "<QQQ", "<qBQQ"))
        cap, clean, n_bids, n_asks, n_orders = head.unpack_from(raw)
        at = head.size
        if len(raw) != at + level.size * (n_bids + n_asks) + order.size * n_orders or (cap >= 0 and max(n_bids, n_asks) > cap):
            raise ValueError("these bytes are no book")
        book = cls(None if cap < 0 else cap, "clean" if clean else "additive")
        for k in range(n_bids + n_asks):
            price, qty, n = level.unpack_from(raw, at + k * level.size)
            book.sides[int(k >= n_bids)][price] = [qty, n]
        at += level.size * (n_bids + n_asks)
        for k in range(n_orders):
            order_id, side, price, qty = order.unpack_from(raw, at + k * order.size)
            book.orders[order_id] = [side, price, qty]
        book.prices = tuple(sorted(levels) for levels in book.sides)
        return book

    def __getstate__(self):
        return self.cap, self.modify, self.sides, self.orders, self.prices

    def __setstate__(self, state):
        self.cap, self.modify, self.sides, self.orders, self.prices = state


TOP = (
    T.StructType()
    .add("instrument_id", T.IntegerType()).add("seq", T.LongType()).add("iseq", T.LongType()).add("et", T.IntegerType())
    .add("side", T.IntegerType()).add("price", T.LongType()).add("qty", T.LongType()).add("ts_ns", T.LongType())
    .add("pre_bid", T.LongType()).add("pre_ask", T.LongType()).add("bid", T.LongType()).add("ask", T.LongType())
    .add("bid_size", T.LongType()).add("ask_size", T.LongType()).add("bid_depth", T.LongType()).add("ask_depth", T.LongType())
)


class TopOfBook(Fold):
    """A row for every ``every``-th event of the instrument: quotes before and after it, sizes, depth."""

    def __init__(self, every: int = 1, depth: int = 10, trades_only: bool = False, **book):
        self.book, self.every, self.depth, self.trades_only, self.iseq = Book(**book), every, depth, trades_only, 0

    def step(self, event: tuple) -> Iterable[tuple]:
        seq, instrument, et, side, price, qty, order_id, ts = event
        book = self.book
        before = book.best_bid, book.best_ask
        book.apply(et, side, price, qty, order_id)
        self.iseq += 1
        if self.iseq % self.every or (self.trades_only and et != TRADE):
            return ()
        bid, ask = book.best_bid, book.best_ask
        depths = (book.depth(0, self.depth), book.depth(1, self.depth)) if self.depth else (None, None)
        return ((instrument, seq, self.iseq, et, side, price, qty, ts, *before, bid, ask, book.size_at(0, bid), book.size_at(1, ask), *depths),)


def top_of_book(events: DataFrame, every: int = 1, depth: int = 10, trades_only: bool = False, **book) -> DataFrame:
    return run(events, lambda: TopOfBook(every, depth, trades_only, **book), TOP)


LEVELS = (
    T.StructType()
    .add("instrument_id", T.IntegerType()).add("side", T.IntegerType()).add("price", T.LongType())
    .add("total_qty", T.LongType()).add("order_count", T.LongType()).add("l2_hash", T.StringType())
)


class FinalBook(Fold):
    """The levels and the hash after the last event."""

    def __init__(self, **book):
        self.book, self.instrument = Book(**book), None

    def step(self, event: tuple) -> Iterable[tuple]:
        _, self.instrument, et, side, price, qty, order_id, _ = event
        self.book.apply(et, side, price, qty, order_id)
        return ()

    def finish(self) -> Iterable[tuple]:
        text = f"{self.book.l2_hash():016x}"
        return [(self.instrument, s, p, q, n, text) for s in (0, 1) for p, q, n in self.book.levels(s)]


def final_books(events: DataFrame, **book) -> DataFrame:
    """Levels after the last event of each instrument, for any input (modifies, anonymous and re-used ids)."""
    return run(events, lambda: FinalBook(**book), LEVELS)


class OrderTracker:
    """What an event means to a detector: (side, price, quantity) from the known order, else from the event."""

    __slots__ = ("orders",)

    def __init__(self):
        self.orders: dict[int, list] = {}

    def __getstate__(self):
        return self.orders

    def __setstate__(self, orders):
        self.orders = orders

    def add(self, side: int, price: int, qty: int, order_id: int) -> tuple | None:
        if side not in (0, 1):
            return None
        if order_id:
            self.orders[order_id] = [side, price, qty]
        return side, price, qty

    def _take(self, order_id: int, qty: int) -> tuple | None:
        order = self.orders.get(order_id)
        if order is None:
            return None
        side, price, held = order
        taken = held if qty == 0 or qty >= held else qty
        if taken >= held:
            del self.orders[order_id]
        else:
            order[2] = held - taken
        return side, price, taken

    def cancel(self, side: int, price: int, qty: int, order_id: int) -> tuple | None:
        if order_id:
            found = self._take(order_id, qty)
            if found or not price:
                return found
        return (side, price, qty) if side in (0, 1) else None

    def trade(self, side: int, price: int, qty: int, order_id: int) -> tuple | None:
        """(resting side, price, quantity); the aggressor is on the other side."""
        if order_id:
            found = self._take(order_id, qty)
            if found:
                return found[0], price or found[1], found[2]
            if not price:
                return None
        return (side, price, qty) if side in (0, 1) else None


class MiniBook:
    """Quantities by price on both sides, at most ``cap`` levels each: the one farthest from the best goes."""

    __slots__ = ("ask", "bid", "cap", "sides")

    def __init__(self, cap: int):
        self.cap = cap
        self.sides: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.bid: int | None = None
        self.ask: int | None = None

    def __getstate__(self):
        return self.cap, self.sides, self.bid, self.ask

    def __setstate__(self, state):
        self.cap, self.sides, self.bid, self.ask = state

    def add(self, side: int, price: int, qty: int) -> None:
        levels = self.sides[side]
        held = levels.get(price)
        if held is not None:
            levels[price] = held + qty
            return
        levels[price] = qty
        if side == 0:
            if self.bid is None or price > self.bid:
                self.bid = price
        elif self.ask is None or price < self.ask:
            self.ask = price
        if len(levels) > self.cap:
            self._drop(side, (min if side == 0 else max)(levels))

    def sub(self, side: int, price: int, qty: int) -> None:
        levels = self.sides[side]
        held = levels.get(price)
        if held is None:
            return
        if qty and qty < held:
            levels[price] = held - qty
        else:
            self._drop(side, price)

    def _drop(self, side: int, price: int) -> None:
        levels = self.sides[side]
        del levels[price]
        if side == 0:
            if price == self.bid:
                self.bid = max(levels, default=None)
        elif price == self.ask:
            self.ask = min(levels, default=None)

    def mid(self) -> int | None:
        """Crossed books have none; locked ones do."""
        if self.bid is None or self.ask is None or self.ask < self.bid:
            return None
        return (self.bid + self.ask) // 2

    def band(self, bid: int, ask: int, ticks: int) -> int:
        bids, asks = self.sides
        if ticks < len(bids) and ticks < len(asks):
            return sum(bids.get(p, 0) for p in range(max(bid - ticks, 0), bid + 1)) + sum(asks.get(p, 0) for p in range(ask, ask + ticks + 1))
        low, high = max(bid - ticks, 0), ask + ticks
        return sum(q for p, q in bids.items() if low <= p <= bid) + sum(q for p, q in asks.items() if ask <= p <= high)
