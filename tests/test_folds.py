import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bookloom.operators.book import Book, TopOfBook, final_books
from bookloom.operators.detectors import Chain, PhantomLiquidity, chain
from bookloom.operators.fold import replay
from bookloom.operators.ladder import final_ladder
from bookloom.operators.sequential import Clusterer, GapTracker, Limits, RiskGate, VpinBuckets, episodes, risk_decisions
from bookloom.schema import ADD, CANCEL, KINDS, MODIFY, TRADE
from bookloom.sources import scenarios


def feed(book, *events):
    for e in events:
        book.apply(*e)
    return book


def test_partial_and_full_cancels():
    b = feed(Book(), (ADD, 0, 100, 10, 1), (ADD, 0, 100, 5, 2))
    assert b.levels(0) == [(100, 15, 2)]
    assert feed(b, (CANCEL, 0, 0, 3, 1)).levels(0) == [(100, 12, 2)]
    assert feed(b, (CANCEL, 0, 0, 7, 1)).levels(0) == [(100, 5, 1)]
    assert feed(b, (CANCEL, 0, 0, 0, 2)).levels(0) == [] and b.best_bid is None
    assert not b.apply(CANCEL, 0, 0, 0, 999)


def test_modify_keeps_the_difference_or_not():
    events = (ADD, 0, 100, 10, 1), (MODIFY, 0, 101, 4, 1)
    assert feed(Book(), *events).levels(0) == [(101, 4, 1), (100, 6, 1)]
    assert feed(Book(modify="clean"), *events).levels(0) == [(101, 4, 1)]


def test_anonymous_reused_and_capped_orders():
    b = feed(Book(), (ADD, 1, 50, 10, 0), (TRADE, 1, 50, 4, 0))
    assert b.levels(1) == [(50, 6, 1)]
    assert feed(b, (TRADE, 1, 50, 9, 0)).levels(1) == []
    b = feed(Book(), (ADD, 0, 10, 5, 7), (ADD, 0, 11, 3, 7), (CANCEL, 0, 0, 0, 7))
    assert b.levels(0) == [(10, 5, 1)]  # the first add's quantity stays behind
    b = Book(cap=2)
    assert [b.apply(ADD, 0, p, 1, p) for p in (1, 2, 3, 2)] == [True, True, False, True]
    assert not b.apply(CANCEL, 0, 0, 0, 3)


def test_resume_equals_one_run():
    events = scenarios.fuzz(3000, 5)
    whole, half = TopOfBook(), TopOfBook()
    want = replay(events, whole)
    got = replay(events[:1500], half)
    got += replay(events[1500:], TopOfBook().load(half.dump()))
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_best_prices_are_kept(seed):
    b = Book()
    for e in scenarios.fuzz(2000, seed):
        b.apply(*e[2:7])
        assert b.best_bid == max(b.sides[0], default=None) and b.best_ask == min(b.sides[1], default=None)


def test_lanes_end_where_the_order_does():
    events = [e[2:7] for e in scenarios.market(1500, 8)]
    serial, lanes = feed(Book(), *events), Book()
    lanes.apply_lanes(events)
    assert lanes.state() == serial.state() and len(serial.orders) > 50


class PlainBook:
    """Levels recomputed from all orders alive; for streams with unique ids and no modifies."""

    def __init__(self):
        self.orders = {}

    def apply(self, et, side, price, qty, order_id):
        if et == ADD:
            self.orders[order_id] = [side, price, qty]
        elif order_id in self.orders:
            order = self.orders[order_id]
            order[2] -= order[2] if et == CANCEL and qty == 0 else min(qty, order[2])
            if not order[2]:
                del self.orders[order_id]

    def levels(self, side):
        out = {}
        for s, p, q in self.orders.values():
            if s == side:
                total, n = out.get(p, (0, 0))
                out[p] = total + q, n + 1
        return [(p, *x) for p, x in sorted(out.items(), reverse=side == 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([ADD, ADD, CANCEL, TRADE]), st.integers(0, 1), st.integers(95, 105), st.integers(0, 9), st.integers(1, 12)), max_size=80))
def test_book_equals_recomputation(events):
    book, plain, used = Book(), PlainBook(), set()
    for et, side, price, qty, order_id in events:
        if et == ADD:
            if order_id in used or not qty:
                continue
            used.add(order_id)
        book.apply(et, side, price, qty, order_id)
        plain.apply(et, side, price, qty, order_id)
        assert [book.levels(s) for s in (0, 1)] == [plain.levels(s) for s in (0, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(9990, 10_010), st.integers(0, 500)), max_size=200))
def test_no_flags_on_adds_alone(adds):
    tape = scenarios.Tape()
    for side, price, qty in adds:
        tape.add(side, price, qty)
    assert replay(tape.events, Chain()) == []


def test_fold_equals_closed_form_at_any_partitioning(spark):
    events = [e for i in range(5) for e in scenarios.market(800, i, instrument=i)]
    random.Random(1).shuffle(events)
    df = scenarios.to_frame(spark, events)
    names = ["instrument_id", "side", "price", "total_qty", "order_count"]
    fold = sorted(map(tuple, final_books(df.repartition(7)).select(*names).collect()))
    assert fold == sorted(map(tuple, final_ladder(df).select(*names).collect())) and len(fold) > 50


def test_hash_depends_on_levels_only():
    a = feed(Book(), (ADD, 0, 9, 5, 1), (ADD, 1, 11, 5, 2))
    b = feed(Book(), (ADD, 1, 11, 2, 8), (ADD, 1, 11, 3, 9), (ADD, 0, 9, 5, 0))
    assert a.l2_hash() == b.l2_hash() != Book().l2_hash()


@pytest.mark.parametrize("kind", KINDS)
def test_each_scenario_fires_its_detector(spark, kind):
    events = scenarios.SCENARIOS[kind](3)
    assert events == scenarios.SCENARIOS[kind](3)
    flags = replay(events, Chain(kinds=(kind,)))
    assert flags and all(f[3] == kind and 0 <= f[8] <= 1 and f[4] <= f[5] for f in flags)
    assert sorted(map(repr, map(tuple, chain(scenarios.to_frame(spark, events), kinds=(kind,)).collect()))) == sorted(map(repr, flags))


def test_plain_adds_raise_no_flag():
    tape = scenarios.Tape()
    for i in range(2000):
        tape.add(i % 2, 10_000 - 1 - i % 16 if i % 2 == 0 else 10_001 + i % 16, 10)
    assert replay(tape.events, Chain()) == []


def phantom(parameters, *events):
    d = PhantomLiquidity(*parameters)
    return [f for f in (d.look(*e) for e in events) if f]


def test_phantom_rules():
    add, cut = (1, ADD, 0, 10_000, 500, 42, 1000), (5, CANCEL, 0, 10_000, 500, 42, 5000)
    flag = phantom((100, 1_000_000, 64, 100), add, cut)[0]
    assert flag[:4] == (1, 5, 1000, 5000) and flag[4] > 0.9 and flag[9] == 500
    assert not phantom((100, 1_000_000, 64, 100), add, (2, TRADE, 0, 10_000, 100, 42, 2000), cut)
    assert not phantom((10, 1000, 64, 100), add, (100, CANCEL, 0, 10_000, 500, 42, 50_000))
    assert not phantom((100, 1_000_000, 64, 1000), add, cut)
    assert phantom((5, 10_000_000, 64, 100), add, (500, CANCEL, 0, 10_000, 500, 42, 1_000_000))


def test_phantom_orders_are_forgotten_on_request():
    for forget, left in ((None, 500), (20, 21)):
        d = PhantomLiquidity(forget=forget)
        for k in range(1, 501):
            d.look(k, ADD, 0, 100 + k, 5, k, k)
        assert len(d.priced) == left


def decide(limits, *actions):
    gate = RiskGate(limits)
    return [r for i, a in enumerate(actions) for r in gate.step((i, 1, *a))]


def test_risk_gate():
    off = dict(orders_per_sec=None, position=None, loss=None, order_to_trade=None, gaps=None)
    buy = lambda q, ts=0: (ts, "intent", 1, 0, q, 0)
    fill = lambda side, q, p: (0, "fill", 1, side, q, p)
    assert [r[3] for r in decide(Limits(**off | {"orders_per_sec": 5}), *[buy(1)] * 6)] == [True] * 5 + [False]
    out = decide(Limits(**off | {"orders_per_sec": 5}), *[buy(1, i * 10**9) for i in range(20)])
    assert all(r[3] for r in out)
    assert decide(Limits(**off | {"position": 100}), fill(0, 90, 1), buy(20))[-1][4] == "PositionCap"
    assert decide(Limits(**off | {"loss": 1000}), fill(0, 10, 100), buy(1))[-1][3] is True
    assert decide(Limits(**off | {"loss": 1000}), fill(0, 12, 100), buy(1))[-1][4] == "DailyLossFloor"
    many = Limits(**off | {"order_to_trade": 2.0, "order_to_trade_warmup": 3})
    assert decide(many, fill(0, 1, 1), *[buy(1)] * 4)[-1][4] == "OrderToTradeRatio"
    gap = (0, "gap", 1, 0, 0, 0)
    assert [r[4] for r in decide(Limits(**off | {"gaps": 3}), gap, gap, gap)] == [None, None, "FeedGap"]
    halt, reset, day = ((0, x, 1, 0, 0, 0) for x in ("manual_halt", "reset", "start_of_day"))
    out = decide(Limits(**off), halt, buy(1), reset, buy(1), fill(0, 1, 1), day)
    assert [r[3] for r in out] == [None, False, None, True, None, None] and out[-1][5:] == (0, 0, 0, 0)


def test_risk_frame(spark):
    rows = [(i, i % 3, i * 10**9, "intent" if i % 2 else "fill", 1, i % 2, 5, 100) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, desk int, ts_ns long, action string, instrument_id int, side int, qty int, price long")
    assert risk_decisions(df.repartition(5)).count() == 60


def test_vpin_discards_the_overflow():
    assert replay([(1, 1, 7, 1), (2, 1, 8, -1), (3, 1, 9, 0), (4, 1, 0, 1), (5, 1, 3, 0)], VpinBuckets(10)) == [(1, 2, 1, 7, 8), (1, 5, 2, 5, 7)]


def ends(gap, gap_ns, *flags):
    return [r[1] for r in replay(list(flags), Clusterer(gap, gap_ns))]


def test_episodes_join_by_kind_and_initiator():
    f = lambda s, e, kind="Spoof", who=7, ts=0: (0, 1, s, e, ts, ts, kind, who, 0.5)
    assert ends(10, 0, f(1, 5), f(15, 20), f(31, 40)) == [1, 1, 2]
    assert ends(10, 0, f(1, 5), f(6, 9, who=8), f(10, 12)) == [1, 2, 3]
    assert ends(10, 0, f(1, 5, who=None), f(6, 9, who=None)) == [1, 2]
    assert ends(10, 0, f(1, 5, "FlashCrash", None), f(6, 9, "MomentumIgnition", None), f(12, 13, "FlashCrash", None)) == [1, 1, 2]
    assert ends(0, 100, f(1, 5, ts=0), f(9999, 9999, ts=90)) == [1, 1]


def test_episode_frame(spark):
    flags = chain(scenarios.to_frame(spark, scenarios.spoofing(1)), kinds=("Spoof",))
    out = episodes(flags, 10)
    assert out.agg({"n_flags": "sum"}).first()[0] == flags.count()


def test_gap_tracker():
    g = GapTracker(1, 3)
    got = replay([(1, "c", 1), (2, "c", 3), (3, "c", 3), (4, "c", 5), (5, "c", 2), (6, "c", 1), (7, "c", 7), (8, "c", 8), (9, "c", 9)], g)
    assert got == [("c", 1, 1), ("c", 2, 5), ("c", 3, 5)]
    assert g.open_gap() == (4, 4) and g.stats["duplicates"] == 2 and g.stats["overflow"] == 1 and g.stats["gaps_closed"] == 1
