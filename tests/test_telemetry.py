import pytest
from pyspark.sql import functions as F

from bookloom import sources
from bookloom.functions import scalars
from bookloom.operators import telemetry, windows
from bookloom.operators.book import Book, TopOfBook, top_of_book
from bookloom.operators.fold import replay
from bookloom.operators.telemetry import StateHash
from bookloom.sources import itch, records, scenarios
from bookloom.streaming.sinks import bounded, first_per_second, frames, latest


@pytest.mark.parametrize("seed", range(3))
def test_book_bytes_depend_on_state_only(seed, tmp_path):
    book = Book()
    for e in scenarios.fuzz(1500, seed):
        book.apply(*e[2:7])
    again = Book.from_bytes(book.to_bytes())
    assert again.state() == book.state() and again.to_bytes() == book.to_bytes() and again.best_bid == book.best_bid
    records.write_snapshot(str(tmp_path / "x" / "s"), 1500, book)
    assert records.read_snapshot(str(tmp_path / "x" / "s"))[1].state() == book.state()
    with pytest.raises(ValueError):
        Book.from_bytes(book.to_bytes()[:-1])


def test_state_hash_chain(spark):
    events = scenarios.market(200, 1)
    whole = replay(events, StateHash())
    assert len(whole) == 200 and len({r[2] for r in whole}) == 200
    other = [*events[:50], (events[50][0], *events[50][1:5], events[50][5] + 1, *events[50][6:]), *events[51:]]
    diverged = replay(other, StateHash())
    assert [a == b for a, b in zip(whole, diverged)].index(False) == 50 and whole[-1] != diverged[-1]
    gap = events[:10] + events[11:]
    assert len(replay(gap, StateHash(strict=True))) == 10 and replay(gap, StateHash())[10][3]
    a, b = (telemetry.state_hashes(scenarios.to_frame(spark, x)) for x in (events, other))
    assert telemetry.same_state(a, a).isEmpty() and telemetry.same_state(a, b).count() == 150


def test_ticks_agree_with_the_fold(spark):
    events = scenarios.market(600, 3)
    df = scenarios.to_frame(spark, events)
    out = {r.seq: r for r in telemetry.ticks(df, 50_000, 500, 5, 16).collect()}
    tops = {r[1]: r for r in replay(events, TopOfBook())}
    assert out
    for seq, r in out.items():
        bid, ask = tops[seq][10], tops[seq][11]
        assert bid < ask and r.spread == ask - bid and r.mid == (bid + ask) // 2 and bid <= r.microprice <= ask
        assert 0 <= r.vpin <= 1.5 and r.blowout > 0 and -1 <= r.imbalance <= 1
    assert all(seq == max(s for s in tops if tops[s][7] // 50_000 == r.bucket and None not in tops[s][10:12] and tops[s][10] < tops[s][11]) for seq, r in out.items())


def test_ladder_frames(spark):
    """Every period has its frame, the last one too."""
    events = scenarios.market(300, 2)
    rows = sorted(telemetry.ladder_frames(scenarios.to_frame(spark, events), 100_000, 3).collect(), key=lambda r: r.seq)
    ends = {e[7] // 100_000: e[0] for e in events}
    assert [(r.bucket, r.seq) for r in rows] == sorted(ends.items()) and len(rows) == 3
    for r in rows:
        book = Book()
        for e in events[: r.seq]:
            book.apply(*e[2:7])
        assert [tuple(x) for x in r.bids] == book.levels(0)[:3] and [tuple(x) for x in r.asks] == book.levels(1)[:3]


def test_orchestrator_restarts_until_its_time_is_over():
    o = scenarios.Orchestrator(most=4)
    assert o.snapshot() == {"mode": "idle"} and o.poll(0, 1) == []
    o.start("Spoof", 5, 10**6, 0)
    events = o.poll(500_000, 1)
    assert [e[0] for e in events] == list(range(1, len(events) + 1)) and o.snapshot()["restarts"] >= 2
    again = scenarios.Orchestrator(most=4)
    again.start("Spoof", 5, 10**6, 0)
    assert again.poll(500_000, 1) == events
    assert o.poll(10**6, 1000) == [] and o.snapshot()["mode"] == "idle"


def test_crashy_and_phased(spark):
    events = scenarios.crashy(6000, 1, 2000)
    assert len(events) == 6000 and [e[0] for e in events] == list(range(1, 6001))
    df = sources.events(spark, "phased", n=4000, phase=500)
    assert df.count() == 4000 and df.columns == scenarios.EVENT.fieldNames()
    assert df.filter("seq between 501 and 1000").select("side").distinct().count() == 1


def test_sources_by_name(spark, tmp_path):
    (tmp_path / "a").write_bytes(itch.encode_directory(1, "abc") + itch.encode(1, 1, 0, 1, 0, 5, 5))
    assert sources.events(spark, "itch", str(tmp_path / "a")).count() == 1
    names = itch.read_directory(spark, str(tmp_path / "a"))
    assert itch.instrument_of(names, " ABC ").first().instrument_id == 1
    assert sources.events(spark, "synthetic", n=9).count() == 9
    with pytest.raises(ValueError):
        sources.events(spark, "nowhere")


def test_views(spark):
    df = scenarios.to_frame(spark, scenarios.market(50, 1))
    assert latest(df, 3).count() == 3 and first_per_second(df).count() == 1
    assert frames(df, "tick").first().payload.startswith("{")
    ok = df.limit(1).select(telemetry.valid_run_id(F.lit("2024-01-31T09-30-00Z")).alias("a"), telemetry.valid_run_id(F.lit("../x")).alias("b")).first()
    assert (ok.a, ok.b) == (True, False)


def test_rolling_spread_by_hand(spark):
    rows = [(1, i, b, a) for i, (b, a) in enumerate([(10, 12), (10, 14), (10, 10), (None, 9), (9, 15)])]
    tops = spark.createDataFrame(rows, "instrument_id int, seq long, bid long, ask long")
    out = sorted(map(tuple, windows.rolling_spread(tops, 2).collect()))
    assert [(r[1], r[2], r[3]) for r in out] == [(0, 2, 2.0), (1, 4, 3.0), (4, 6, 5.0)] and out[2][4] == pytest.approx(1.2)


def test_tops_filter_to_trades(spark):
    df = scenarios.to_frame(spark, scenarios.market(200, 1))
    assert top_of_book(df, trades_only=True).count() == df.filter("et = 4").count()


def test_severity_and_pace_of_storms():
    for kind in scenarios.SCENARIOS:
        mild, wild = (scenarios.script(kind, 3, severity) for severity in (0.0, 1.0))
        assert len(mild) < len(wild) and scenarios.script(kind, 3, 7.0) == wild, kind
    paced = list(scenarios.storm("Spoof", 1, 50, 0.5, 1000))
    assert [e[7] for e in paced] == [1000 * k for k in range(50)]
    o = scenarios.Orchestrator(most=1)
    o.start("Spoof", 5, 10**6, 0, severity=0.0)
    assert len(o.poll(0, 1)) == len(scenarios.script("Spoof", 5, 0.0))


def test_bounded_channel(spark):
    rows = [(1, i, i * 10) for i in range(10)] + [(2, 1, 5)]
    out = sorted(map(tuple, bounded(spark.createDataFrame(rows, "instrument_id int, seq long, ts_ns long"), 2, 50).collect()))
    assert out == [(1, 0, 0, 0), (1, 1, 10, 0), (1, 5, 50, 3), (1, 6, 60, 3), (2, 1, 5, 0)]


def test_tick_feed(spark):
    df = scenarios.tick_feed(spark, 600, 2)
    rows = df.collect()
    assert len(rows) == 1200 and sorted(map(str, rows)) == sorted(map(str, scenarios.tick_feed(spark, 600, 2).repartition(5).collect()))
    assert all(len(r.bids) == 10 and r.bids[0].price < r.asks[0].price for r in rows) and {r.storm for r in rows} >= {-1, 0}


def test_rearming_locks(spark):
    rows = [(1, 1, 10), (2, 2, 20), (3, 1, 30), (4, 2, 40), (5, 1, 45), (6, 2, 60), (7, 2, 200), (8, 1, 210), (9, 2, 220)]
    df = spark.createDataFrame([(s, i, 4, 0, 1, 1, s, t) for s, i, t in rows], scenarios.EVENT)
    assert sorted(map(tuple, windows.rearming_locks(df, 2, 100).collect())) == [(1, 3, 8), (2, 9, None)]


def test_scalars(spark):
    df = spark.createDataFrame([(5,), (95,)], "x long")
    out = df.select(scalars.clamp(F.col("x"), 10.0, 90.0), scalars.lerp(2.0, 4.0, F.col("x") / 100), scalars.cycles(F.col("x"), 10)).collect()
    assert [tuple(r) for r in out] == [(10.0, 2.1, 1), (90.0, 3.9, 9)]
    quotes = [(p, b, a) for p in (9, 10, 11, 12, 13) for b, a in ((10, 12), (12, 10), (None, 12), (10, None), (11, 11))]
    got = spark.createDataFrame(quotes, "p long, b long, a long").select(scalars.aggressor(F.col("p"), F.col("b"), F.col("a"))).collect()
    assert [r[0] for r in got] == [scalars.aggressor_of(*q) for q in quotes]


@pytest.mark.parametrize("segment", [1, 7, 64, 10_000])
def test_segments_of_an_instrument_change_nothing(spark, segment):
    """One hot instrument and small ones, with gaps in the sequence; widths below and above a segment."""
    events = [e for e in scenarios.market(700, 1, "bursty") if e[0] % 11] + [e for k in (2, 3) for e in scenarios.market(40, k, instrument=k)]
    df = scenarios.to_frame(spark, events).repartition(3)
    tops = top_of_book(df, depth=0)
    for f in (
        lambda x: windows.with_iseq(df, x), lambda x: windows.quote_stuff(df, 20, 0.5, x), lambda x: windows.spoof(df, 100, 64, x),
        lambda x: windows.cancel_rate(df, 50, 10, x), lambda x: windows.rolling_spread(tops, 16, x),
    ):
        want = sorted(map(repr, f(None).collect()))
        assert sorted(map(repr, f(segment).collect())) == want and len(want) > 10
