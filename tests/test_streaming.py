import pytest
from pyspark.sql import functions as F

from bookloom.operators.book import top_of_book
from bookloom.operators.detectors import chain
from bookloom.operators.sequential import Limits, risk_decisions, vpin
from bookloom.schema import EVENT
from bookloom.sources import itch, records, scenarios
from bookloom.streaming import folds, live, sinks


@pytest.fixture
def stream(spark, tmp_path):
    folds.prepare(spark)
    source = tmp_path / "in"

    def add(events, name):
        scenarios.to_frame(spark, events).coalesce(1).write.mode("append").parquet(str(source))

    def read():
        return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", "1").parquet(str(source))

    def run(make, name):
        out = str(tmp_path / name)
        sinks.stream_to(make(read()), out, str(tmp_path / f"{name}-checkpoint")).awaitTermination()
        return sorted(map(repr, map(tuple, spark.read.parquet(out).collect())))

    return add, run


def test_streams_resume_and_equal_batch(spark, stream):
    add, run = stream
    events = [e for i in range(3) for e in scenarios.market(300, i, instrument=i)]
    first, rest = [e for e in events if e[0] <= 140], [e for e in events if e[0] > 140]
    df = scenarios.to_frame(spark, events)
    add(first, 1)
    run(lambda s: folds.stream_top_of_book(s, 3), "tops")
    run(folds.stream_chain, "flags")
    add(rest, 2)
    assert run(lambda s: folds.stream_top_of_book(s, 3), "tops") == sorted(map(repr, map(tuple, top_of_book(df, 3).collect())))
    assert run(folds.stream_chain, "flags") == sorted(map(repr, map(tuple, chain(df).collect())))


def test_risk_and_vpin_streams_equal_batch(spark, stream):
    add, run = stream
    events = [e for i in range(2) for e in scenarios.market(200, i, instrument=i)]
    add([e for e in events if e[0] <= 90], 1)
    add([e for e in events if e[0] > 90], 2)

    def actions(df):
        kind = F.when(F.col("et") == 4, "fill").otherwise("intent")
        return df.withColumn("desk", F.col("instrument_id")).withColumn("action", kind)

    def trades(df):
        return df.filter("et = 4").withColumn("sign", (F.col("side") * 2 - 1).cast("int"))

    df, limits = scenarios.to_frame(spark, events), Limits(orders_per_sec=None, position=900)
    want = sorted(map(repr, map(tuple, risk_decisions(actions(df), limits).collect())))
    assert run(lambda s: folds.stream_risk(actions(s), limits), "risk") == want
    want = sorted(map(repr, map(tuple, vpin(trades(df), 300).drop("vpin").collect())))
    assert run(lambda s: folds.stream_vpin(trades(s), 300), "vpin") == want and want


def test_sequencer_orders_and_drops_duplicates(spark, stream):
    add, run = stream
    events = scenarios.market(60, 9)
    add(events[30:], 1)
    assert run(lambda s: folds.sequence(s, "instrument_id"), "ordered") == []
    add(events[:29] + events[:5], 2)
    assert len(run(lambda s: folds.sequence(s, "instrument_id"), "ordered")) == 29
    add(events[29:31], 3)
    got = run(lambda s: folds.sequence(s, "instrument_id"), "ordered")
    assert got == sorted(map(repr, events))


def test_rates_wait_for_the_watermark(spark, stream):
    add, run = stream
    tape = scenarios.Tape(gap_ns=100_000_000)
    for i in range(300):
        tape.put(1 + 3 * (i % 2), 0, 1, 1, i + 1)
    add(tape.events, 1)
    late = scenarios.Tape(seq=301, ts=10**11)
    late.put(1, 0, 1, 1, 999)
    add(late.events, 2)
    out = run(lambda s: folds.stream_rates(s, "2 seconds"), "rates")
    assert len(out) == 30


def test_landed_packets_become_events_in_sequence(spark, tmp_path):
    """Two receivers, late and repeated packets, a torn record and a malformed one."""
    folds.prepare(spark)
    folder, out = tmp_path / "landed", str(tmp_path / "events")
    folder.mkdir()
    events = scenarios.market(120, 3)
    messages = [itch.encode(et, inst, ts, oid, side, price, qty) for _, inst, et, side, price, qty, oid, ts in events]
    events = [(1 + k, *itch.decode(m)) for k, m in enumerate(messages)]
    packets = [records.packet("S1", 1 + k, messages[k : k + 7]) for k in range(0, 120, 7)]

    def land(name, chosen, tail=b""):
        (folder / name).write_bytes(b"".join(map(records.wal_record, chosen)) + tail)

    def run():
        sinks.stream_to(live.live_events(spark, str(folder)), out, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    land("a", [packets[1], packets[0], packets[0], packets[3][:-1], records.packet("S1", 500, [], 0)])
    assert run() == events[:14]
    land("b", packets[3:10], b"torn")
    assert run() == events[:14]
    land("c", packets[2:4][::-1])
    land("d", packets[9:])
    assert run() == events


def test_replay_at_a_pace(spark, tmp_path):
    folds.prepare(spark)
    for k in range(4):
        scenarios.to_frame(spark, scenarios.market(30, k, instrument=k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = sinks.stream_to(live.replayed(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [30] * 4
