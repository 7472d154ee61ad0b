import random
import struct

import pytest
from pyspark.sql import functions as F

from bookloom.functions.ranking import global_row_number
from bookloom.functions.scalars import register
from bookloom.operators import windows
from bookloom.operators.book import Book, final_books
from bookloom.schema import ADD, CANCEL, TRADE
from bookloom.sources import itch, records, scenarios
from bookloom.streaming.sinks import write_run


def capture(events):
    return [itch.encode(et, inst, ts, oid, side, price, qty) for _, inst, et, side, price, qty, oid, ts in events]


def test_lengths_and_decoding():
    assert [itch.LENGTHS[t] for t in "AFDXEP"] == [36, 40, 19, 23, 31, 44] and "Z" not in itch.LENGTHS
    add = itch.encode(ADD, 7, 5, 42, 0, 99_500_000, 12_345)
    assert len(add) == 36 and itch.decode(add) == (7, ADD, 0, 99_500_000, 12_345, 42, 5)
    raw = itch.encode(ADD, 1, 1 << 40, 2**64 - 1, 1, 5, 6) + itch.encode(CANCEL, 1, 2, 42) + itch.encode(CANCEL, 1, 3, 99, qty=7) + itch.encode(TRADE, 1, 4, 9, qty=3)
    assert list(itch.events_of(raw)) == [
        (1, 1, ADD, 1, 5, 6, -1, 1 << 40), (2, 1, CANCEL, 0, 0, 0, 42, 2), (3, 1, CANCEL, 0, 0, 7, 99, 3), (4, 1, TRADE, 0, 0, 3, 9, 4)
    ]
    assert [e[0] for e in itch.events_of(raw, start_at_ns=4)] == [1, 4]
    replace = struct.pack(">cHHHIQQII", b"U", 1, 0, 0, 9, 5, 6, 70, 80) + b""
    assert itch.decode(replace) is None and itch.decode(replace, True)[1] == 3


@pytest.mark.parametrize("seed", range(8))
def test_damaged_captures_never_raise_in_loose_reads(seed):
    rng = random.Random(seed)
    parts = capture(scenarios.market(300, seed))
    whole = list(itch.events_of(b"".join(parts)))
    raw = bytearray(b"".join(parts))
    cut = bytes(raw[: rng.randrange(len(raw))])
    got = list(itch.events_of(cut))
    assert got == whole[: len(got)]
    for _ in range(20):
        raw[rng.randrange(len(raw))] = rng.randrange(256)
    list(itch.events_of(bytes(raw)))
    list(itch.events_of(itch.framed(parts)[: -rng.randint(1, 30)], "binaryfile"))
    list(itch.events_of(rng.randbytes(3000)))
    with pytest.raises(itch.ItchError):
        list(itch.events_of(b"".join(parts)[:-1], strict=True))


def test_readers_agree(spark, tmp_path):
    events = scenarios.market(500, 1, instrument=9)
    parts = capture(events)
    (tmp_path / "a").write_bytes(itch.encode_directory(9, "ABC") + b"".join(parts))
    loose = itch.read_itch(spark, str(tmp_path / "a"))
    spark.dataSource.register(itch.ItchSource)
    source = spark.read.format("itch").load(str(tmp_path))
    rows = sorted(map(tuple, loose.drop("path").collect()))
    assert rows == sorted(map(tuple, source.drop("path").collect())) and len(rows) == 500
    (tmp_path / "b").write_bytes(itch.framed(parts))
    assert itch.read_itch(spark, str(tmp_path / "b"), "binaryfile").count() == 500
    assert [tuple(r) for r in itch.read_directory(spark, str(tmp_path / "a")).collect()] == [(9, "ABC")]
    book = Book()
    for r in rows:
        book.apply(*r[2:7])
    df = loose.drop("path")
    assert final_books(df).first()["l2_hash"] == f"{book.l2_hash():016x}"
    frames = spark.createDataFrame([(p,) for p in parts], "message binary")
    fixed = itch.project_fixed(frames)
    assert fixed.count() == df.filter("et = 1 or (et = 4 and price > 0)").count()
    assert not set(map(tuple, fixed.collect())) - {tuple(r[1:]) for r in rows}


def test_event_log(spark, tmp_path):
    events = scenarios.fuzz(300, 3)
    blob = b"".join(map(records.pack_event, events))
    assert len(blob) == 300 * 40
    (tmp_path / "log").write_bytes(blob)
    assert sorted(map(tuple, records.read_event_log(spark, str(tmp_path / "log")).drop("path").collect())) == events
    with pytest.raises(records.CorruptLog):
        list(records.unpack_log(bytes(blob)[:-1]))
    spark.dataSource.register(records.EventLogSource)
    parts = spark.read.format("eventlog").option("split_bytes", "1000").load(str(tmp_path / "log"))
    assert parts.rdd.getNumPartitions() == 12 and sorted(map(tuple, parts.drop("path").collect())) == events


def test_event_log_is_appended_to(spark, tmp_path):
    events = scenarios.fuzz(500, 4)
    folder = str(tmp_path / "logs")
    for part in (events[:200], events[200:201], events[201:], []):
        df = scenarios.to_frame(spark, part) if part else scenarios.to_frame(spark, events).limit(0)
        records.append_event_log(df.repartition(3), folder)
    rows = spark.read.format("eventlog").load(folder).orderBy("path", "seq").collect()
    assert [tuple(r)[2:] for r in rows] == [e[1:] for e in events]
    assert not [f for f in (tmp_path / "logs").iterdir() if f.name.startswith(".")]
    with pytest.raises(Exception, match="only appended"):
        scenarios.to_frame(spark, events).write.format("eventlog").mode("overwrite").save(folder)
    (tmp_path / "logs" / "odd.log").write_bytes(b"x" * 41)
    with pytest.raises(Exception, match="CorruptLog"):
        spark.read.format("eventlog").load(folder).count()


@pytest.mark.parametrize("split", [0, 3000, 20_011])
def test_captures_are_read_in_blocks(spark, tmp_path, split):
    """Blocks far smaller than the file; ranges that begin inside messages."""
    parts = capture(scenarios.market(2000, 5, instrument=9))
    other = capture(scenarios.market(700, 6, instrument=3))
    (tmp_path / "a").write_bytes(itch.framed([itch.encode_directory(9, "ABC"), *parts]))
    (tmp_path / "b").write_bytes(itch.framed(other))
    spark.dataSource.register(itch.ItchSource)
    read = spark.read.format("itch").option("framing", "binaryfile").option("block_bytes", "5000").option("split_bytes", str(split))
    df = read.load(str(tmp_path))
    want = [e[1:] for raw in (parts, other) for e in itch.events_of(b"".join(raw))]
    rows = itch.numbered(df).collect() if split else df.orderBy("path", "seq").collect()
    if split:
        assert df.rdd.getNumPartitions() > 2 and [r.seq for r in sorted(rows, key=lambda r: r.seq)] == list(range(1, 2701))
        rows = sorted(rows, key=lambda r: r.seq)
    assert [tuple(r)[2:] for r in rows] == want


def test_unframed_blocks_and_random_captures(spark, tmp_path):
    raw = itch.random_capture(3000, 7)
    (tmp_path / "c").write_bytes(raw)
    spark.dataSource.register(itch.ItchSource)
    df = spark.read.format("itch").option("block_bytes", "100").load(str(tmp_path / "c"))
    events = list(itch.events_of(raw))
    assert sorted(map(tuple, df.drop("path").collect())) == events and len(events) == 3000
    prints, seen = 0, set()
    for _, _, et, _, _, _, order_id, _ in events:
        seen |= {order_id} if et == ADD else set()
        prints += et == TRADE
        assert et != TRADE or order_id not in seen
    assert prints > 300
    hashes = {df.transform(lambda x: final_books(x.drop("path").repartition(n))).first()["l2_hash"] for n in (1, 7)}
    book = Book()
    for e in events:
        book.apply(*e[2:7])
    assert hashes == {f"{book.l2_hash():016x}"}


def test_wal_rotates_and_recovers(spark, tmp_path):
    wal = records.Wal(str(tmp_path), 100)
    for i in range(10):
        wal.append(bytes([i]) * 20)
    wal.close()
    segments = sorted(tmp_path.glob("wal-*.log"))
    assert len(segments) == 4
    rows = records.read_wal(spark, str(tmp_path)).orderBy("path", "offset").collect()
    assert [bytes(r.payload)[0] for r in rows] == list(range(10))
    segments[-1].write_bytes(segments[-1].read_bytes() + b"\x05\x00\x00\x00torn")
    assert records.read_wal(spark, str(tmp_path)).count() == 10
    wal = records.Wal(str(tmp_path), 100)
    wal.append(b"more")
    wal.close()
    assert records.read_wal(spark, str(tmp_path)).count() == 11
    raw = bytearray(segments[0].read_bytes())
    raw[10] ^= 1
    segments[0].write_bytes(bytes(raw))
    assert records.read_wal(spark, str(tmp_path)).count() == 8
    import zlib

    df = spark.createDataFrame([(b"a", zlib.crc32(b"a")), (b"b", 1)], "payload binary, crc long")
    assert records.checked(df).count() == 1


def test_packets(spark):
    packet = records.packet("S1", 5, [b"x", b"yy"])
    assert records.parse_packet(packet) == ("S1", 5, 2, [b"x", b"yy"])
    assert records.parse_packet(records.packet("S1", 9, [], 0xFFFF))[2] == 0xFFFF
    for bad in (packet[:-1], packet[:10], records.packet("S1", 5, [b"x"], 0)):
        with pytest.raises(records.BadPacket):
            records.parse_packet(bad)
    rows = [(1, packet), (2, packet[:-1]), (3, records.packet("S1", 7, [b"z"])), (4, records.packet("S1", 7, [b"z"]))]
    out = records.explode_packets(spark.createDataFrame(rows, "arrival long, packet binary"))
    assert sorted(r.seq for r in out.collect()) == [5, 6, 7, 7]
    delivered = windows.delivery(out, "session").collect()
    assert sorted((r.seq, r.duplicates, r.in_order) for r in delivered) == [(5, 0, True), (6, 0, True), (7, 1, True)]


def test_snapshots():
    events = scenarios.market(2000, 4)
    whole, half = Book(), Book()
    for e in events:
        whole.apply(*e[2:7])
    for e in events[:1000]:
        half.apply(*e[2:7])
    raw = records.snapshot(1000, half)
    seq, again = records.restore(raw)
    for e in events[seq:]:
        again.apply(*e[2:7])
    assert again.state() == whole.state()
    for bad in (raw[:10], b"XXXX" + raw[4:], raw[:-1], raw[:16] + b"\0" + raw[17:]):
        with pytest.raises(records.BadSnapshot):
            records.restore(bad)


def test_books_resumed_from_bytes_do_linear_work(monkeypatch):
    from bookloom.plans.formats import _Resumed

    restored, real = [], records.restore
    monkeypatch.setattr(records, "restore", lambda raw: restored.append(len(raw)) or real(raw))
    adds = [(k, 1, 1, k % 2, 100 + k % 40, 5, k, k) for k in range(1, 12_001)]
    cuts = [(12_000 + k, 1, 2 + k % 3, k % 2, 100 + k % 50, k % 7, 3 * k, k) for k in range(1, 1_051)]
    fold, book = _Resumed(), Book()
    for k, event in enumerate(adds + cuts, 1):
        before = fold.book
        fold.step(event)
        book.apply(*event[2:7])
        assert (fold.book is not before) == (k % 100 == 0)
    assert fold.book.state() == book.state() and len(book.orders) > 10_000
    assert restored and sum(restored) < 6 * len(records.snapshot(0, book))


def test_synthetic_streams(spark):
    df = scenarios.synthetic(spark, 3000, 4, parts=3)
    assert df.select("seq").distinct().count() == 3000 and sorted(map(tuple, df.collect())) == sorted(map(tuple, scenarios.synthetic(spark, 3000, 4, parts=7).collect()))
    storm = list(scenarios.storm("Spoof", 1, 500))
    assert [e[0] for e in storm] == list(range(1, 501)) and storm == list(scenarios.storm("Spoof", 1, 500))


def test_global_rank(spark):
    rows = list(range(500))
    random.Random(2).shuffle(rows)
    out = global_row_number(spark.createDataFrame([(r,) for r in rows], "x long").repartition(6), ["x"], "n")
    assert all(r.n == r.x + 1 for r in out.collect())
    assert global_row_number(spark.createDataFrame([], "x long"), ["x"], "n").count() == 0


@pytest.mark.parametrize(
    ("row", "score", "regime"),
    [
        ("1, 0, 0, 1, 0, 0, 100, false", 0.0, 0), ("1, 0, 0.12, 1, 0, 0, 100, false", 0.6, 1), ("1, 0, 0.3, 1, 0, 0, 100, false", 1.5, 2),
        ("1, 0, 0.6, 1, 0, 0, 100, false", 3.0, 3), ("1, 0.3, 0, 1, 0, 0, 100, false", 0.9, 1), ("9, 0.3, 0.1, 1, 0, 0, 100, true", 0.5, 0),
        ("1, 0, 0.3, 1, 0, 0, 15, false", 0.75, 1), ("1, 0, 0.6, 1, 0, 0, 0, false", 3.0, 3), ("1, 0, 0, 1, 0, 10, 100, false", 3.0, 3),
        ("1, 0, 0, 2, 0, 0, 100, false", 0.6, 1),
    ],
)
def test_regime_vectors(spark, row, score, regime):
    from bookloom.functions.scalars import regime_class

    register(spark)
    got = spark.sql(f"select round(regime_score({row}), 9) as s").withColumn("r", regime_class(F.col("s"))).first()
    assert (got.s, got.r) == (pytest.approx(score), regime)


def test_run_artefacts(spark, tmp_path):
    events = scenarios.to_frame(spark, scenarios.market(50, 1))
    flags = spark.createDataFrame([("Spoof", 1)], "kind string, x int")
    write_run(str(tmp_path), events, events, flags, -50.0)
    assert spark.read.json(str(tmp_path / "ticks")).count() == 1
    assert spark.read.json(str(tmp_path / "run")).first()["verdict"] == "DAMAGED"
