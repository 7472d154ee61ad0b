"""Seeded event streams: an ordinary market, and the patterns that the detectors look for.

Every generator is a function of its seed, so a stream can be made anew anywhere. Events
are tuples in the order of ``schema.EVENT_COLUMNS``.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookloom.schema import ADD, ASK, BID, CANCEL, EVENT, MODIFY, TRADE

#: Shares of adds and cancels (the rest are trades) of the ordinary mixes.
MIXES = {"realistic": (0.60, 0.25), "bursty": (0.35, 0.55), "cancel_heavy": (0.28, 0.70)}


class Tape:
    """Numbers events as they are written."""

    def __init__(self, instrument: int = 1, seq: int = 1, ts: int = 0, gap_ns: int = 1000, first_id: int = 1):
        self.instrument, self.seq, self.ts, self.gap_ns, self.next_id = instrument, seq, ts, gap_ns, first_id
        self.events: list[tuple] = []

    def put(self, et: int, side: int, price: int, qty: int, order_id: int) -> None:
        self.events.append((self.seq, self.instrument, et, side, price, qty, order_id, self.ts))
        self.seq += 1
        self.ts += self.gap_ns

    def add(self, side: int, price: int, qty: int) -> int:
        order_id = self.next_id
        self.next_id += 1
        self.put(ADD, side, price, qty, order_id)
        return order_id

    def ladder(self, mid: int, levels: int, qty: int) -> dict[int, int]:
        """Orders on both sides of ``mid``; their ids by price."""
        return {p: self.add(s, p, qty) for k in range(1, levels + 1) for s, p in ((BID, mid - k), (ASK, mid + k))}


def market(n: int, seed: int, mix: str = "realistic", mid: int = 10_000, instrument: int = 1, modify: float = 0.0) -> list[tuple]:
    """Adds around a mid, cancels and trades of live orders."""
    rng, tape = random.Random(f"{mix}:{seed}"), Tape(instrument)
    adds, cancels = MIXES[mix]
    live: list[tuple[int, int, int, int]] = []
    while len(tape.events) < n:
        x = rng.random()
        if x < adds or not live:
            side = rng.randrange(2)
            off = 1 + min(int(rng.expovariate(0.5)), 24)
            price, qty = mid - off if side == BID else mid + off, rng.randint(1, 1000)
            live.append((tape.add(side, price, qty), side, price, qty))
            continue
        k = rng.randrange(len(live))
        order_id, side, price, qty = live[k]
        if x < adds + cancels:
            live[k] = live[-1]
            live.pop()
            tape.put(CANCEL, side, price, 0, order_id)
        elif rng.random() < modify:
            tape.put(MODIFY, side, price, rng.randint(1, 1000), order_id)
        else:
            tape.put(TRADE, side, price, rng.randint(1, max(qty // 2, 1)), order_id)
    return tape.events


def fuzz(n: int, seed: int, ids: int = 4000) -> list[tuple]:
    """All event types with re-used and anonymous orders and crossed prices."""
    rng, tape = random.Random(seed), Tape()
    for _ in range(n):
        tape.put(rng.randint(1, 5), rng.randrange(2), rng.randint(9900, 10_099), rng.randint(0, 500), rng.randint(0, ids))
    return tape.events


def phantom(seed: int, cycles: int = 40, mid: int = 10_000) -> list[tuple]:
    rng, tape = random.Random(seed), Tape()
    for _ in range(cycles):
        side, off, qty = rng.randrange(2), rng.randint(2, 33), rng.randint(200, 1000)
        price = mid - off if side == BID else mid + off
        tape.put(CANCEL, side, price, qty, tape.add(side, price, qty))
    return tape.events


def quote_stuffing(seed: int, bursts: int = 4, mid: int = 10_000) -> list[tuple]:
    rng, tape = random.Random(seed), Tape(first_id=500)
    for _ in range(bursts):
        for side in (ASK, BID, ASK, BID):
            tape.put(TRADE, side, mid + (1 if side == ASK else -1), 100, tape.next_id)
            for _ in range(rng.randint(10, 16)):
                tape.next_id += 1
                tape.put(CANCEL, 1 - side, mid + rng.randint(-4, 4), 100, tape.next_id)
    return tape.events


def spoofing(seed: int, cycles: int = 20, mid: int = 10_000) -> list[tuple]:
    rng, tape = random.Random(seed), Tape()
    for _ in range(cycles):
        side = rng.randrange(2)
        price, qty = mid - 3 if side == BID else mid + 3, rng.randint(2000, 8000)
        order_id = tape.add(side, price, qty)
        for _ in range(rng.randint(0, 10)):
            tape.add(1 - side, mid + 2 if side == BID else mid - 2, rng.randint(1, 90))
        tape.put(CANCEL, side, price, qty, order_id)
    return tape.events


def cancel_storm(seed: int, calm: int = 6000, storm: int = 3000, mid: int = 10_000) -> list[tuple]:
    events = market(calm, seed, mid=mid)
    rng, tape = random.Random(seed), Tape(seq=calm + 1, ts=calm * 1000, first_id=1_000_000)
    for _ in range(storm):
        if rng.random() < 0.03:
            tape.add(rng.randrange(2), mid, 10)
        else:
            tape.next_id += 1
            tape.put(CANCEL, rng.randrange(2), mid, 10, tape.next_id)
    return events + tape.events


def ignition(seed: int, up: bool = True, mid: int = 10_000, steps: int = 14) -> list[tuple]:
    rng, tape = random.Random(seed), Tape()
    side, way = (ASK, 1) if up else (BID, -1)
    orders = tape.ladder(mid, steps + 20, 100)
    for k in range(1, steps + 1):
        # The level is bought away and the other side follows.
        tape.put(TRADE, side, mid + way * k, 100, orders[mid + way * k])
        tape.add(1 - side, mid + way * (k - 1), rng.randint(50, 150))
    return tape.events


def crash(seed: int, down: bool = True, mid: int = 10_000, levels: int = 10) -> list[tuple]:
    rng, tape = random.Random(seed), Tape()
    side, way = (BID, -1) if down else (ASK, 1)
    # Deep on the side that breaks, thin on the other.
    orders = {}
    for k in range(1, levels + 1):
        orders[k] = tape.add(side, mid + way * k, rng.randint(90, 110))
        tape.add(1 - side, mid - way * k, 10)
    far = [tape.add(side, mid + way * (40 + k), 100) for k in range(4)]
    for _ in range(4):
        tape.put(TRADE, side, mid + way * levels, 5, orders[levels])
    for k in range(1, levels + 1):
        tape.put(CANCEL, side, mid + way * k, 0, orders[k])
    for k, order_id in enumerate(far):
        tape.put(TRADE, side, mid + way * (40 + k), 10, order_id)
    return tape.events


def reaction(seed: int, cycles: int = 3, mid: int = 10_000) -> list[tuple]:
    rng, tape = random.Random(seed), Tape()
    for c in range(cycles):
        orders = tape.ladder(mid, 10, 1000)
        tape.put(TRADE, ASK, mid + 1, 300, orders[mid + 1])
        for _ in range(8):
            tape.add(BID, mid - rng.randint(1, 2), 20)
        for _ in range(1100 if c + 1 < cycles else 0):
            tape.add(BID, mid - 30, 1)
    return tape.events


SCENARIOS: dict[str, Callable[[int], list[tuple]]] = {
    "QuoteStuff": quote_stuffing,
    "Spoof": spoofing,
    "PhantomLiquidity": phantom,
    "CancellationStorm": cancel_storm,
    "MomentumIgnition": ignition,
    "FlashCrash": crash,
    "LatencyArbitrage": reaction,
}


#: What grows with a scenario's severity: an argument, at severity 0 and at 1.
SCALES: dict[str, tuple[str, int, int]] = {
    "QuoteStuff": ("bursts", 2, 12),
    "Spoof": ("cycles", 4, 60),
    "PhantomLiquidity": ("cycles", 10, 120),
    "CancellationStorm": ("storm", 500, 6000),
    "MomentumIgnition": ("steps", 6, 30),
    "FlashCrash": ("levels", 6, 20),
    "LatencyArbitrage": ("cycles", 1, 6),
}


def script(kind: str, seed: int, severity: float | None = None) -> list[tuple]:
    """One run of a scenario, as it stands or at a severity from 0 to 1."""
    if severity is None:
        return SCENARIOS[kind](seed)
    name, low, high = SCALES[kind]
    return SCENARIOS[kind](seed, **{name: round(low + (high - low) * min(max(severity, 0.0), 1.0))})


def storm(kind: str, seed: int, events: int, severity: float | None = None, step_ns: int | None = None) -> Iterator[tuple]:
    """A scenario run again with seed, seed + 1, ... until ``events`` events stand, numbered through.

    With ``step_ns``, events are that far apart, whatever their script's times.
    """
    seq, ts = 0, 0
    restart = 0
    while seq < events:
        base_seq, base_ts = seq, ts
        for e in script(kind, seed + restart, severity):
            if seq >= events:
                return
            seq = base_seq + e[0]
            ts = base_ts + e[7] + 1 if step_ns is None else (seq - 1) * step_ns
            order_id = e[6] and e[6] + (restart << 32)
            yield (seq, *e[1:6], order_id, ts)
        restart += 1


class Orchestrator:
    """Runs one scenario at a time until its time is over: start, stop, poll.

    ``poll`` gives the events due by then, at most ``most`` scripts of them at once; a
    script that has ended starts again with the next seed.
    """

    def __init__(self, most: int = 32):
        self.most, self.active = most, None

    def start(self, kind: str, seed: int, duration_ns: int, now_ns: int, severity: float | None = None) -> dict:
        self.active = {"kind": kind, "severity": severity, "seed": seed, "started_at_ns": now_ns, "expires_at_ns": now_ns + max(duration_ns, 1), "due_ns": now_ns, "restarts": 0}
        return self.snapshot()

    def stop(self) -> None:
        self.active = None

    def snapshot(self) -> dict:
        return {"mode": "active", **self.active} if self.active else {"mode": "idle"}

    def poll(self, now_ns: int, base_seq: int) -> list[tuple]:
        out: list[tuple] = []
        for _ in range(self.most):
            a = self.active
            if a is None:
                break
            if now_ns >= a["expires_at_ns"]:
                self.stop()
                break
            if a["due_ns"] > now_ns:
                break
            events = script(a["kind"], a["seed"] + a["restarts"], a["severity"])
            for e in events:
                order_id = e[6] and e[6] + (a["restarts"] << 32)
                out.append((base_seq + len(out), *e[1:6], order_id, a["due_ns"] + e[7]))
            a["due_ns"] += events[-1][7] + 1
            a["restarts"] += 1
        return out


def crashy(n: int, seed: int, every: int = 5000, mid: int = 10_000) -> list[tuple]:
    """An ordinary market with a sweep of fifty cancels and eight trades every ``every`` events."""
    out: list[tuple] = []
    live: dict[int, tuple] = {}
    seq = 0
    for e in market(n, seed, mid=mid):
        batch = [e]
        if e[2] == ADD:
            live[e[6]] = e
        elif e[2] == CANCEL:
            live.pop(e[6], None)
        if e[0] % every == 0:
            victims = [live.pop(k) for k in list(live)[:58]]
            batch += [(0, v[1], CANCEL if k < 50 else TRADE, v[3], v[4], 0 if k < 50 else v[5], v[6], e[7]) for k, v in enumerate(victims)]
        for x in batch:
            seq += 1
            out.append((seq, *x[1:]))
    return out[:n]


def to_frame(spark: SparkSession, events: list[tuple]) -> DataFrame:
    return spark.createDataFrame(events, EVENT)


def phased(spark: SparkSession, n: int, instruments: int = 16, seed: int = 42, phase: int = 10_000) -> DataFrame:
    """``synthetic`` in four phases in turn: calm, one-sided quotes, heavy trading, a fall of the mid."""
    rows = synthetic(spark, n, instruments, seed)
    turn = F.pmod(F.floor((F.col("seq") - 1) / phase), F.lit(4))
    rows = rows.withColumn("side", F.when(turn == 1, 0).otherwise(F.col("side")).cast("int"))
    rows = rows.withColumn("price", F.when(F.col("side") == 0, 10_000 - F.abs(F.col("price") - 10_000)).otherwise(10_000 + F.abs(F.col("price") - 10_000)))
    rows = rows.withColumn("qty", F.when((turn == 2) & (F.col("et") == TRADE), F.col("qty") * 3).otherwise(F.col("qty")))
    drop = F.when(turn == 3, F.floor(F.pmod(F.col("seq"), F.lit(phase)) * 100 / phase)).otherwise(0)
    return rows.withColumn("price", (F.col("price") - drop).cast("long")).select(*EVENT.fieldNames())


def synthetic(spark: SparkSession, n: int, instruments: int = 16, seed: int = 42, parts: int | None = None) -> DataFrame:
    """A large ordinary stream made on the executors: hashes of the row number decide everything.

    Every third event adds; each add is followed by a trade and a cancel of its order.
    """
    rows = spark.range(1, n + 1, 1, parts).withColumnRenamed("id", "seq")
    cycle = F.floor((F.col("seq") - 1) / 3)
    draw = lambda k, m: F.pmod(F.xxhash64(cycle, F.lit(seed), F.lit(k)), F.lit(m))
    et = F.element_at(F.array(F.lit(ADD), F.lit(TRADE), F.lit(CANCEL)), (F.col("seq") % 3).cast("int") * 0 + F.pmod(F.col("seq") - 1, F.lit(3)).cast("int") + 1)
    side, off, qty = draw(1, 2), 1 + draw(2, 50), 10 + draw(3, 990)
    return rows.select(
        "seq", draw(0, instruments).cast("int").alias("instrument_id"), et.alias("et"), side.cast("int").alias("side"),
        F.when(side == 0, 10_000 - off).otherwise(10_000 + off).alias("price"),
        F.when(et == ADD, qty).when(et == TRADE, F.floor(qty / 4) + 1).otherwise(0).cast("long").alias("qty"),
        (cycle + 1).cast("long").alias("order_id"), (F.col("seq") * 1000).alias("ts_ns"),
    )


def tick_feed(spark: SparkSession, n: int, instruments: int = 4, seed: int = 42, step_ns: int = 20_000_000) -> DataFrame:
    """Quotes of a correlated random walk for displays: instrument_id, seq, ts_ns, mid, spread, bids, asks, print_qty.

    Steps of all instruments share a common part. A fifth of the time a storm is on, of five
    kinds in turn: wide spreads, thin bids, thin asks, large prints, a falling mid.
    """
    step = F.col("step")
    draw = lambda k, m, *more: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), step, *more), F.lit(m))
    rows = spark.range(n).select(F.col("id").alias("step"))
    every = F.array(*[F.lit(k).cast("int") for k in range(instruments)])
    rows = rows.select("step", F.explode(every).alias("instrument_id"))
    storm = F.when(F.floor(step / 100) % 5 == 4, F.floor(step / 500) % 5).otherwise(-1)
    own = draw(1, 5) - 2 + draw(2, 3, F.col("instrument_id")) - 1 - F.when(storm == 4, 2).otherwise(0)
    rows = rows.withColumn("storm", storm.cast("int"))
    walk = F.sum(own).over(Window.partitionBy("instrument_id").orderBy("step"))
    rows = rows.withColumn("mid", F.greatest(10_000 + walk, F.lit(100)))
    spread = 1 + draw(3, 3) + F.when(F.col("storm") == 0, 8).otherwise(0)
    ladder = lambda way, thin: F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda k: F.struct(
            (F.col("mid") + way * (F.floor((F.col("spread") + 1) / 2) + k)).alias("price"),
            F.when(F.col("storm") == thin, 5).otherwise(100 + F.pmod(F.xxhash64(step, "instrument_id", k, F.lit(way)), F.lit(400))).cast("long").alias("qty"),
        ),
    )
    rows = rows.withColumn("spread", spread)
    size = F.when(draw(4, 4) == 0, draw(5, 200) + F.when(F.col("storm") == 3, 2000).otherwise(0)).otherwise(0)
    return rows.select(
        "instrument_id", (step + 1).alias("seq"), (step * step_ns).alias("ts_ns"), "mid", "spread", "storm",
        ladder(-1, 1).alias("bids"), ladder(1, 2).alias("asks"), size.cast("long").alias("print_qty"),
    )
