"""Every catalogue query over the smallest tables: against DuckDB, or against brute force where SQL cannot tell."""

import math

import duckdb
import pytest
import xxhash
from pyspark.sql import Row

from bookloom.operators.detectors import Chain
from bookloom.operators.fold import replay
from bookloom.plans import ORACLE_SQL, QUERIES
from bookloom.plans.catalogue import SCALED
from bookloom.schema import EVENT_COLUMNS, KINDS
from bookloom.sources import scenarios
from bookloom.sources.testmarket import from_events, from_lineitem
from tests import brute_detectors as brute

SF = "/root/testdata/sf0.001"
TABLES = "events lineitem supplier".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in out.collect())
    want = duck.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert got == sorted(map(repr, want))


def _streams(spark, source):
    """Each instrument's events in order, as rows."""
    out = {}
    for e in sorted(source(spark, SF).collect(), key=lambda e: e.seq):
        out.setdefault(e.instrument_id, []).append(e)
    return out


def _placed(rows):
    return [(k, e.et, e.side, e.price, e.qty, e.order_id, e.ts_ns) for k, e in enumerate(rows, 1)]


def _flags_by_force(kind, rows, p):
    events = _placed(rows)
    return {
        "QuoteStuff": lambda: brute.quote_stuff(events, p["size"], p["ratio"]),
        "Spoof": lambda: brute.spoof(events, p["large"], p["within"]),
        "PhantomLiquidity": lambda: brute.phantom(events, p["span"], p["least_qty"]),
        "CancellationStorm": lambda: brute.storm(events, *(p[k] for k in ("span", "least", "warmup", "floor", "sigmas", "row", "cooldown"))),
        "MomentumIgnition": lambda: brute.ignition(events, *(p[k] for k in ("span", "least_bps", "trades", "run_length", "cooldown"))),
        "FlashCrash": lambda: brute.crash(events, *(p[k] for k in ("gap_bps", "within", "band", "drop", "trades", "cooldown"))),
        "LatencyArbitrage": lambda: brute.reaction(events, *(p[k] for k in ("span", "band", "large", "burst", "cooldown"))),
    }[kind]()


QUERY_OF = {
    "PhantomLiquidity": "phantom_flags", "CancellationStorm": "cancel_storm_flags", "MomentumIgnition": "ignition_flags",
    "FlashCrash": "flash_crash_flags", "LatencyArbitrage": "latency_reaction_flags",
}


@pytest.fixture(scope="module")
def forced(spark):
    """Flags of all kinds and instruments by brute force: kind -> sorted (instrument, emit_seq, start, end, severity, count)."""
    out = {kind: [] for kind in KINDS}
    for instrument, rows in _streams(spark, from_events).items():
        for kind in KINDS:
            found = _flags_by_force(kind, rows, SCALED[kind])
            out[kind] += [(instrument, rows[end - 1].seq, start, end, round(severity, 9), n) for start, end, severity, n in found]
    return {kind: sorted(flags) for kind, flags in out.items()}


def _comparable(rows):
    return sorted((r.instrument_id, r.emit_seq, r.start_seq, r.end_seq, round(r.severity, 9), r.event_count) for r in rows)


@pytest.mark.parametrize("kind", QUERY_OF)
def test_flags_match_brute_force(spark, forced, kind):
    got = _comparable(QUERIES[QUERY_OF[kind]](spark, SF).collect())
    assert got == forced[kind] and (got or kind == "CancellationStorm")


def test_chain_flags_match_brute_force(spark, forced):
    rows = QUERIES["chain_flags"](spark, SF).collect()
    for kind in KINDS:
        assert _comparable(r for r in rows if r.kind == kind) == forced[kind], kind
    assert all(r.detector_ord == KINDS.index(r.kind) for r in rows)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("seed", [1, 2])
def test_detectors_match_brute_force_on_busy_streams(kind, seed):
    """Streams dense enough for every kind to flag; parameters as in the queries, but for the storm's."""
    p = SCALED[kind] | ({"span": 40, "least": 10, "warmup": 60} if kind == "CancellationStorm" else {})
    rows = [Row(**dict(zip(EVENT_COLUMNS, e))) for e in scenarios.market(500, seed, "bursty" if kind != "FlashCrash" else "realistic", mid=300)]
    if kind in ("CancellationStorm", "QuoteStuff"):
        rows += [Row(**dict(zip(EVENT_COLUMNS, (501 + k, 1, 2 + 2 * (k % 19 == 0), 0, 290, 1, 10**6 + k, 501_000 + k)))) for k in range(60)]
    got = [f[4:6] + (round(f[8], 9), f[10]) for f in replay(map(tuple, rows), Chain({kind: p}, (kind,)))]
    want = [(a, b, round(s, 9), n) for a, b, s, n in _flags_by_force(kind, rows, p)]
    assert got == want and want


def test_chain_counts_match_the_chain(spark):
    counts = {}
    for instrument, rows in _streams(spark, from_lineitem).items():
        for f in replay(map(tuple, rows), Chain()):
            counts[instrument, f[3]] = counts.get((instrument, f[3]), 0) + 1
    assert {(r.instrument_id, r.kind): r.n for r in QUERIES["chain_counts"](spark, SF).collect()} == counts


def test_chain_episodes_match_brute_force(spark):
    """Flags in order of their start; each joins the episode before it or begins one."""
    flags = {}
    for r in sorted(QUERIES["chain_flags"](spark, SF).collect(), key=lambda r: (r.start_seq, r.emit_seq, r.detector_ord)):
        flags.setdefault(r.instrument_id, []).append(r)
    want = []
    for instrument, rows in flags.items():
        groups = []
        for r in rows:
            last = groups[-1] if groups else []
            pair = bool(last) and {r.kind, last[0].kind} == {"FlashCrash", "MomentumIgnition"}
            same = bool(last) and r.kind == last[0].kind and r.initiator is not None and r.initiator == last[0].initiator
            if (pair or same) and r.start_seq <= max(x.end_seq for x in last) + 100:
                last.append(r)
            else:
                groups.append([r])
        for n, g in enumerate(groups, 1):
            peak = max(x.severity for x in g)
            want.append((instrument, n, g[0].kind, g[0].start_seq, max(x.end_seq for x in g), len(g), pytest.approx(peak * (1 + math.log(len(g))))))
    got = sorted((r.instrument_id, r.episode, r.kind, r.start_seq, r.end_seq, r.n_flags, r.composite_severity) for r in QUERIES["chain_episodes"](spark, SF).collect())
    assert got == sorted(want, key=lambda w: w[:2])


def test_book_hashes_match_plain_levels(spark):
    """The hash of levels summed from orders alive, in plain Python."""
    want = {}
    for instrument, rows in _streams(spark, from_lineitem).items():
        alive = {}
        for e in rows:
            if e.et == 1:
                alive[e.order_id] = [e.side, e.price, e.qty]
            elif e.order_id in alive:
                alive[e.order_id][2] -= e.qty or alive[e.order_id][2]
        levels = {}
        for side, price, qty in alive.values():
            if qty > 0:
                levels[side, price] = levels.get((side, price), 0) + qty
        h = xxhash.xxh3_64_intdigest(b"L2-v1")
        for side in (0, 1):
            h = xxhash.xxh3_64_intdigest(b"|", h) if side else h
            for price in sorted((p for s, p in levels if s == side), reverse=side == 0):
                h ^= xxhash.xxh3_64_intdigest(price.to_bytes(8, "little") + levels[side, price].to_bytes(8, "little"), h)
        want[instrument] = (f"{h:016x}", len(levels))
    assert {r.instrument_id: (r.l2_hash, r.n_levels) for r in QUERIES["book_hashes"](spark, SF).collect()} == want


def test_state_hashes_match_plain_chains(spark):
    want = []
    for instrument, rows in _streams(spark, from_events).items():
        h, last = 0, None
        for e in rows:
            record = b"".join(x.to_bytes(8, "little") for x in (e.ts_ns, e.price, e.qty, e.order_id)) + instrument.to_bytes(4, "little") + bytes([e.et, e.side, 0, 0])
            h = xxhash.xxh3_64_intdigest(h.to_bytes(8, "little") + e.seq.to_bytes(8, "little") + record)
            want.append((instrument, e.seq, f"{h:016x}", last is not None and e.seq != last + 1))
            last = e.seq
    assert sorted(map(tuple, QUERIES["state_hashes"](spark, SF).collect())) == sorted(want)


def test_gap_statistics_match_brute_force(spark):
    from bookloom.plans.catalogue import _packets

    channels = {}
    for r in sorted(_packets(spark, SF).collect(), key=lambda r: (r.instrument_id, r.arrival)):
        channels.setdefault(r.instrument_id, []).append(r.seq)
    want = []
    for channel, seqs in channels.items():
        n = dict.fromkeys(("delivered", "duplicates", "buffered", "overflow", "opened", "closed"), 0)
        have, waiting = set(), set()
        for x in seqs:
            due = max(have, default=0) + 1
            if x < due:
                n["duplicates"] += 1
            elif x > due:
                n["opened"] += not waiting
                full = len(waiting) >= 2
                n["overflow" if full else "duplicates" if x in waiting else "buffered"] += 1
                waiting |= set() if full else {x}
            else:
                run = [x]
                while run[-1] + 1 in waiting:
                    run.append(run[-1] + 1)
                n["closed"] += len(run) > 1 and len(waiting) >= len(run)
                have |= set(run)
                waiting -= set(run)
        n["delivered"] = len(have)
        gap = (max(have, default=0) + 1, min(waiting) - 1) if waiting else (None, None)
        want.append((channel, *n.values(), *gap))
    got = sorted(map(tuple, QUERIES["gap_statistics"](spark, SF).collect()))
    assert got == sorted(want) and any(w[4] for w in want)


def test_every_query_is_tested():
    by_force = {*QUERY_OF.values(), "chain_flags", "chain_counts", "chain_episodes", "book_hashes", "state_hashes", "gap_statistics"}
    assert set(QUERIES) == set(ORACLE_SQL) | by_force
