"""Queries on books, flow, detectors and risk over the test markets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookloom.functions import scalars
from bookloom.operators import ladder, sequential, telemetry, windows
from bookloom.operators.book import final_books, top_of_book
from bookloom.operators.detectors import chain
from bookloom.plans.registry import query
from bookloom.schema import EVENT_LABELS, SIDE_LABELS, label
from bookloom.sources.itch import encode, project_fixed
from bookloom.sources.testmarket import P2_SQL, P3_SQL, from_events, from_events_modified, from_lineitem

_RESIDUALS = """
rd as (select a.instrument_id, a.order_id, a.seq, a.side, a.price, a.qty as added,
    a.qty - coalesce(sum(case when c.et = 2 and c.qty = 0 then a.qty else c.qty end), 0) as raw
    from p1 a left join p1 c on c.instrument_id = a.instrument_id and c.order_id = a.order_id and c.et in (2, 4) and c.seq > a.seq
    where a.et = 1 group by a.instrument_id, a.order_id, a.seq, a.side, a.price, a.qty),
rs as (select instrument_id, order_id, side, price, added, cast(greatest(raw, 0) as bigint) as rest from rd),
ld as (select instrument_id, side, price, cast(sum(rest) as bigint) as total_qty, count(*) as order_count
    from rs where rest > 0 group by all)"""
_LADDER = f"with {_RESIDUALS} select instrument_id, side, price, total_qty, order_count from ld"


@query(_LADDER)
def final_ladder(spark, sf_dir):
    return ladder.final_ladder(from_events(spark, sf_dir))


@query(_LADDER, P2_SQL)
def final_ladder_li(spark, sf_dir):
    return ladder.final_ladder(from_lineitem(spark, sf_dir))


@query(_LADDER, P2_SQL)
def final_book_fold_li(spark, sf_dir):
    """The same ladder from the state machine instead of the closed form."""
    return final_books(from_lineitem(spark, sf_dir)).drop("l2_hash")


@query(f"with {_RESIDUALS} select instrument_id, order_id, side, price, added, rest from rs")
def order_residuals(spark, sf_dir):
    return ladder.order_residuals(from_events(spark, sf_dir))


#: Orders first, each by itself; what they do to levels ("add", "cut", or "hit" by an anonymous trade); then each level by itself.
_LEVEL_FOLD = """
e as (select instrument_id, order_id, seq, et, side, price, qty,
    row_number() over (partition by instrument_id, order_id order by seq) as k from p1 where et between 1 and 4 and order_id <> 0),
o as (select instrument_id, order_id, 0::bigint as k, 0::bigint as seq, false as alive, 0 as os, 0::bigint as op, 0::bigint as oq,
        0::bigint as cut, false as leaves, false as cuts, 0 as cs, 0::bigint as cp, false as adds, 0 as es, 0::bigint as ep, 0::bigint as eq
    from e where k = 1
    union all select e.instrument_id, e.order_id, e.k, e.seq, e.et in (1, 3) or (o.alive and not x.gone),
        case when e.et in (1, 3) then e.side else o.os end, case when e.et in (1, 3) then e.price else o.op end,
        case when e.et in (1, 3) then e.qty else o.oq - x.cut end,
        x.cut, x.gone, o.alive and e.et in (2, 3, 4), o.os, o.op, e.et in (1, 3), e.side, e.price, e.qty
    from o join e on e.instrument_id = o.instrument_id and e.order_id = o.order_id and e.k = o.k + 1,
        lateral (select case when e.et <> 4 and e.qty = 0 then o.oq else least(e.qty, o.oq) end as cut,
            (e.et <> 4 and e.qty = 0) or e.qty >= o.oq as gone) x),
ops as (select instrument_id, cs as side, cp as price, seq, 1 as part, 'cut' as op, cut as qty, leaves from o where cuts
    union all select instrument_id, es, ep, seq, 2, 'add', eq, false from o where adds
    union all select instrument_id, side, price, seq, 1, case et when 4 then 'hit' else 'cut' end, qty, true from p1 where order_id = 0 and et in (2, 3, 4)
    union all select instrument_id, side, price, seq, 2, 'add', qty, false from p1 where order_id = 0 and et in (1, 3)),
n as (select *, row_number() over (partition by instrument_id, side, price order by seq, part) as k from ops),
l as (select instrument_id, side, price, 0::bigint as k, 0::bigint as q, 0::bigint as c from n where k = 1
    union all select n.instrument_id, n.side, n.price, n.k,
        case when n.op = 'add' then (case when l.c > 0 then l.q else 0 end) + n.qty else greatest(l.q - n.qty, 0) end,
        case when n.op = 'add' then l.c + 1 when l.c = 0 then 0 when n.op = 'hit' then l.c - (l.q <= n.qty)::bigint else l.c - n.leaves::bigint end
    from l join n on n.instrument_id = l.instrument_id and n.side = l.side and n.price = l.price and n.k = l.k + 1)"""


@query(f"""with {_LEVEL_FOLD} select instrument_id, side, price, arg_max(q, k)::bigint as total_qty, arg_max(c, k)::bigint as order_count
    from l group by all having arg_max(c, k) > 0""", P3_SQL)
def final_book_modified(spark, sf_dir):
    """Modifies, anonymous orders and ids used again: only the state machine can tell the book."""
    return final_books(from_events_modified(spark, sf_dir)).drop("l2_hash")


_DELTAS = """
da as (select instrument_id, order_id, seq as add_seq, side, price, qty as added from p1 where et = 1),
dx as (select e.instrument_id, e.order_id, e.seq, e.et, a.side, a.price, a.added,
    sum(case when e.et = 2 and e.qty = 0 then a.added when e.et in (2, 4) then e.qty else 0 end)
        over (partition by e.instrument_id, e.order_id order by e.seq) as taken
    from p1 e join da a on a.instrument_id = e.instrument_id and a.order_id = e.order_id and e.seq >= a.add_seq where e.et in (1, 2, 4)),
dy as (select *, greatest(added - taken, 0) as rest,
    coalesce(lag(greatest(added - taken, 0)) over (partition by instrument_id, order_id order by seq), 0) as before from dx),
dl as (select instrument_id, seq, side, price, cast(rest - before as bigint) as d_qty,
    cast((rest > 0)::int - (before > 0)::int as int) as d_count from dy where rest <> before)"""


@query(f"with {_DELTAS} select * from dl")
def level_delta_stream(spark, sf_dir):
    return ladder.level_deltas(from_events(spark, sf_dir))


@query(f"""with {_RESIDUALS},
    rk as (select *, row_number() over (partition by instrument_id, side order by case side when 0 then -price else price end) as lvl from ld)
    select instrument_id, side, lvl::int as lvl, price, total_qty, order_count from rk where lvl <= 5""")
def depth_top_n(spark, sf_dir):
    top = ladder.ranked(ladder.final_ladder(from_events(spark, sf_dir))).filter("lvl <= 5")
    return top.select("instrument_id", "side", "lvl", "price", "total_qty", "order_count")


@query(f"""with {_RESIDUALS},
    rk as (select *, row_number() over (partition by instrument_id, side order by case side when 0 then -price else price end) as lvl from ld),
    t as (select instrument_id, coalesce(sum(case when side = 0 then total_qty end), 0)::bigint as bid_depth,
        coalesce(sum(case when side = 1 then total_qty end), 0)::bigint as ask_depth,
        count(*) filter (side = 0) as bid_levels, count(*) filter (side = 1) as ask_levels from rk where lvl <= 10 group by instrument_id)
    select *, case when bid_depth + ask_depth = 0 then 0.0 else (bid_depth - ask_depth) / (bid_depth + ask_depth) end::double as imbalance from t""")
def imbalance_top10(spark, sf_dir):
    return ladder.depth_top(ladder.final_ladder(from_events(spark, sf_dir)), 10)


@query(f"""with {_RESIDUALS},
    t as (select instrument_id, max(price) filter (side = 0) as bid, arg_max(total_qty, price) filter (side = 0) as bid_size,
        min(price) filter (side = 1) as ask, arg_min(total_qty, price) filter (side = 1) as ask_size from ld group by instrument_id)
    select *, case when ask > bid then ask - bid end as spread, case when ask > bid then (bid + ask) // 2 end as mid,
        case when ask > bid then ((bid::hugeint * ask_size + ask::hugeint * bid_size) // (bid_size + ask_size))::bigint end as microprice from t""")
def microprice_final(spark, sf_dir):
    return ladder.best_quotes(ladder.final_ladder(from_events(spark, sf_dir)))


#: Tops at chosen sequences: the levels alive there, by sums of all deltas up to each.
_TOPS = f"""{_DELTAS},
    lv as (select s.instrument_id, s.seq, d.side, d.price, sum(d.d_qty) as q from sm s
        join dl d on d.instrument_id = s.instrument_id and d.seq <= s.at group by all having sum(d.d_qty) > 0),
    tp as (select s.instrument_id, s.seq, max(price) filter (side = 0) as bid, min(price) filter (side = 1) as ask,
        arg_max(q, price) filter (side = 0)::bigint as bid_size, arg_min(q, price) filter (side = 1)::bigint as ask_size
        from sm s left join lv on lv.instrument_id = s.instrument_id and lv.seq = s.seq group by all)"""
_ISEQ = "iq as (select *, row_number() over (partition by instrument_id order by seq) as iseq from p1)"


_EVERY = "sm as (select instrument_id, seq, seq as at from p1)"


@query(f"""with {_EVERY}, {_TOPS}
    select instrument_id, seq, bid, ask, coalesce(bid_size, 0) as bid_size, coalesce(ask_size, 0) as ask_size from tp""")
def top_of_book_every_event(spark, sf_dir):
    tops = top_of_book(from_events(spark, sf_dir), depth=0)
    return tops.select("instrument_id", "seq", "bid", "ask", "bid_size", "ask_size")


@query(f"""with {_EVERY}, {_TOPS}, s as (select instrument_id, seq, ask - bid as spread from tp where ask > bid),
    w as (select *, sum(spread) over f as s, count(*) over f as n from s window f as (partition by instrument_id order by seq rows 255 preceding))
    select instrument_id, seq, spread, s / n as mean_spread, (spread * n) / s as blowout from w""")
def spread_rolling(spark, sf_dir):
    """After every event, over the last 256 two-sided ones."""
    return windows.rolling_spread(top_of_book(from_events(spark, sf_dir), depth=0), 256)


@query(f"""with sm as (select instrument_id, seq, seq - 1 as at from p1 where et = 4), {_TOPS}
    select p1.instrument_id, p1.seq, p1.price, p1.qty, case when coalesce(ask <= bid, true) then 0 when p1.price >= ask then 1
        when p1.price <= bid then -1 else 0 end::int as aggressor,
        case when p1.price > 0 then p1.price else case when p1.side = 1 then ask else bid end end as print_price
    from p1 join tp on p1.instrument_id = tp.instrument_id and p1.seq = tp.seq""")
def lee_ready_trades(spark, sf_dir):
    tops = top_of_book(from_events(spark, sf_dir), depth=0, trades_only=True)
    price, bid, ask = F.col("price"), F.col("pre_bid"), F.col("pre_ask")
    return tops.select(
        "instrument_id", "seq", "price", "qty", scalars.aggressor(price, bid, ask).alias("aggressor"),
        scalars.repaired_price(price, F.col("side"), bid, ask).alias("print_price"),
    )


@query("""with g as (select instrument_id, seq, lag(seq) over (partition by instrument_id order by seq) as before from p1)
    select instrument_id, before + 1 as gap_start, seq - 1 as gap_end, seq - before - 1 as missing from g where seq > before + 1""")
def gap_report(spark, sf_dir):
    return windows.gap_report(from_events(spark, sf_dir))


@query("""with g as (select instrument_id, seq, lag(seq) over (partition by instrument_id order by seq) as before from p1),
    f as (select instrument_id, min(seq) filter (seq <> before + 1) as stop from g group by instrument_id)
    select p1.instrument_id, p1.seq, et, price, qty from p1 join f using (instrument_id) where stop is null or p1.seq < stop""")
def strict_prefix(spark, sf_dir):
    return windows.before_first_gap(from_events(spark, sf_dir)).select("instrument_id", "seq", "et", "price", "qty")


def _packets(spark, sf_dir):
    """Numbered messages of each instrument in a shuffled order of arrival, some twice."""
    own = windows.with_iseq(from_events(spark, sf_dir)).select("instrument_id", F.col("iseq").alias("seq"), F.col("seq").alias("g"))
    once = own.select("instrument_id", "seq", (F.col("seq") * 10 + (F.col("g") * 7919) % 97).alias("arrival"))
    twice = own.filter("seq % 13 = 0").select("instrument_id", "seq", (F.col("seq") * 10 + 500).alias("arrival"))
    return once.unionByName(twice)


@query(f"""with {_ISEQ}, pk as (select instrument_id, iseq as seq, iseq * 10 + (seq * 7919) % 97 as arrival from iq
        union all select instrument_id, iseq, iseq * 10 + 500 from iq where iseq % 13 = 0),
    f as (select instrument_id, seq, min(arrival) as arrival, count(*) - 1 as duplicates from pk group by all)
    select instrument_id, seq, arrival, duplicates, max(arrival) over w as delivered_at, max(arrival) over w = arrival as in_order,
        seq - min(seq) over (partition by instrument_id) + 1 = row_number() over w as contiguous
    from f window w as (partition by instrument_id order by seq)""")
def sequencer_delivery(spark, sf_dir):
    return windows.delivery(_packets(spark, sf_dir))


@query("""with w as (select instrument_id, seq, first(seq) over f as start_seq, count(*) over f as n_events,
        count(*) filter (et = 2) over f as cancels, count(*) filter (et = 4) over f as trades
        from p1 where et in (1, 2, 4) window f as (partition by instrument_id order by seq rows 47 preceding)),
    r as (select *, cancels / greatest(trades, 1) as r from w)
    select instrument_id, seq, start_seq, n_events, cancels, trades, least(r / 2.0 / 2.0, 1.0)::double as severity from r where r >= 2.0 and n_events >= 24""")
def quote_stuff_flags(spark, sf_dir):
    return windows.quote_stuff(from_events(spark, sf_dir), 48, 2.0)


_SPOOF = f"""{_ISEQ}, sa as (select instrument_id, order_id, iseq, qty from iq where et = 1 and qty >= 100),
    sc as (select instrument_id, order_id, min(iseq) as iseq from iq where et = 2 group by all),
    sp as (select sa.instrument_id, sa.order_id, sa.iseq as start_seq, sc.iseq as end_seq, sa.qty, least(sa.qty / 100.0 / 5.0, 1.0)::double as severity
        from sa join sc using (instrument_id, order_id) where sc.iseq > sa.iseq and sc.iseq - sa.iseq <= 64)"""


@query(f"with {_SPOOF} select * from sp")
def spoof_flags(spark, sf_dir):
    return windows.spoof(from_events(spark, sf_dir), 100, 64)


@query(f"""with {_ISEQ}, cr as (select * from iq where et in (1, 2, 4)),
    w as (select instrument_id, iseq, count(*) over f as n_events, count(*) filter (et = 2) over f as cancels
        from cr window f as (partition by instrument_id order by iseq range 256 preceding))
    select * from w where n_events >= 128""")
def cancel_rate_window(spark, sf_dir):
    return windows.cancel_rate(from_events(spark, sf_dir), 256, 128)


_SIGNED = "ts as (select instrument_id, seq, qty, case when seq % 5 = 0 then 0 when side = 1 then 1 else -1 end as sign from p1 where et = 4)"
_VPIN = f"""{_SIGNED}, tn as (select *, row_number() over (partition by instrument_id order by seq) as n from ts),
    vb as (select instrument_id, n, seq, b, s, b + s >= 1000 as closed, (b + s >= 1000)::bigint as k from (select instrument_id, n, seq,
            case sign when 1 then qty when -1 then 0 else qty // 2 end as b, case sign when 1 then 0 when -1 then qty else qty - qty // 2 end as s from tn where n = 1)
        union all select t.instrument_id, t.n, t.seq, x.b, x.s, x.b + x.s >= 1000, v.k + (x.b + x.s >= 1000)::bigint
        from vb v join tn t on t.instrument_id = v.instrument_id and t.n = v.n + 1,
        lateral (select case when v.closed then 0 else v.b end + case t.sign when 1 then t.qty when -1 then 0 else t.qty // 2 end as b,
            case when v.closed then 0 else v.s end + case t.sign when 1 then 0 when -1 then t.qty else t.qty - t.qty // 2 end as s) x)"""


@query(f"""with {_VPIN} select instrument_id, seq, k as bucket, b as buy, s as sell,
        sum(abs(b - s)) over f / (count(*) over f * 1000) as vpin from vb where closed
        window f as (partition by instrument_id order by k rows 49 preceding)""")
def vpin_buckets(spark, sf_dir):
    sign = F.when(F.col("seq") % 5 == 0, 0).when(F.col("side") == 1, 1).otherwise(-1)
    trades = from_events(spark, sf_dir).filter("et = 4").select("seq", "instrument_id", "qty", sign.cast("int").alias("sign"))
    return sequential.vpin(trades, 1000, 50)


_RATES = "rt as (select instrument_id, ts_ns // 1000000000 as second, count(*) as events, count(*) filter (et = 4) as trades, count(*) filter (et = 1) as orders from p1 group by all)"


@query(f"with {_RATES} select *, (orders / greatest(trades, 1))::double as otr from rt")
def event_rate_seconds(spark, sf_dir):
    return windows.event_rates(from_events(spark, sf_dir))


@query("""with rt as (select instrument_id, ts_ns // 3600000000000 as second, count(*) filter (et = 4) as trades from p1 group by all),
    n as (select *, row_number() over (partition by instrument_id order by second) as k from rt),
    r as (select instrument_id, second, trades, k, trades::double as baseline from n where k = 1 union all
        select n.instrument_id, n.second, n.trades, n.k, case when r.baseline = 0 then n.trades::double else r.baseline * 0.875 + n.trades * 0.125 end
        from r join n on n.instrument_id = r.instrument_id and n.k = r.k + 1)
    select instrument_id, second, trades, round(baseline, 6) as baseline,
        round(case when baseline > 0 then trades / baseline else 0 end, 6)::double as velocity from r""")
def velocity_ewma(spark, sf_dir):
    events = from_events(spark, sf_dir).withColumn("ts_ns", F.floor(F.col("ts_ns") / 3600).cast("long"))
    out = sequential.velocity(windows.event_rates(events).select("instrument_id", "second", "trades"))
    return out.select("instrument_id", "second", "trades", F.round("baseline", 6).alias("baseline"), F.round("velocity", 6).alias("velocity"))


@query("""with bk as (select instrument_id, ts_ns // 3600000000000 as bucket, count(*) as eps, count(*) filter (et = 1) as adds,
        count(*) filter (et = 2) as cancels, count(*) filter (et = 4) as trades, max(price) - min(price) as width from p1 group by all),
    x as (select *, width / 50.0 as blowout, (adds - cancels) / (adds + cancels + 1.0) as imb, trades / (eps + 0.0) as vpin, trades / 2.0 as vel, cancels / (eps + 0.0) as depl from bk),
    s as (select *, ((case when width > 95 then 0 else greatest(blowout - 1, 0) + 3 * abs(imb) end) + 5 * vpin + 0.6 * abs(vel - 1) + 0.3 * 0.5 + 3 * depl)
        * least(eps / 30.0, 1.0) as score from x)
    select instrument_id, bucket, eps, round(score, 6)::double as score,
        (case when round(score, 6) >= 3 then 3 when round(score, 6) >= 1.5 then 2 when round(score, 6) >= 0.6 then 1 else 0 end)::int as regime from s""")
def regime_by_bucket(spark, sf_dir):
    return _regimes(spark, sf_dir)


def _regimes(spark, sf_dir):
    n = lambda et: F.sum((F.col("et") == et).cast("long"))
    b = from_events(spark, sf_dir).groupBy("instrument_id", F.floor(F.col("ts_ns") / 3_600_000_000_000).cast("long").alias("bucket")).agg(
        F.count(F.lit(1)).alias("eps"), n(1).alias("adds"), n(2).alias("cancels"), n(4).alias("trades"), (F.max("price") - F.min("price")).alias("width")
    )
    score = scalars.regime_score(
        F.col("width") / 50.0, (F.col("adds") - F.col("cancels")) / (F.col("adds") + F.col("cancels") + 1.0), F.col("trades") / F.col("eps"),
        F.col("trades") / 2.0, F.col("cancels") / F.col("eps"), F.lit(0.5), F.col("eps"), F.col("width") > 95,
    )
    b = b.withColumn("score", F.round(score, 6))
    return b.select("instrument_id", "bucket", "eps", "score", scalars.regime_class(F.col("score")).alias("regime"))


@query(f"""with {_ISEQ}, t as (select instrument_id, iseq as seq, (price * 7 + qty) % 4 as regime,
        case when et = 2 then 1 else 0 end as n_flags, case when et = 2 then (qty % 10) / 10.0 else 0 end::double as sev from iq),
    h as (select *, regime >= 2 as high, lag(regime >= 2) over w as was, lag(seq) over w as prev from t window w as (partition by instrument_id order by seq)),
    i as (select *, sum((high and (not coalesce(was, false) or seq - prev > 3))::int) over (partition by instrument_id order by seq) as island from h)
    select instrument_id, min(seq) as start_seq, max(seq) as end_seq, max(regime)::int as regime,
        round(case when sum(n_flags) > 0 then sum(sev) / sum(n_flags) else 0 end, 9)::double as severity, sum(n_flags)::bigint as n_flags
    from i where high group by instrument_id, island""")
def stress_windows(spark, sf_dir):
    rows = windows.with_iseq(from_events(spark, sf_dir))
    cancel = F.col("et") == 2
    tagged = rows.select(
        "instrument_id", F.col("iseq").alias("seq"), ((F.col("price") * 7 + F.col("qty")) % 4).cast("int").alias("regime"),
        F.when(cancel, 1).otherwise(0).alias("n_flags"), F.when(cancel, (F.col("qty") % 10) / 10.0).otherwise(0.0).alias("severity_sum"),
    )
    return windows.stress_windows(tagged, 2, 3).withColumn("severity", F.round("severity", 9))


@query(f"""with {_SPOOF}, n as (select *, row_number() over (partition by instrument_id order by start_seq) as k from sp),
    r as (select instrument_id, k, order_id, end_seq, 1 as ep from n where k = 1 union all
        select n.instrument_id, n.k, case when j.m then r.order_id else n.order_id end, case when j.m then greatest(r.end_seq, n.end_seq) else n.end_seq end, r.ep + (not j.m)::int
        from r join n on n.instrument_id = r.instrument_id and n.k = r.k + 1, lateral (select n.start_seq <= r.end_seq + 500 and n.order_id // 32 = r.order_id // 32 as m) j)
    select n.instrument_id, ep::bigint as episode, min(n.start_seq) as start_seq, max(n.end_seq) as end_seq, count(*) as n_flags,
        max(severity) as peak_severity, round(max(severity) * (1 + ln(count(*))), 9) as composite_severity
    from r join n on n.instrument_id = r.instrument_id and n.k = r.k group by n.instrument_id, ep""")
def spoof_episodes(spark, sf_dir):
    """Spoofs by initiators of one block of 32 order ids, within 500 events of each other."""
    s = windows.spoof(from_events(spark, sf_dir), 100, 64)
    flags = s.select(
        "instrument_id", "start_seq", "end_seq", F.lit(0).cast("long").alias("start_ts_ns"), F.lit(0).cast("long").alias("end_ts_ns"), F.lit("Spoof").alias("kind"),
        F.floor(F.col("order_id") / 32).cast("long").alias("initiator"), "severity", F.col("end_seq").alias("emit_seq"), F.lit(1).alias("detector_ord"),
    )
    out = sequential.episodes(flags, 500)
    return out.select("instrument_id", "episode", "start_seq", "end_seq", "n_flags", "peak_severity", F.round("composite_severity", 9).alias("composite_severity"))


@query("""with t as (select instrument_id, seq, row_number() over (partition by instrument_id order by seq) as n from p1 where et = 4),
    l as (select instrument_id, seq from t where n = 5 order by seq limit 1)
    select p1.instrument_id, p1.seq, p1.et, p1.price, row_number() over (order by p1.seq) as eseq from p1 join l on p1.instrument_id = l.instrument_id and p1.seq >= l.seq""")
def auto_lock_events(spark, sf_dir):
    return windows.auto_lock(from_events(spark, sf_dir), 5).select("instrument_id", "seq", "et", "price", "eseq")


@query("""select instrument_id, ts_ns // 600000000000 as bucket, max(seq) as seq, arg_max(et, seq) as et, arg_max(side, seq) as side,
    arg_max(price, seq) as price, arg_max(qty, seq) as qty, count(*) as n_events from p1 group by all""")
def tick_samples(spark, sf_dir):
    return windows.tick_samples(from_events(spark, sf_dir), 600_000_000_000)


@query("""with w as (select instrument_id, seq, list_sort(list(qty) over (partition by instrument_id order by seq rows 63 preceding)) as v from p1)
    select instrument_id, seq, v[cast(floor((len(v) - 1) * 0.5 + 0.5) as int) + 1] as p50, v[cast(floor((len(v) - 1) * 0.99 + 0.5) as int) + 1] as p99,
        v[cast(floor((len(v) - 1) * 0.999 + 0.5) as int) + 1] as p999, v[-1] as most from w""")
def stage_percentiles(spark, sf_dir):
    return windows.rolling_quantiles(from_events(spark, sf_dir), "qty", 64)


@query("""with lx as (select instrument_id, (qty * 37 + price) as ns from p1),
    lp as (select *, case when ns > 0 then least(length(bin(ns)) - 1, 23) else 0 end as e from lx),
    lb as (select instrument_id, case when ns <= 0 then 0 else least(e * 8 + ((ns - (1::bigint << e)) * 8) // (1::bigint << e), 191) end::int as bin from lp)
    select instrument_id, bin, count(*) as n from lb group by all""")
def latency_histogram(spark, sf_dir):
    rows = from_events(spark, sf_dir).select("instrument_id", scalars.latency_bin(F.col("qty") * 37 + F.col("price")).alias("bin"))
    return rows.groupBy("instrument_id", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("""select instrument_id, seq, sum(case when side = 0 then qty else -qty end) over w::bigint as position,
    sum(case when side = 0 then -qty else qty end * price) over w::bigint as cash from p1 where et = 4 window w as (partition by instrument_id order by seq)""")
def positions_cash(spark, sf_dir):
    return windows.positions_cash(from_events(spark, sf_dir).filter("et = 4"))


_LIMITS = sequential.Limits(orders_per_sec=None, position=1500, loss=3_000_000, order_to_trade=8.0, order_to_trade_warmup=20, gaps=None)


@query("""with a as (select instrument_id as desk, seq, case et when 1 then 'intent' when 4 then 'fill' when 5 then 'start_of_day' end as action, side, qty, price,
        row_number() over (partition by instrument_id order by seq) as k from p1 where et in (1, 4) or (et = 5 and seq % 11 = 0)),
    r as (select desk, seq, action, k, null::boolean as allowed, null::varchar as reason, 0::bigint as orders, 0::bigint as trades, 0::bigint as cash, 0::bigint as pos from
            (select desk, 0::bigint as seq, '' as action, 0::bigint as k from a group by desk)
        union all
        select a.desk, a.seq, a.action, a.k, case when a.action = 'intent' then x.reason is null end, case when a.action = 'start_of_day' then null else x.reason end,
            case when a.action = 'start_of_day' then 0 else r.orders + (a.action = 'intent' and x.reason is null)::bigint end,
            case when a.action = 'start_of_day' then 0 else r.trades + (a.action = 'fill')::bigint end,
            case a.action when 'start_of_day' then 0 when 'fill' then r.cash - (case when a.side = 0 then a.qty else -a.qty end) * a.price else r.cash end,
            case a.action when 'start_of_day' then 0 when 'fill' then r.pos + (case when a.side = 0 then a.qty else -a.qty end) else r.pos end
        from r join a on a.desk = r.desk and a.k = r.k + 1, lateral (select case when a.action <> 'intent' or r.reason is not null then r.reason
            when abs(r.pos + case when a.side = 0 then a.qty else -a.qty end) > 1500 then 'PositionCap' when r.cash < -3000000 then 'DailyLossFloor'
            when r.orders >= 20 and r.orders / greatest(r.trades, 1) > 8.0 then 'OrderToTradeRatio' end as reason) x)
    select desk, seq, action, allowed, reason, orders, trades, cash, abs(pos)::bigint as exposure from r where k > 0""")
def risk_decisions(spark, sf_dir):
    action = F.when(F.col("et") == 1, "intent").when(F.col("et") == 4, "fill").otherwise("start_of_day")
    rows = from_events(spark, sf_dir).filter("et in (1, 4) or (et = 5 and seq % 11 = 0)")
    rows = rows.select("seq", F.col("instrument_id").alias("desk"), "ts_ns", action.alias("action"), "instrument_id", "side", "qty", "price")
    return sequential.risk_decisions(rows, _LIMITS)


_ALL_LIMITS = sequential.Limits(
    orders_per_sec=2, position=2500, loss=5_000_000, order_to_trade=4.0, order_to_trade_warmup=20, gaps=4, gap_window_ns=20_000_000_000
)
_GATE = """
a as (select instrument_id as desk, seq, ts_ns // 4000 as ts, case when et = 1 then 'intent' when et = 4 then 'fill' when seq % 11 = 0 then 'start_of_day'
        when seq % 5 = 0 then 'reset' when seq % 7 = 0 then 'manual_halt' else 'gap' end as action, side, qty, price,
        row_number() over (partition by instrument_id order by seq) as k from p1 where et in (1, 4, 5)),
dy as (select *, count(*) filter (action = 'start_of_day') over (partition by desk order by k) as day from a),
g as (select *, count(*) filter (action = 'gap') over (partition by desk, day order by ts range 20000000000 preceding) as n_gaps from dy),
r as (select desk, 0::bigint as seq, '' as action, 0::bigint as k, null::boolean as allowed, null::varchar as reason, 0::bigint as orders,
        0::bigint as trades, 0::bigint as cash, 0::bigint as pos, 2.0::double as tokens, null::bigint as last from g where k = 1
    union all select g.desk, g.seq, g.action, g.k, case when g.action = 'intent' then y.reason is null end, y.reason,
        case when g.action = 'start_of_day' then 0 else r.orders + (g.action = 'intent' and y.reason is null)::bigint end,
        case when g.action = 'start_of_day' then 0 else r.trades + (g.action = 'fill')::bigint end,
        case g.action when 'start_of_day' then 0 when 'fill' then r.cash - w.signed * g.price else r.cash end,
        case g.action when 'start_of_day' then 0 when 'fill' then r.pos + w.signed else r.pos end,
        case when v.checked then v.tokens - (v.tokens >= 1)::int else r.tokens end, case when v.checked then g.ts else r.last end
    from r join g on g.desk = r.desk and g.k = r.k + 1,
        lateral (select case when g.side = 0 then g.qty else -g.qty end as signed) w,
        lateral (select g.action = 'intent' and r.reason is null as checked,
            case when r.last is null then r.tokens else least(r.tokens + (g.ts - r.last) / 1e9 * 2.0, 2.0) end as tokens) v,
        lateral (select case when g.action in ('start_of_day', 'reset') then null when r.reason is not null then r.reason
            when g.action = 'manual_halt' then 'Manual' when g.action = 'gap' then case when g.n_gaps >= 4 then 'FeedGap' end
            when g.action = 'fill' then null when v.tokens < 1 then 'RateLimit' when abs(r.pos + w.signed) > 2500 then 'PositionCap'
            when r.cash < -5000000 then 'DailyLossFloor' when r.orders >= 20 and r.orders / greatest(r.trades, 1) > 4.0 then 'OrderToTradeRatio' end as reason) y)"""


def _actions(spark, sf_dir):
    seq = F.col("seq")
    control = F.when(seq % 11 == 0, "start_of_day").when(seq % 5 == 0, "reset").when(seq % 7 == 0, "manual_halt").otherwise("gap")
    action = F.when(F.col("et") == 1, "intent").when(F.col("et") == 4, "fill").otherwise(control)
    rows = from_events(spark, sf_dir).filter("et in (1, 4, 5)").withColumn("ts_ns", F.floor(F.col("ts_ns") / 4000).cast("long"))
    return rows.select("seq", F.col("instrument_id").alias("desk"), "ts_ns", action.alias("action"), "instrument_id", "side", "qty", "price")


@query(f"with {_GATE} select desk, seq, action, allowed, reason, orders, trades, cash, abs(pos)::bigint as exposure from r where k > 0")
def risk_gate_all_checks(spark, sf_dir):
    """Every check and every action; event time runs 4000 times as fast as the stream's."""
    return sequential.risk_decisions(_actions(spark, sf_dir), _ALL_LIMITS)


@query(f"""with {_GATE}, f as (select r.*, ts // 60000000000 as bucket from r join a on a.desk = r.desk and a.k = r.k)
    select desk, bucket, max(seq) as seq, arg_max(struct_pack(r := reason), seq).r as reason, arg_max(orders, seq) as orders, arg_max(trades, seq) as trades,
        arg_max(cash, seq) as cash, arg_max(abs(pos)::bigint, seq) as exposure, (arg_max(orders, seq) / greatest(arg_max(trades, seq), 1))::double as order_to_trade,
        count(*) filter (not allowed) as blocked from f group by desk, bucket""")
def risk_frames(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    return telemetry.risk_frames(sequential.risk_decisions(actions, _ALL_LIMITS), actions, 60_000_000_000)


@query()
def gap_statistics(spark, sf_dir):
    """Of messages that arrive out of order and twice; no buffer of its size fits in SQL."""
    return sequential.gap_stats(_packets(spark, sf_dir).withColumnRenamed("instrument_id", "channel"), capacity=2)


@query("""with l as (select instrument_id, case et when 1 then 'add' when 2 then 'cancel' when 3 then 'modify' when 4 then 'trade' when 5 then 'snapshot' end as event,
        case side when 0 then 'bid' when 1 then 'ask' end as side_name, qty from p1)
    select instrument_id, event, side_name, count(*) as n, sum(qty)::bigint as qty from l group by all""")
def event_mix(spark, sf_dir):
    rows = from_events(spark, sf_dir).select("instrument_id", label(F.col("et"), EVENT_LABELS).alias("event"), label(F.col("side"), SIDE_LABELS).alias("side_name"), "qty")
    return rows.groupBy("instrument_id", "event", "side_name").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").cast("long").alias("qty"))


@query("""with s as (select cast(s_suppkey % 16 as int) as instrument_id, min(s_name) as symbol from supplier group by all)
    select p1.instrument_id, trim(symbol) as symbol, count(*) as n_events, sum(qty)::bigint as qty from p1 left join s on s.instrument_id = p1.instrument_id group by all""", P2_SQL)
def events_by_symbol(spark, sf_dir):
    """The symbol directory has a row for each of 16 instruments, so it is broadcast."""
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy((F.col("s_suppkey") % 16).cast("int").alias("instrument_id")).agg(F.min("s_name").alias("symbol"))
    counts = from_lineitem(spark, sf_dir).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("qty").cast("long").alias("qty"))
    return counts.join(F.broadcast(names), "instrument_id", "left").select("instrument_id", F.trim("symbol").alias("symbol"), "n_events", "qty")


@query("""with t as (select *, row_number() over (partition by instrument_id order by seq desc) as k from p1 where et = 4)
    select instrument_id, seq, price, qty, k::int as back from t where k <= 128""")
def latest_trades(spark, sf_dir):
    back = F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("seq")))
    return from_events(spark, sf_dir).filter("et = 4").select("instrument_id", "seq", "price", "qty", back.alias("back")).filter("back <= 128")


@query("""with h as (select instrument_id, ts_ns // 60000000000 as minute, avg(price)::double as p, count(*) as n from p1 where et = 4 group by all),
    m as (select *, lag(p) over (partition by instrument_id order by minute) as before from h)
    select instrument_id, minute, n, round(coalesce(abs(p - before) / before * 10000, 0), 6) as drift_bps from m""")
def trade_drift(spark, sf_dir):
    bars = from_events(spark, sf_dir).filter("et = 4").groupBy("instrument_id", F.floor(F.col("ts_ns") / 60_000_000_000).cast("long").alias("minute"))
    bars = bars.agg(F.avg("price").alias("p"), F.count(F.lit(1)).alias("n"))
    before = F.lag("p").over(Window.partitionBy("instrument_id").orderBy("minute"))
    return bars.select("instrument_id", "minute", "n", F.round(F.coalesce(F.abs(F.col("p") - before) / before * 10000, F.lit(0.0)), 6).alias("drift_bps"))


#: Detector parameters scaled to the test streams, so that each kind can occur.
SCALED = {
    "QuoteStuff": {"size": 48, "ratio": 2.0},
    "Spoof": {"large": 100, "within": 64},
    "PhantomLiquidity": {"span": 64, "time_ns": 0, "least_qty": 10},
    "CancellationStorm": {"span": 128, "least": 32, "warmup": 128, "floor": 0.01, "sigmas": 1.5, "row": 3, "cooldown": 64},
    "MomentumIgnition": {"span": 256, "least_bps": 1, "trades": 2, "run_length": 3, "cooldown": 32},
    "FlashCrash": {"gap_bps": 1, "within": 8, "band": 20, "drop": 0.05, "trades": 1, "cooldown": 32},
    "LatencyArbitrage": {"span": 64, "band": 60, "large": 20, "burst": 2, "cooldown": 16},
}


def _flags(spark, sf_dir, kind: str):
    return chain(from_events(spark, sf_dir), SCALED, (kind,))


#: Ledgers of (side, price), each by itself: adds, the first cancel of each order, and trades there.
@query(f"""with {_ISEQ},
    ad as (select instrument_id, order_id, side, price, iseq from iq where et = 1),
    cn as (select c.instrument_id, a.side, a.price, c.iseq, c.seq, c.ts_ns, c.et, c.qty, row_number() over (partition by c.instrument_id, c.order_id order by c.seq) as nth
        from iq c join ad a on a.instrument_id = c.instrument_id and a.order_id = c.order_id and a.iseq < c.iseq where c.et = 2),
    ev as (select instrument_id, side, price, iseq, seq, ts_ns, et, qty from iq where et in (1, 4) union all
        select instrument_id, side, price, iseq, seq, ts_ns, et, qty from cn where nth = 1),
    n as (select *, row_number() over (partition by instrument_id, side, price order by iseq) as k from ev),
    r as (select instrument_id, side, price, 0::bigint as k, 0::bigint as iseq, 0::bigint as seq, 0::bigint as ts, false as closes, 0::bigint as start, 0::bigint as start_ts,
            0::bigint as added, 0::bigint as gone, 0::bigint as adds, 0::bigint as cancels, false as here from n where k = 1
        union all select n.instrument_id, n.side, n.price, n.k, n.iseq, n.seq, n.ts_ns, x.closes, x.start, x.start_ts, x.added, x.gone, x.adds, x.cancels,
            case n.et when 1 then true when 4 then false else r.here and not x.closes end
        from r join n on n.instrument_id = r.instrument_id and n.side = r.side and n.price = r.price and n.k = r.k + 1,
            lateral (select case when n.qty = 0 then greatest(r.added - r.gone, 1) // greatest(r.adds, 1) else n.qty end as share) s,
            lateral (select case when r.here then r.start else n.iseq end as start, case when r.here then r.start_ts else n.ts_ns end as start_ts,
                case when r.here then r.added else 0 end + (n.et = 1)::bigint * n.qty as added, case when r.here then r.gone else 0 end + (n.et = 2)::bigint * s.share as gone,
                case when r.here then r.adds else 0 end + (n.et = 1)::bigint as adds, case when r.here then r.cancels else 0 end + (n.et = 2)::bigint as cancels,
                n.et = 2 and r.here and r.gone + s.share >= r.added and r.cancels + 1 >= r.adds as closes) x)
    select instrument_id, seq as emit_seq, 2 as detector_ord, 'PhantomLiquidity' as kind, start as start_seq, iseq as end_seq, start_ts as start_ts_ns, ts as end_ts_ns,
        (1 - (iseq - start) / 64.0)::double as severity, null::bigint as initiator, adds + cancels as event_count, ts - start_ts as duration_ns,
        null::double as cancel_trade_ratio, 0::bigint as price_displacement, gone as depth_removed from r where closes and added >= 10 and iseq - start <= 64""")
def phantom_flags(spark, sf_dir):
    return _flags(spark, sf_dir, "PhantomLiquidity")


@query(f"""with {_ISEQ}, cr as (select * from iq where et in (1, 2, 4)),
    w as (select instrument_id, iseq, seq, ts_ns, count(*) over f as n, count(*) filter (et = 2) over f as c
        from cr window f as (partition by instrument_id order by iseq range 128 preceding)),
    x as (select *, (c / n)::double as rate, row_number() over (partition by instrument_id order by iseq) as k from w where n >= 32),
    r as (select instrument_id, 0::bigint as k, 0::bigint as seen, 0::double as mean, 0::double as m2, 0 as above, 0::bigint as quiet, 0::bigint as start, 0::bigint as start_ts,
            false as fires, 0::double as z, 0::bigint as iseq, 0::bigint as seq, 0::bigint as ts, 0::bigint as n, 0::double as rate from x where k = 1
        union all select x.instrument_id, x.k, r.seen + y.learns::int, case when y.learns then u.mean else r.mean end,
            case when y.learns then r.m2 + (x.rate - r.mean) * (x.rate - u.mean) else r.m2 end,
            case when not y.high or y.fires then 0 else r.above + 1 end, case when y.fires then x.iseq + 64 else r.quiet end,
            case when y.high and r.above = 0 then x.iseq else r.start end, case when y.high and r.above = 0 then x.ts_ns else r.start_ts end,
            y.fires, greatest((x.rate - r.mean) / d.sigma, 0), x.iseq, x.seq, x.ts_ns, x.n, x.rate
        from r join x on x.instrument_id = r.instrument_id and x.k = r.k + 1,
            lateral (select greatest(case when r.seen > 1 then sqrt(r.m2 / (r.seen - 1)) else 0 end, 0.01)::double as sigma) d,
            lateral (select r.mean + (x.rate - r.mean) / (r.seen + 1) as mean, r.seen >= 128 and x.rate > r.mean + 1.5::double * d.sigma as high) u,
            lateral (select u.high, r.seen < 128 or (not u.high and x.iseq >= r.quiet) as learns, u.high and r.above + 1 >= 3 and x.iseq >= r.quiet as fires) y)
    select instrument_id, seq as emit_seq, 3 as detector_ord, 'CancellationStorm' as kind, start as start_seq, iseq as end_seq, start_ts as start_ts_ns, ts as end_ts_ns,
        round(z / (z + 3), 9)::double as severity, null::bigint as initiator, n as event_count, ts - start_ts as duration_ns,
        round(rate / greatest(1 - rate, 2.220446049250313e-16), 9)::double as cancel_trade_ratio, 0::bigint as price_displacement, 0::bigint as depth_removed from r where fires""")
def cancel_storm_flags(spark, sf_dir):
    out = _flags(spark, sf_dir, "CancellationStorm")
    return out.withColumn("severity", F.round("severity", 9)).withColumn("cancel_trade_ratio", F.round("cancel_trade_ratio", 9))


@query()
def ignition_flags(spark, sf_dir):
    return _flags(spark, sf_dir, "MomentumIgnition")


@query()
def flash_crash_flags(spark, sf_dir):
    return _flags(spark, sf_dir, "FlashCrash")


@query()
def latency_reaction_flags(spark, sf_dir):
    return _flags(spark, sf_dir, "LatencyArbitrage")


@query()
def chain_flags(spark, sf_dir):
    return chain(from_events(spark, sf_dir), SCALED)


@query()
def chain_counts(spark, sf_dir):
    return chain(from_lineitem(spark, sf_dir)).groupBy("instrument_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def chain_episodes(spark, sf_dir):
    return sequential.episodes(chain(from_events(spark, sf_dir), SCALED), 100)


@query()
def book_hashes(spark, sf_dir):
    return final_books(from_lineitem(spark, sf_dir)).groupBy("instrument_id").agg(F.first("l2_hash").alias("l2_hash"), F.count(F.lit(1)).alias("n_levels"))


@query("""select instrument_id, seq, count(qty) over w as n, round(avg(qty) over w, 6) as mean, round(coalesce(var_samp(qty) over w, 0), 4) as variance,
    min(qty) over w as least, max(qty) over w as most from p1 window w as (partition by instrument_id order by seq rows unbounded preceding)""")
def running_stats(spark, sf_dir):
    out = telemetry.running_stats(from_events(spark, sf_dir), "qty")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 4))


@query(f"""with {_ISEQ}, sm as (select instrument_id, max(seq) as seq, max(seq) as at from p1 group by instrument_id, ts_ns // 3600000000000), {_TOPS},
    h as (select tp.instrument_id, p1.ts_ns // 3600000000000 as second, (bid + ask) // 2 as mid from tp join p1 on p1.instrument_id = tp.instrument_id and p1.seq = tp.seq
        where bid is not null and ask is not null),
    b as (select *, lag(mid) over (partition by instrument_id order by second) as before from h)
    select instrument_id, second, mid, round(case when before is null then 0 else abs(mid - before) / mid * 10000 end, 6)::double as drift_bps from b""".replace("b as (select *, lag(mid)", "hb as (select *, lag(mid)").replace("as drift_bps from b", "as drift_bps from hb"))
def mid_drift(spark, sf_dir):
    """Hours stand for seconds: the test stream is sparse."""
    tops = top_of_book(from_events(spark, sf_dir), depth=0).withColumn("ts_ns", F.floor(F.col("ts_ns") / 3600).cast("long"))
    last = Window.partitionBy("instrument_id", F.floor(F.col("ts_ns") / 1_000_000_000)).orderBy(F.desc("seq"))
    return telemetry.mid_drift(tops.withColumn("k", F.row_number().over(last)).filter("k = 1")).withColumn("drift_bps", F.round("drift_bps", 6))


@query("select instrument_id, et, side, price, qty, order_id, ts_ns % 281474976710656 as ts_ns from p1 where et = 1 or (et = 4 and price > 0)")
def itch_round_trip(spark, sf_dir):
    """Events written as capture messages and read back by column expressions."""
    columns = ["et", "instrument_id", "ts_ns", "order_id", "side", "price", "qty"]

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            out = [encode(e[0], e[1], e[2] % (1 << 48), *e[3:]) for e in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["message"])

    rows = from_events(spark, sf_dir).filter("et = 1 or (et = 4 and price > 0)").select(*columns)
    return project_fixed(rows.mapInArrow(write, "message binary"))


_PERIOD = "ts_ns // 3600000000000"
_SIGNED_BY_BOOK = """pt as (select p1.*, tp.bid, tp.ask, tp.bid_size, tp.ask_size, lag(tp.bid) over w as pre_bid, lag(tp.ask) over w as pre_ask
        from p1 join tp using (instrument_id, seq) window w as (partition by instrument_id order by seq)),
    ts as (select instrument_id, seq, qty, case when coalesce(pre_ask <= pre_bid, true) then 0 when price >= pre_ask then 1 when price <= pre_bid then -1 else 0 end as sign
        from pt where et = 4 and qty > 0)"""


@query(f"""with {_EVERY}, {_TOPS}, {_SIGNED_BY_BOOK}, {_VPIN[len(_SIGNED) + 2:]},
    vp as (select instrument_id, seq, sum(abs(b - s)) over f / (count(*) over f * 1000) as vpin from vb where closed
        window f as (partition by instrument_id order by k rows 49 preceding)),
    q as (select *, ask - bid as spread, sum(ask - bid) over f as s, count(*) over f as n from pt where bid < ask
        window f as (partition by instrument_id order by seq rows 31 preceding)),
    fr as (select instrument_id, {_PERIOD} as bucket, arg_max(q, seq) as q, max(seq) as seq from q group by all),
    lr as (select lv.*, row_number() over (partition by lv.instrument_id, lv.seq, side order by case side when 0 then -price else price end) as lvl
        from lv join fr on fr.instrument_id = lv.instrument_id and fr.seq = lv.seq),
    dp as (select instrument_id, seq, sum(q) filter (side = 0)::bigint as bid_depth, sum(q) filter (side = 1)::bigint as ask_depth from lr where lvl <= 10 group by all)
    select fr.instrument_id, bucket, fr.seq, fr.q.ts_ns, (fr.q.bid + fr.q.ask) // 2 as mid, fr.q.spread, fr.q.spread / ((fr.q.bid + fr.q.ask) // 2) * 10000 as spread_bps,
        ((fr.q.bid::hugeint * fr.q.ask_size + fr.q.ask::hugeint * fr.q.bid_size) // (fr.q.bid_size + fr.q.ask_size))::bigint as microprice, bid_depth, ask_depth,
        (bid_depth - ask_depth) / (bid_depth + ask_depth) as imbalance, coalesce(vpin, 0) as vpin, (fr.q.spread * fr.q.n) / fr.q.s as blowout
    from fr join dp on dp.instrument_id = fr.instrument_id and dp.seq = fr.seq
        asof left join vp on vp.instrument_id = fr.instrument_id and vp.seq <= fr.seq""")
def tick_frames(spark, sf_dir):
    return telemetry.ticks(from_events(spark, sf_dir), 3_600_000_000_000, 1000, 50, 32)


@query(f"""with {_DELTAS}, sm as (select instrument_id, {_PERIOD} as bucket, max(seq) as seq from p1 group by all),
    lv as (select s.instrument_id, s.bucket, s.seq, d.side, d.price, sum(d.d_qty)::bigint as qty, sum(d.d_count)::bigint as orders
        from sm s join dl d on d.instrument_id = s.instrument_id and d.seq <= s.seq group by all having sum(d.d_qty) > 0),
    k as (select *, row_number() over (partition by instrument_id, bucket, side order by case side when 0 then -price else price end)::int as lvl from lv)
    select instrument_id, bucket, seq, side, lvl, price, qty, orders from k where lvl <= 10""")
def ladder_frames(spark, sf_dir):
    return telemetry.ladder_rows(telemetry.ladder_frames(from_events(spark, sf_dir), 3_600_000_000_000))


@query()
def state_hashes(spark, sf_dir):
    return telemetry.state_hashes(from_events(spark, sf_dir))
