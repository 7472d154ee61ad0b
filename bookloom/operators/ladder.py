"""Books in closed form: order residuals, level deltas and ladders by windows only.

Valid where order ids are unique, no event modifies and none is anonymous: then an order
is only ever reduced, so its rest is its quantity less all reductions after its add, and
a level is the sum of its orders. Events before their order's add do nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookloom.functions import scalars

_ALL = 1 << 60  # a full cancel takes more than any order holds


def _reduction() -> Column:
    whole = (F.col("et") == 2) & (F.col("qty") == 0)
    return F.when(whole, _ALL).when(F.col("et").isin(2, 4), F.col("qty")).otherwise(0)


def order_residuals(events: DataFrame) -> DataFrame:
    """instrument_id, order_id, side, price, added, rest for every order added."""
    adds = F.min(F.when(F.col("et") == 1, F.struct("seq", "side", "price", "qty")))
    live = events.filter("et in (1, 2, 4) and order_id <> 0")
    # One aggregation by order: reductions are kept by sequence so that those before the add can be told.
    cuts = F.collect_list(F.when(F.col("et") != 1, F.struct("seq", _reduction().alias("cut"))))
    orders = live.groupBy("instrument_id", "order_id").agg(adds.alias("a"), cuts.alias("cuts")).filter("a is not null")
    taken = F.aggregate(
        "cuts", F.lit(0).cast("long"), lambda s, c: F.least(s + F.when(c["seq"] > F.col("a.seq"), c["cut"]).otherwise(0), F.lit(_ALL)).cast("long")
    )
    return orders.select(
        "instrument_id", "order_id", F.col("a.side").alias("side"), F.col("a.price").alias("price"), F.col("a.qty").alias("added"),
        F.greatest(F.col("a.qty") - taken, F.lit(0)).alias("rest"),
    )


def order_meta(events: DataFrame) -> DataFrame:
    """instrument_id, order_id, side, price, qty of every order still alive."""
    return order_residuals(events).filter("rest > 0").select("instrument_id", "order_id", "side", "price", F.col("rest").alias("qty"))


def lane_licence(events: DataFrame) -> DataFrame:
    """Whether an instrument's adds, trades and cancels may be applied as three lanes, and so by the closed form.

    instrument_id, unique_ids (no id is added twice), in_order (no order is cut before its
    add), plain (no modifies and no anonymous orders), licensed (all of them).
    """
    known = events.filter("et in (1, 2, 3, 4)")
    by_order = known.groupBy("instrument_id", "order_id").agg(
        F.count(F.when(F.col("et") == 1, 1)).alias("adds"), F.min(F.when(F.col("et") == 1, F.col("seq"))).alias("added"),
        F.min(F.when(F.col("et") != 1, F.col("seq"))).alias("cut"), F.count(F.when((F.col("et") == 3) | (F.col("order_id") == 0), 1)).alias("odd"),
    )
    out = by_order.groupBy("instrument_id").agg(
        F.max(F.when(F.col("order_id") != 0, F.col("adds"))).alias("most"),
        F.coalesce(F.max((F.col("cut") < F.col("added")) & (F.col("order_id") != 0)), F.lit(False)).alias("early"), F.sum("odd").alias("odd"),
    )
    unique, ordered, plain = F.coalesce(F.col("most"), F.lit(0)) <= 1, ~F.col("early"), F.col("odd") == 0
    return out.select("instrument_id", unique.alias("unique_ids"), ordered.alias("in_order"), plain.alias("plain"), (unique & ordered & plain).alias("licensed"))


def final_ladder(events: DataFrame) -> DataFrame:
    """instrument_id, side, price, total_qty, order_count of the book after the last event."""
    live = order_residuals(events).filter("rest > 0")
    return live.groupBy("instrument_id", "side", "price").agg(
        F.sum("rest").cast("long").alias("total_qty"), F.count(F.lit(1)).cast("long").alias("order_count")
    )


def level_deltas(events: DataFrame) -> DataFrame:
    """What each event does to its order's level: instrument_id, seq, side, price, d_qty, d_count."""
    order = Window.partitionBy("instrument_id", "order_id").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda c: F.max(F.when(F.col("et") == 1, F.col(c))).over(so_far)
    rows = events.filter("et in (1, 2, 4) and order_id <> 0").select(
        "instrument_id", "order_id", "seq", "et", F.when(F.col("et") != 1, F.col("qty")).otherwise(0).alias("cut"),
        ((F.col("et") == 2) & (F.col("qty") == 0)).cast("int").alias("full"),
        first("side").alias("side"), first("price").alias("price"), first("qty").alias("added"),
    ).filter("added is not null")
    rest = F.when(F.max("full").over(so_far) == 1, 0).otherwise(F.greatest(F.col("added") - F.sum("cut").over(so_far), F.lit(0)))
    rows = rows.withColumn("rest", rest.cast("long"))
    before = F.coalesce(F.lag("rest").over(order), F.lit(0))
    rows = rows.withColumn("before", before)
    return rows.select(
        "instrument_id", "seq", "side", "price",
        (F.col("rest") - F.col("before")).cast("long").alias("d_qty"),
        ((F.col("rest") > 0).cast("int") - (F.col("before") > 0).cast("int")).cast("int").alias("d_count"),
    ).filter("d_qty <> 0")


def ranked(ladder: DataFrame) -> DataFrame:
    """The ladder with ``lvl``: 1 is the best price of its side."""
    better = F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price"))
    return ladder.withColumn("lvl", F.row_number().over(Window.partitionBy("instrument_id", "side").orderBy(better)))


def depth_top(ladder: DataFrame, n: int = 10) -> DataFrame:
    """instrument_id, bid_depth, ask_depth, bid_levels, ask_levels, imbalance over the best ``n`` levels."""
    top = ranked(ladder).filter(F.col("lvl") <= n)
    of = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, c)), F.lit(0)).cast("long")
    out = top.groupBy("instrument_id").agg(
        of(0, F.col("total_qty")).alias("bid_depth"), of(1, F.col("total_qty")).alias("ask_depth"),
        of(0, F.lit(1)).alias("bid_levels"), of(1, F.lit(1)).alias("ask_levels"),
    )
    return out.withColumn("imbalance", scalars.imbalance(F.col("bid_depth"), F.col("ask_depth")))


def best_quotes(ladder: DataFrame) -> DataFrame:
    """instrument_id, bid, bid_size, ask, ask_size, spread, mid, microprice."""
    at = lambda side: F.when(F.col("side") == side, F.struct("price", "total_qty"))
    tops = ladder.groupBy("instrument_id").agg(F.max(at(0)).alias("b"), F.min(at(1)).alias("a"))
    tops = tops.select(
        "instrument_id", F.col("b.price").alias("bid"), F.col("b.total_qty").alias("bid_size"),
        F.col("a.price").alias("ask"), F.col("a.total_qty").alias("ask_size"),
    )
    bid, ask = F.col("bid"), F.col("ask")
    return tops.select(
        "*", scalars.spread(bid, ask).alias("spread"), scalars.mid(bid, ask).alias("mid"),
        scalars.microprice(bid, F.col("bid_size"), ask, F.col("ask_size")).alias("microprice"),
    )
