"""Market events derived from general tables: one stream from ``events``, one from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookloom.functions.ranking import global_row_number
from bookloom.schema import ADD, CANCEL, EVENT_COLUMNS, MODIFY, SNAPSHOT, TRADE


def _typed(df: DataFrame) -> DataFrame:
    ints = {"instrument_id", "et", "side"}
    return df.select(*[F.col(c).cast("int" if c in ints else "long").alias(c) for c in EVENT_COLUMNS])


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: views and signups add orders, clicks cancel and purchases trade the latest one of the instrument."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    et = F.when(kind.isin("view", "signup"), ADD).when(kind == "click", CANCEL).when(kind == "purchase", TRADE).otherwise(SNAPSHOT)
    base = raw.select(
        (F.col("event_id") + 1).alias("seq"),
        (F.col("user_id") % 8).alias("instrument_id"),
        et.alias("et"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.floor("value") + 1).alias("q"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
    )
    earlier = Window.partitionBy("instrument_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last_add = F.max(F.when(F.col("et") == ADD, F.col("seq"))).over(earlier)
    rows = base.withColumn("last_add", last_add).filter("et in (1, 5) or last_add is not null")
    side, level = F.col("k") % 2, 1 + F.col("k") % 50
    return _typed(
        rows.withColumn("side", side)
        .withColumn("price", F.when(side == 0, 10000 - level).otherwise(10000 + level))
        .withColumn("qty", F.when((F.col("et") == CANCEL) & (F.col("k") % 3 == 0), 0).otherwise(F.col("q")))
        .withColumn("order_id", F.when(F.col("et") == ADD, F.col("seq")).otherwise(F.coalesce("last_add", F.lit(0))))
    )


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: each line adds an order on its ship date; returned and accepted ones are cut three days later."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_extendedprice", "l_quantity", "l_returnflag"
    )
    key = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    orders = global_row_number(lines, key, "order_id")
    side = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    level = 1 + F.floor(F.col("l_extendedprice") / F.col("l_quantity")) % 100
    orders = orders.select(
        "order_id",
        (F.col("l_suppkey") % 16).alias("instrument_id"),
        side.alias("side"),
        F.when(side == 0, 10000 - level).otherwise(10000 + level).alias("price"),
        (F.floor("l_quantity") * 100).alias("q"),
        F.col("l_returnflag").alias("rf"),
        F.col("l_shipdate").alias("d"),
    )
    returned = F.col("rf") == "R"
    adds = orders.select("order_id", "instrument_id", "side", "price", F.col("q").alias("qty"), F.lit(ADD).alias("et"), "d", F.lit(1).alias("ph"))
    cuts = orders.filter("rf in ('R', 'A')").select(
        "order_id", "instrument_id", "side", "price",
        F.when(returned, 0).otherwise(F.floor(F.col("q") / 2)).alias("qty"),
        F.when(returned, CANCEL).otherwise(TRADE).alias("et"),
        (F.col("d") + F.expr("interval 3 day")).alias("d"),
        F.lit(2).alias("ph"),
    )
    rows = global_row_number(adds.unionByName(cuts), ["d", "order_id", "ph"], "seq")
    return _typed(rows.withColumn("ts_ns", F.col("seq") * 1000))


def from_events_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: sixty ids of each instrument, used again and again, of which 0 is anonymous; signups modify."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    et = F.when(kind == "view", ADD).when(kind == "signup", MODIFY).when(kind == "click", CANCEL).when(kind == "purchase", TRADE).otherwise(SNAPSHOT)
    rows = raw.select(
        (F.col("event_id") + 1).alias("seq"), (F.col("user_id") % 8).alias("instrument_id"), et.alias("et"), (k % 2).alias("side"),
        F.when(k % 2 == 0, 9999 - k % 20).otherwise(10001 + k % 20).alias("price"),
        F.when((kind == "click") & (k % 3 == 0), 0).otherwise(F.floor("value") + 1).alias("qty"),
        ((F.col("event_id") * 7 + k) % 60).alias("order_id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
    )
    return _typed(rows)


#: The same streams for an ANSI engine; each defines a CTE p1.
P1_SQL = """
b as (select event_id + 1 as seq, cast(user_id % 8 as int) as instrument_id,
    case event_type when 'view' then 1 when 'signup' then 1 when 'click' then 2 when 'purchase' then 4 else 5 end as et,
    cast(json_extract(props, '$.k') as bigint) as k, cast(floor(value) as bigint) + 1 as q, epoch_us(ts) * 1000 as ts_ns from events),
c as (select *, max(case when et = 1 then seq end) over (partition by instrument_id order by seq
    rows between unbounded preceding and 1 preceding) as last_add from b),
p1 as (select seq, instrument_id, et, cast(k % 2 as int) as side,
    case when k % 2 = 0 then 10000 - (1 + k % 50) else 10000 + (1 + k % 50) end as price,
    case when et = 2 and k % 3 = 0 then 0 else q end as qty,
    case when et = 1 then seq else coalesce(last_add, 0) end as order_id, ts_ns
    from c where et in (1, 5) or last_add is not null)"""
P2_SQL = """
o as (select row_number() over (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) as oid,
    cast(l_suppkey % 16 as int) as instrument_id, case l_linestatus when 'O' then 0 else 1 end as side,
    case l_linestatus when 'O' then 10000 - (1 + cast(floor(l_extendedprice / l_quantity) as bigint) % 100)
        else 10000 + (1 + cast(floor(l_extendedprice / l_quantity) as bigint) % 100) end as price,
    cast(floor(l_quantity) as bigint) * 100 as q, l_returnflag as rf, l_shipdate as d from lineitem),
e as (select oid, instrument_id, side, price, q as qty, 1 as et, d, 1 as ph from o union all
    select oid, instrument_id, side, price, case when rf = 'R' then 0 else cast(floor(q / 2) as bigint) end,
        case when rf = 'R' then 2 else 4 end, d + interval 3 day, 2 from o where rf in ('R', 'A')),
p1 as (select row_number() over (order by d, oid, ph) as seq, instrument_id, et, side, price, qty, oid as order_id from e)"""
P3_SQL = """
p1 as (select event_id + 1 as seq, cast(user_id % 8 as int) as instrument_id,
    case event_type when 'view' then 1 when 'signup' then 3 when 'click' then 2 when 'purchase' then 4 else 5 end as et,
    cast(k % 2 as int) as side, case when k % 2 = 0 then 9999 - k % 20 else 10001 + k % 20 end as price,
    case when event_type = 'click' and k % 3 = 0 then 0 else cast(floor(value) as bigint) + 1 end as qty,
    (event_id * 7 + k) % 60 as order_id, epoch_us(ts) * 1000 as ts_ns
    from (select *, cast(json_extract(props, '$.k') as bigint) as k from events))"""
