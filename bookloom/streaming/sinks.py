"""Run artefacts: sampled ticks, flags and a manifest, as files that batch and streaming queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def frames(rows: DataFrame, kind: str) -> DataFrame:
    """Rows as telemetry frames: frame_type, seq, payload (JSON)."""
    return rows.select(F.lit(kind).alias("frame_type"), F.col("seq"), F.to_json(F.struct(*rows.columns)).alias("payload"))


#: Of the frames on the wire.
WIRE_VERSION = 2


def on_the_wire(frames: DataFrame) -> DataFrame:
    """``frames`` with ``frame``: their length (of what follows it) and version in 4 and 2 little-endian bytes, and the payload."""
    body = F.encode("payload", "UTF-8")
    little = lambda n, width: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(width)]))
    size = (F.octet_length("payload") + 2).cast("long")
    return frames.withColumn("frame", F.concat(little(size, 4), little(F.lit(WIRE_VERSION), 2), body))


def first_per_second(rows: DataFrame) -> DataFrame:
    """At most one row for each instrument and second of event time: the first."""
    second = F.floor(F.col("ts_ns") / 1_000_000_000)
    place = F.row_number().over(Window.partitionBy("instrument_id", second).orderBy("seq"))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def verdict(delta):
    """A run's verdict from its score change."""
    return F.when(delta < -100, "KILLED").when(delta < -10, "DAMAGED").otherwise("OK")


def manifest(flags: DataFrame, events: DataFrame, delta: float = 0.0) -> DataFrame:
    """One row about a run: its bounds, events, flags by kind and verdict."""
    bounds = events.agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    by_kind = flags.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = by_kind.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("flags"))
    # One row each.
    both = bounds.withColumn("run", F.lit(0)).join(kinds.withColumn("run", F.lit(0)), "run").drop("run")
    return both.withColumn("verdict", verdict(F.lit(delta)))


def bounded(rows: DataFrame, capacity: int, period_ns: int) -> DataFrame:
    """What a channel of ``capacity`` rows for each instrument and period of event time lets pass.

    ``dropped_total`` counts the rows of the instrument that did not pass up to that row.
    """
    period = Window.partitionBy("instrument_id", F.floor(F.col("ts_ns") / period_ns)).orderBy("seq")
    placed = rows.withColumn("_over", (F.row_number().over(period) > capacity).cast("long"))
    so_far = Window.partitionBy("instrument_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("dropped_total", F.sum("_over").over(so_far)).filter("_over = 0").drop("_over")


def write_run(path: str, events: DataFrame, ticks: DataFrame, flags: DataFrame, delta: float = 0.0) -> None:
    """ticks/ (at most a row a second), flags/ and run/ under ``path``, as JSON lines."""
    first_per_second(ticks).write.mode("overwrite").json(f"{path}/ticks")
    flags.write.mode("overwrite").json(f"{path}/flags")
    manifest(flags, events, delta).coalesce(1).write.mode("overwrite").json(f"{path}/run")


def stream_to(rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger):
    """An exactly-once file sink; ``trigger`` defaults to all that is available now."""
    writer = rows.writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(rows: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` rows of each instrument by sequence."""
    back = F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("seq")))
    return rows.withColumn("_back", back).filter(F.col("_back") <= n).drop("_back")
