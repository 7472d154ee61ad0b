"""Event sources; ``events`` opens one by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def events(spark: SparkSession, kind: str, path: str = "", **options) -> DataFrame:
    """Events of a source: itch, log, synthetic, phased, p1 or p2 (test tables under ``path``)."""
    from bookloom.sources import itch, records, scenarios, testmarket

    if kind == "itch":
        return itch.read_itch(spark, path, **options)
    if kind == "log":
        return records.read_event_log(spark, path)
    if kind in ("synthetic", "phased"):
        return getattr(scenarios, kind)(spark, **options)
    if kind in ("p1", "p2"):
        return (testmarket.from_events if kind == "p1" else testmarket.from_lineitem)(spark, path)
    raise ValueError(f"no source is called {kind!r}")
