"""What the corpus operators share: tables, checkpoints and joins that survive hot keys."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A null id sorts after every other id.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``. Only on one machine (a local
    master, as in tests) a temporary folder takes its place where that is unset.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bookloom-"))
    return df.checkpoint(eager=True)


def fresh(name: str, *taken: Iterable[str]) -> str:
    """A column name like ``name`` that none of the given columns has, in any case."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """A top-level column by name, also where the name holds dots or back quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def attach(
    rows: DataFrame, facts: DataFrame, key: str, weight: str, share: int = 1000, how: str = "left", twice: bool = False
) -> DataFrame:
    """Join ``facts`` (one row per ``key``, settled) to ``rows`` although some keys are hot.

    ``weight`` counts the rows behind a key. Keys that hold more than 1/``share`` of the
    total weight are fewer than ``share`` by arithmetic, so they are broadcast whatever
    the input's size; rows of those keys then leave the shuffled join under keys of
    their own. The remaining keys are too small to skew a partition. ``facts`` should
    hold every heavy key of ``rows``, also those with nothing to tell. Columns of both
    sides must differ except for ``key``; null keys match nothing. Where ``rows`` are
    wide but cheap to read ``twice``, rows of hot keys are not shuffled at all.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    bound = max(int(total) // share, 1)
    names = [c for c in facts.columns if c != key]
    facts = facts.filter(F.col(key).isNotNull())
    hot = facts.filter(F.col(weight) > bound).select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot"))
    # Always 0, but not as a constant: the optimizer would take that out of the join's keys.
    zero = F.least(F.col(weight), F.lit(0)).cast("long")
    cold = facts.filter(F.col(weight) <= bound).select(F.col(key).alias("_cold_key"), zero.alias("_cold_at"), F.struct(*names).alias("_cold"))
    # Rows that need no cold fact are spread by content; they can match nothing since _cold_at is 0.
    spread = 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40))
    known = F.col(key) == F.col("_hot_key")
    if twice:
        near = rows.join(F.broadcast(hot), known).select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in names))
        far = rows.join(F.broadcast(hot.select("_hot_key")), known, "left_anti")
        far = far.withColumn("_at", F.when(F.col(key).isNull(), spread).otherwise(0))
        same = (F.col(key) == F.col("_cold_key")) & (F.col("_at") == F.col("_cold_at"))
        far = far.join(cold, same, how).select(*rows.columns, *(F.col(f"_cold.{c}").alias(c) for c in names))
        return near.unionByName(far)
    out = rows.join(F.broadcast(hot), known, "left")
    settled_already = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_at", F.when(settled_already, spread).otherwise(0))
    out = out.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_at") == F.col("_cold_at")), "left")
    picked = [F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in names]
    if how == "inner":
        out = out.filter(F.col("_hot_key").isNotNull() | F.col("_cold_key").isNotNull())
    return out.select(*rows.columns, *picked)


def ids(docs: DataFrame) -> Column:
    return F.col("doc_id").cast("long")


def text_or_empty(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))
