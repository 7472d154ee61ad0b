"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are combined three times, and each time rows meet only if their whole
normalised texts are equal, not merely their digests: inside each scan task
(Spark's map-side aggregation), then within each salt of a digest, then across the
salts. One group of copies may hold any share of the rows: it leaves a task as one
row, so it reaches the last step as at most ``salts`` rows.

Cases: a null text counts as empty; a null ``doc_id`` ranks after every other and is
returned as null; of rows that repeat the ``doc_id`` that stays (null as well), one with
the longest original text stays and the others go; an empty table gives an empty table.
Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import BLANKS, attach, column, fresh, settle, text_or_empty

#: Room for one id below the length in a combined rank.
_ID_ROOM = Decimal(1 << 65)
_ID_TOP = Decimal(1 << 63)


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def _rank(length: Column, doc_id: Column) -> Column:
    """One number that grows with the length, then with a smaller id; its type allows hash aggregation."""
    wide = "decimal(38,0)"
    last = F.lit(_ID_TOP).cast(wide)
    place = F.when(doc_id.isNull(), F.lit(0).cast(wide)).otherwise(last - doc_id.cast(wide))
    return (length.cast("decimal(10,0)") * F.lit(_ID_ROOM).cast("decimal(20,0)")).cast(wide) + place


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column], salts: int = 32) -> DataFrame:
    """One row per distinct normalised text: digest, variant, keep_id, group_size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    rows = rows.select("doc_id", F.char_length("text").alias("length"), normalised(F.col("text")).alias("body"))
    rows = rows.select(
        digest(F.col("body")).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
        "body",
        _rank(F.col("length"), F.col("doc_id")).cast("decimal(38,0)").alias("rank"),
    )
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "body").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    place = F.pmod(F.col("rank"), F.lit(_ID_ROOM).cast("decimal(20,0)"))
    keep = F.when(place == 0, F.lit(None)).otherwise((F.lit(_ID_TOP).cast("decimal(38,0)") - place).cast("long"))
    return whole.select("digest", "body", keep.cast("long").alias("keep_id"), F.col("n").cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = 32, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """A verdict for each row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after all blanks are deleted. The longest
    original text of a group stays, then the smallest doc_id. ``digest`` only decides
    which texts are compared; a poor one costs time, never correctness.
    """
    digest = digest or (lambda body: F.sha2(body, 256))
    groups = exact_groups(docs, digest, salts)
    # The texts are not needed again unless different ones share a digest.
    facts = settle(
        groups.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("variants")
        )
    )
    text = text_or_empty(docs)
    body = normalised(text)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(body, 256).alias("text_sha256"),
        F.char_length(text).alias("length"),
        digest(body).alias("digest"),
    )
    out = attach(rows, facts, "digest", "group_size").filter("variants = 1").drop("variants")
    clashes = facts.filter("variants > 1").select("digest")
    if not clashes.isEmpty():
        bodies = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(body, 256).alias("text_sha256"),
            F.char_length(text).alias("length"),
            digest(body).alias("digest"),
            body.alias("body"),
        ).join(clashes, "digest", "left_semi")
        split = bodies.join(groups.join(clashes, "digest", "left_semi"), ["digest", "body"])
        out = out.unionByName(split.select(*out.columns))
    return _one_of_twins(
        out.select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
            "length",
        )
    )


def _one_of_twins(out: DataFrame) -> DataFrame:
    """Verdicts in which one row of each group is kept, also where several have the id that stays."""
    out = settle(out)
    names = [c for c in out.columns if c != "length"]
    twins = out.filter("kept").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("twins"), F.max("group_size").alias("weight"))
    twins = settle(twins.filter("twins > 1"))
    if twins.isEmpty():
        return out.select(*names)
    # Places in the written table tell rows apart.
    out = out.withColumn("place", F.monotonically_increasing_id())
    first = out.filter("kept").groupBy("text_sha256").agg(F.max(F.struct("length", (-F.col("place")).alias("back"))).alias("first"))
    twins = settle(twins.join(first, "text_sha256").select("text_sha256", "weight", (-F.col("first.back")).alias("keeper")))
    out = attach(out, twins, "text_sha256", "weight")
    kept = F.col("kept") & (F.col("keeper").isNull() | (F.col("keeper") == F.col("place")))
    return out.withColumn("kept", kept).select(*names)


def drop_exact_copies(docs: DataFrame, salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    verdicts = exact_dedup(docs, salts).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    verdicts = settle(verdicts.filter("not kept or n > 1"))
    key, digest = fresh("id", docs.columns), fresh("digest", docs.columns)
    text = text_or_empty(docs)
    names = verdicts.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest), "kept")
    same = (F.sha2(normalised(text), 256) == names[digest]) & docs["doc_id"].cast("long").eqNullSafe(names[key])
    out = docs.join(names, same, "left_anti")
    # Of rows with one id and text, one is left by itself.
    columns = [column(c) for c in docs.columns]
    many = docs.join(names.filter("kept").drop("kept"), same).select(F.struct(*columns).alias("row"), F.char_length(text).alias("length"), key, digest)
    return out.unionByName(many.groupBy(key, digest).agg(F.max_by("row", "length").alias("row")).select("row.*"))
