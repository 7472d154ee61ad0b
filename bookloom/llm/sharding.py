"""Sharding by minimax contiguous partition.

Equal texts form an atomic group. Groups are ordered by the digest of their text and
cut into contiguous shards so that the largest shard is as small as any such cut
allows: a binary search finds the smallest capacity that a greedy check accepts.

The driver never sees the groups. It sees totals of digest prefixes and asks for finer
prefixes only where, for some capacity still possible, a cut may fall; when those
prefixes hold one group each, the search is exact. Their number is bounded by the
number of shards, not by the input.

Cases: a null text has no bytes and is grouped with the empty ones; every row gets a
place, also repeated rows and rows with null ids; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookloom.llm.common import settle, text_or_empty

#: Hex digits of a digest: of the first totals, of each refinement, and of a slot's bucket.
_FIRST, _STEP, _BUCKET = 3, 2, 2


def greedy_cuts(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Where each shard ends if it takes all it can; None if the sizes don't fit."""
    sums = [0, *accumulate(sizes)]
    cuts, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        cuts.append(at)
    return cuts if at == len(sizes) else None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    low = max(max(sizes, default=0), -(-sum(sizes) // shards))
    high = sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _open_atoms(atoms: list[tuple[str, int, int, int]], shards: int) -> list[str]:
    """Prefixes with several groups in which, for a capacity still possible, a cut may fall."""
    sizes = [a[1] for a in atoms]
    sums = [0, *accumulate(sizes)]
    total = sums[-1]
    high = smallest_capacity(sizes, shards)
    low = max(-(-total // shards), max(a[3] for a in atoms))
    found, at = [], 0
    for k in range(1, shards):
        # Finer atoms let a greedy shard end later, never earlier, and never beyond k times the capacity.
        at = bisect_right(sums, sums[at] + low) - 1
        to = bisect_right(sums, min(k * high, total))
        found += [a[0] for a in atoms[at:to] if a[2] > 1]
    return list(dict.fromkeys(found))


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Digest prefixes at which the shards after the first begin; groups: digest, bytes."""

    def totals(df: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
        prefix = F.substring("digest", 1, digits).alias("prefix")
        rows = df.groupBy(prefix).agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes")).collect()
        return [tuple(r) for r in rows]

    digits = _FIRST
    atoms = sorted(totals(groups, digits))
    while atoms and digits < 64 and (fine := [p for p in _open_atoms(atoms, shards) if len(p) == digits]):
        wanted = groups.filter(F.substring("digest", 1, digits).isin(fine))
        digits += _STEP
        atoms = sorted([a for a in atoms if a[0] not in set(fine)] + totals(wanted, digits))
    if not atoms:
        return []
    sizes = [a[1] for a in atoms]
    ends = greedy_cuts(sizes, shards, smallest_capacity(sizes, shards))
    return [atoms[e][0] if e < len(atoms) else "g" for e in ends[:-1]]  # "g" is above every digest


def shard(docs: DataFrame, shards: int = 8, salts: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    text = text_or_empty(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    groups = settle(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    cuts = minimax_cuts(groups, shards)
    place = F.lit(0)
    for cut in cuts:
        place = place + (F.col("digest") >= F.lit(cut)).cast("int")
    rows = rows.withColumn("shard", place.cast("int"))
    rows = rows.withColumn("bucket", F.substring("digest", 1, _BUCKET))
    rows = rows.withColumn("salt", F.coalesce(F.pmod("doc_id", F.lit(salts)), F.lit(0)).cast("int"))
    # A slot is the rows before its bucket and salt, plus the place there; the counts number at most
    # (16 ** _BUCKET + shards) * salts, so they may be broadcast whatever the input.
    key = ["shard", "bucket", "salt"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    there = Window.partitionBy(*key).orderBy("digest", "doc_id")
    rows = rows.withColumn("there", F.row_number().over(there) - 1)
    return rows.join(F.broadcast(counts), key).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("there")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
