r"""Line deduplication: explode, hash, count documents, drop, reassemble by position.

Whole texts are split at ``\n``. A line's key is the line without blanks at both ends
and with A-Z in lower case. Keys of at least ``min_chars`` code points that stand in at
least ``min_docs`` documents lose their lines in all documents but the one with the
smallest doc_id, which keeps all of its own. The other lines stay in place.

Texts are exploded and hashed once; the digests are settled, then counted and looked up.
A hot key costs one row for each task that holds it: counting combines on the map
side, and the verdict of the few hottest keys is broadcast (their number is bounded).

Cases: a null or empty text is one empty line and stays as it is; null doc_ids rank
last; rows that repeat a doc_id count as one document, but each loses the lines of its own
text; an empty table gives an empty one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.common import BLANKS, LAST_ID, LOWER, UPPER, attach, column, fresh, settle, text_or_empty


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, own (a hash of the row's text), at (position), line (digest of the key) of each line that counts."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(text_or_empty(docs)).alias("own"),
        F.posexplode(F.split(text_or_empty(docs), "\n", -1)).alias("at", "line"),
    )
    rows = rows.select("doc", "own", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return rows.select("doc", "own", "at", F.unhex(F.md5("key")).alias("line"))


def repeated_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """Of ``keyed_lines``, the keys over the threshold: line (digest), first_doc, uses."""
    if min_docs <= 2:
        counted = lines.groupBy("line").agg(
            F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count(F.lit(1)).alias("uses")
        )
        return counted.filter("first_doc < last_doc").drop("last_doc")
    once = lines.groupBy("line", "doc").agg(F.count(F.lit(1)).alias("uses"))
    counted = once.groupBy("line").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses"))
    return counted.filter(F.col("n") >= min_docs).drop("n")


_NEW = T.StructType().add("text", T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType())


@F.pandas_udf(_NEW)
def _without(text: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    out = []
    for whole, gone in zip(text, dropped):
        lines = whole.split("\n")
        n = len(lines)
        if gone is not None and len(gone):
            skip = set(gone.tolist())
            whole = "\n".join(x for i, x in enumerate(lines) if i not in skip)
            out.append((whole, n, len(skip)))
        else:
            out.append((whole, n, 0))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped``.

    Columns of the input that are called n_lines or n_dropped are replaced; any others
    stay, whatever their names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    docs = docs.select(*map(column, kept))
    lines = settle(keyed_lines(docs, min_chars))
    facts = settle(repeated_lines(lines, min_docs))
    hits = attach(lines, facts, "line", "uses", how="inner").filter("doc > first_doc")
    doc, own, gone, new = (fresh(c, kept) for c in ("doc", "own", "gone", "new"))
    # Equal rows have equal positions, so a set is never longer than a text.
    dropped = hits.groupBy(F.col("doc").alias(doc), F.col("own").alias(own)).agg(F.collect_set("at").alias(gone))
    rows = docs.select(
        *map(column, kept),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias(doc),
        F.xxhash64(text_or_empty(docs)).alias(own),
    )
    out = rows.join(dropped, [doc, own], "left")
    out = out.select(*map(column, kept), _without(text_or_empty(docs), F.col(gone)).alias(new))
    changed = F.when(F.col(f"{new}.n_dropped") > 0, F.col(f"{new}.text")).otherwise(F.col("text"))
    return out.select(
        *[changed.alias(c) if c.lower() == "text" else column(c) for c in kept],
        F.col(f"{new}.n_lines").alias("n_lines"),
        F.col(f"{new}.n_dropped").alias("n_dropped"),
    )
