r"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when the document holds at least ``threshold`` of the
item's distinct ``n``-word shingles. Items are partitioned by their number of shingles;
an item of ``s`` shingles is represented by its bottom-k MinHash sketch with
``k = s - ceil(threshold * s) + 1``. A document that holds enough of the item cannot
miss all of the k, so a document becomes a candidate by one lookup of each of its
shingles, however long it is, and no leak is lost. (Banding a MinHash of whole documents
would fail here: an item in a document a thousand times its size has a Jaccard
similarity near zero.) Documents with fewer shingles than a size partition needs are
not looked up in it. Candidates are verified by exact containment of the words.

Words are runs of letters, digits and non-ASCII characters, in lower case, so other case
or punctuation at the edges hides nothing. An item of fewer than ``n`` words is one
shingle of all its words; an item without words is never found.

Items of up to ``block_bytes`` of text are broadcast, and documents stay where they are: no
shuffle. More items are never broadcast: their sketches become a table, of which only a bit
map of bounded size travels; documents send the shingles that it lets pass, which meet the
sketches by a join, and what shares a value is verified by words where the document is.
Hot shingles and items are broadcast by their share of the rows (see ``attach``).

Cases: null texts have no words; null and repeated ids are carried along; an empty table
on either side gives no finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import attach, fresh, settle, text_or_empty
from bookloom.llm.textkit import PUNCT_BYTES, Words, grams, mix, pieces, whole

#: Bytes of item texts that are broadcast.
BLOCK_BYTES = 16 << 20
#: Bits of the map of sketch values, as a power of two: at least and at most (16 MB).
_MAP_BITS = (16, 27)
_DROP = {b: " " for b in range(128) if not chr(b).isalnum()}


def words_of(text: str) -> list[str]:
    return text.lower().translate(_DROP).split(" ")


def shingles(text: str, n: int) -> set[tuple[str, ...]]:
    words = [w for w in words_of(text) if w]
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _hashes(texts: list[str], lengths: Iterable[int]) -> list[dict[int, np.ndarray]]:
    """Distinct gram hashes of each text by gram length."""
    out = []
    for text in texts:
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        hashes = Words(raw, np.array([0, len(raw)]), PUNCT_BYTES).hashes()
        out.append({n: np.unique(grams(hashes, n)) for n in lengths})
    return out


def sketch(text: str, length: int, threshold: float) -> tuple[np.ndarray, int]:
    """The bottom-k MinHash sketch of an item's shingles of ``length`` words, and their number."""
    values = _hashes([text], [length])[0][length]
    size = len(values)
    k = size - math.ceil(threshold * size - 1e-9) + 1
    return values[np.argsort(mix(values))][:k], size


def least_shingles(bits: int, threshold: float) -> int:
    """What a document needs to hold enough of any item of a size partition."""
    return math.ceil(threshold * (1 << (bits - 1)) - 1e-9)


def held(text: str, items: Iterable[tuple], threshold: float) -> list[tuple]:
    """item_id, shared and own shingles of the given (item_id, shingles) that the text holds."""
    out, cut = [], {}
    words = [w for w in words_of(text) if w]
    for item_id, own in items:
        n = len(next(iter(own)))
        if n not in cut:
            cut[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        shared = len(own & cut[n])
        if shared >= threshold * len(own) - 1e-9:
            out.append((item_id, shared, len(own)))
    return out


class ItemIndex:
    """The sketches of a block of items, by shingle length and size partition."""

    def __init__(self, items: list[tuple], n: int, threshold: float):
        self.n, self.threshold = n, threshold
        self.items = []
        sketches: dict[tuple[int, int], dict[int, list[int]]] = {}
        for item_id, text in items:
            grams_of = shingles(text or "", n)
            if not grams_of:
                continue
            at = len(self.items)
            self.items.append((item_id, grams_of))
            length = len(next(iter(grams_of)))
            values, size = sketch(text, length, threshold)
            partition = sketches.setdefault((length, size.bit_length()), {})
            for value in values.tolist():
                partition.setdefault(value, []).append(at)
        self.partitions = []
        for (length, bits), found in sorted(sketches.items()):
            keys = np.array(sorted(found), np.uint64)
            gate = np.zeros(1 << 16, bool)
            gate[(keys >> np.uint64(48)).astype(np.int64)] = True
            least = least_shingles(bits, threshold)
            self.partitions.append((length, least, keys, gate, [found[k] for k in keys.tolist()]))
        self.lengths = sorted({p[0] for p in self.partitions})

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, set[int]]:
        """Items that each row may hold."""
        out: dict[int, set[int]] = {}
        words = Words(data, offsets, PUNCT_BYTES)
        hashes, rows = words.hashes(), None
        for length in self.lengths:
            values = grams(hashes, length)
            inside = whole(words.counts, length)
            for n, least, keys, gate, holders in self.partitions:
                if n != length or not len(values):
                    continue
                hit = np.flatnonzero(gate[(values >> np.uint64(48)).astype(np.int64)] & inside)
                at = np.searchsorted(keys, values[hit])
                at[at == len(keys)] = 0
                same = keys[at] == values[hit]
                hit, at = hit[same], at[same]
                if not len(hit):
                    continue
                rows = words.rows() if rows is None else rows
                row = rows[hit]
                big = words.counts[row] - length + 1 >= least
                for r, k in zip(row[big].tolist(), at[big].tolist()):
                    out.setdefault(r, set()).update(holders[k])
        return out

    def finds(self, text: str, candidates: Iterable[int]) -> list[tuple]:
        """item_id, shared and own shingles of the candidates that the text holds."""
        return held(text, [self.items[at] for at in sorted(candidates)], self.threshold)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty(benchmark).alias("text"))


def _lowered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo, _, data, offsets in pieces(batch, "lowered"):
            yield batch, lo, data, offsets


_FINDS = "doc_id long, item_id long, shared long, shingles long, containment double"


def _finds_record(found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*found), [pa.int64()] * 4 + [pa.float64()])]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "shared", "shingles", "containment"])


def _index(items: DataFrame, n: int, threshold: float, block_bytes: int) -> ItemIndex | None:
    """The items in memory, if their texts have at most ``block_bytes``."""
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return ItemIndex([tuple(r) for r in items.collect()], n, threshold) if total <= block_bytes else None


def _sketches(n: int, threshold: float):
    """item, words of a shingle, least shingles of a document, value: the items' sketches as rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = sum(1 for w in words_of(text) if w)
                if not words:
                    continue
                length = min(n, words)
                values, size = sketch(text, length, threshold)
                least = least_shingles(size.bit_length(), threshold)
                out += [(item, length, least, v) for v in values.view(np.int64).tolist()]
            columns = zip(*out) if out else [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item", "words", "least", "value"])

    return run


class FarSearch:
    """Search for items too many to be broadcast; ``items`` and ``rows`` (doc_id, own, lowered) are joined by shingle."""

    def __init__(self, items: DataFrame, n: int, threshold: float):
        self.n, self.threshold = n, threshold
        # Numbers by place in the written table, so that repeated items differ.
        self.items = settle(items).withColumn("item", F.monotonically_increasing_id())
        self.sketches = settle(self.items.select("item", "text").mapInArrow(_sketches(n, threshold), "item long, words int, least long, value long"))
        size = max(1, self.sketches.count()) * 16
        self.bits = min(max(size.bit_length(), _MAP_BITS[0]), _MAP_BITS[1])
        place = F.shiftrightunsigned("value", 64 - self.bits)
        words = self.sketches.groupBy(F.shiftright(place, 6).alias("word")).agg(
            F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(value, {64 - self.bits}) & 63 as int)))").alias("bits")
        )
        # At most 2 ** (bits - 6) numbers.
        table = words.toArrow()
        self.map = np.zeros(1 << (self.bits - 6), np.uint64)
        self.map[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        self.lengths = sorted(r[0] for r in self.sketches.select("words").distinct().collect())

    def finds(self, rows: DataFrame) -> DataFrame:
        """doc_id, own, item_id, shared, shingles, containment for each row and item it holds."""
        bits, table, lengths = self.bits, rows.sparkSession.sparkContext.broadcast(self.map), self.lengths

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offsets in pieces(batch, "lowered"):
                    words = Words(data, offsets, PUNCT_BYTES)
                    hashes, row = words.hashes(), words.rows()
                    for length in lengths:
                        values = grams(hashes, length)
                        place = values >> np.uint64(64 - bits)
                        known = table.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0
                        hit = np.flatnonzero(known & whole(words.counts, length))
                        if not len(hit):
                            continue
                        found = np.unique(np.stack([row[hit].astype(np.uint64), values[hit]]), axis=1)
                        at = found[0].astype(np.int64)
                        ids = batch.slice(lo, hi - lo).select(["doc_id", "own"]).take(pa.array(at))
                        shingles_there = words.counts[at] - length + 1
                        yield pa.RecordBatch.from_arrays(
                            [*ids.columns, pa.array(np.full(len(at), length, np.int32)), pa.array(shingles_there), pa.array(found[1].view(np.int64))],
                            names=["doc_id", "own", "words", "there", "value"],
                        )

        key = F.concat_ws(":", "words", "value").alias("key")
        hits = rows.mapInArrow(send, "doc_id long, own long, words int, there long, value long")
        hits = settle(hits.select("doc_id", "own", "there", key).distinct())
        holders = self.sketches.groupBy(key).agg(F.collect_list(F.struct("item", "least")).alias("holders"))
        holders = settle(holders.join(hits.groupBy("key").agg(F.count(F.lit(1)).alias("docs")), "key"))
        pairs = attach(hits, holders, "key", "docs", how="inner").select("doc_id", "own", "there", F.explode("holders").alias("h"))
        pairs = pairs.filter("there >= h.least").select("doc_id", "own", F.col("h.item").alias("item"))
        pairs = settle(pairs.groupBy("doc_id", "own", "item").agg(F.count(F.lit(1)).alias("values")).drop("values"))
        texts = settle(self.items.join(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("docs")), "item"))
        pairs = attach(pairs, texts, "item", "docs", how="inner")
        pairs = pairs.groupBy(F.col("doc_id").alias("id"), F.col("own").alias("hash")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
        same = rows["doc_id"].eqNullSafe(pairs["id"]) & (rows["own"] == pairs["hash"])
        met = rows.join(pairs, same).select("doc_id", "own", "lowered", "items")
        n, threshold = self.n, self.threshold

        def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, own = [], []
                for doc_id, key, text, items in zip(*(c.to_pylist() for c in batch.columns)):
                    one = [(doc_id, *x, x[1] / x[2]) for x in held(text, ((i["item_id"], shingles(i["text"], n)) for i in items), threshold)]
                    found += one
                    own += [key] * len(one)
                if found:
                    out = _finds_record(found)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(own, pa.int64())], names=[*out.schema.names, "own"])

        return met.mapInArrow(verify, f"{_FINDS}, own long")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Finds: doc_id, item_id, shared, shingles (of the item), containment."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_or_empty(docs)).alias("lowered"), F.xxhash64(text_or_empty(docs)).alias("own")
    )
    items = _items(benchmark)
    found = _index(items, n, threshold, block_bytes)
    if found is None:
        return FarSearch(items, n, threshold).finds(rows).drop("own")
    index = docs.sparkSession.sparkContext.broadcast(found)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, data, offsets in _lowered(batches):
            found = []
            for r, candidates in index.value.candidates(data, offsets).items():
                doc_id, text = batch.column(0)[lo + r].as_py(), batch.column(1)[lo + r].as_py()
                found += [(doc_id, *x, x[1] / x[2]) for x in index.value.finds(text, candidates)]
            if found:
                yield _finds_record(found)

    return rows.drop("own").mapInArrow(search, _FINDS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, unchanged."""
    items = _items(benchmark)
    found = _index(items, n, threshold, block_bytes)
    mark = fresh("lowered", docs.columns)
    if found is None:
        own = fresh("own", docs.columns)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_or_empty(docs)).alias("lowered"), F.xxhash64(text_or_empty(docs)).alias("own"))
        gone = FarSearch(items, n, threshold).finds(rows).select(F.col("doc_id").alias(mark), F.col("own").alias(own)).distinct()
        same = docs["doc_id"].cast("long").eqNullSafe(gone[mark]) & (F.xxhash64(text_or_empty(docs)) == gone[own])
        return docs.join(gone, same, "left_anti")
    index = docs.sparkSession.sparkContext.broadcast(found)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            for lo, _, data, offsets in pieces(batch, mark):
                for r, candidates in index.value.candidates(data, offsets).items():
                    if index.value.finds(batch.column(mark)[lo + r].as_py(), candidates):
                        stays[lo + r] = False
            yield batch.drop_columns([mark]).filter(pa.array(stays))

    return docs.withColumn(mark, F.lower(text_or_empty(docs))).mapInArrow(clean, docs.schema)
