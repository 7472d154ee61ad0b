r"""Substring deduplication by prefix-partitioned suffix trees over words.

The suffixes of all texts, taken at words, are split by variable-length prefixes into
groups that fit in memory. Each group sorts its suffixes by their words, derives the
lengths of common prefixes of neighbours, and finds the tree's deep internal nodes: runs
of suffixes that share ``window`` words or more. A leaf of such a node that lies in a
later document than the node's first is the start of a repeat; in one document these
starts overlap, and their union is the maximal repeats that go. All comparisons in a group
are of words, not of hashes.

The tree is sparse, so that its size stays below the texts': a window of words is entered
through its anchor, the smallest hash among its ``anchor``-word grams. Equal windows have
equal anchors at the same place, so every node's leaves meet. Consecutive windows of one
anchor travel as one segment of text, of which the windows are the suffixes. Anchors found
in one row only rule out their windows before any text is sent. The anchor's words are the
prefix that chooses the group; where one such prefix is too common (more than 1/``_SHARE`` of
all segments), its windows are dealt by the longer prefix of all their ``window`` words.
The number of groups follows from the number of segments, without a ceiling.

Every step combines on the map side, by units of bounded size: a passage that stands in
a third of all documents reaches its group as one entry for each unit.

Words are runs of characters other than space and \t \n \v \f \r. Cases: a null text
has no words; texts shorter than a window lose nothing; null doc_ids rank last; rows
that repeat a doc_id never remove each other's words; an empty table gives an empty one.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import LAST_ID, settle, text_or_empty
from bookloom.llm.textkit import BLANK_BYTES, Words, grams, mix, packed, pieces, trim, whole

#: Bytes of text that are combined before anything is sent.
UNIT = 12 << 20
#: Bytes of text of the windows in one group.
GROUP_BYTES = 2 << 20
#: Groups at least, so that small inputs are spread as well.
_LEAST_GROUPS = 128
#: An anchor of more segments than this, and than 1/_SHARE of all, is a common one; so there are fewer than _SHARE.
_COMMON, _SHARE = 1 << 14, 1 << 20
#: Bytes of a segment with its places, roughly.
_SEGMENT_BYTES = 150
#: The lowest bits of a sent anchor: the binary logarithm of the rows of the unit that have it.
_ROWS_BITS = np.uint64(15)
_ANCHOR = ~_ROWS_BITS
#: A place: 32 bits of word position, 16 of the windows there that repeat, 16 that tell rows apart besides their hash.
_POSITION, _WINDOWS, _MOST_WINDOWS, _LOW16 = np.uint64(32), np.uint64(16), 16, np.uint64(0xFFFF)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    change = np.empty(len(sorted_keys), bool)
    change[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=change[1:])
    return np.flatnonzero(change)


def _units(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Slices of rows, in units of about ``size`` bytes of text."""
    unit, held = [], 0
    for batch in batches:
        for lo, hi, data, offsets in pieces(batch, "text"):
            unit.append((batch, lo, hi, data, offsets))
            held += int(offsets[-1] - offsets[0])
            if held >= size:
                yield unit
                unit, held = [], 0
    if unit:
        yield unit


def _smallest(short: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of each ``width`` consecutive values, and where it stands (the first of equal ones)."""
    best, at = short[:n].copy(), np.arange(n)
    for j in range(1, width):
        less = np.flatnonzero(short[j : j + n] < best)
        best[less] = short[j : j + n][less]
        at[less] = less + j
    return best, at


def _by_row(rids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row hashes, run lengths and values grouped by row."""
    order = np.argsort(rids, kind="stable")
    rids, values = rids[order], values[order]
    begin = _runs(rids)
    return rids[begin], np.diff(np.append(begin, len(rids))), values


def _within(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


def _dealt(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _check(docs: np.ndarray) -> np.ndarray:
    return mix(docs.view(np.uint64)) & _LOW16


_NAMES = ["gid", "rid", "keys", "more", "n"]
_SCHEMA = "gid int, rid long, keys binary, more binary, n long"
#: Groups below zero: -1 how often an anchor is found, and from -2 on rows' own values that only pass through.
_COUNTS = -1


def _record(gid: np.ndarray, rid: np.ndarray, keys: pa.Array, more: pa.Array | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(gid, pa.int32()), pa.array(rid, pa.int64()), keys, pa.nulls(len(gid), pa.binary()) if more is None else more,
            pa.array(np.zeros(len(gid), np.int64) if n is None else n),
        ],
        names=_NAMES,
    )


def _told(rids: np.ndarray, values: np.ndarray, groups: int) -> pa.RecordBatch:
    """What a unit knows of its own rows; it passes through as many groups as there are others."""
    own, lengths, values = _by_row(rids, values)
    gid = -2 - (own.view(np.uint64) % np.uint64(groups)).astype(np.int64)
    return _record(gid, own, packed(values, lengths))


def _sent(keys: np.ndarray, others: list[np.ndarray], group: np.ndarray, groups: int) -> pa.RecordBatch:
    """A row for each group with its keys, and the other columns one after the other."""
    order = np.argsort(group, kind="stable")
    full, begin = np.unique(group[order], return_index=True)
    sizes = np.diff(np.append(begin, len(group)))
    keys, others = keys[order], [x[order] for x in others]
    more = [np.concatenate([x[b : b + s] for x in others]) for b, s in zip(begin, sizes)]
    more = packed(np.concatenate(more) if more else np.zeros(0, np.uint64), sizes * len(others))
    return _record(full, np.zeros(len(full), np.int64), packed(keys, sizes) if keys.dtype != object else _lines(keys, sizes), more)


def _lines(texts: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.cumsum(counts)
    return pa.array([b"\n".join(texts[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())], pa.binary())


class Partitioner:
    """Cuts texts into windows and deals them out; small and of bounded size, so it travels with the tasks."""

    def __init__(self, window: int, anchor: int, anchor_groups: int, unit: int):
        self.window, self.anchor = window, max(min(anchor, window), window - _MOST_WINDOWS + 1)
        self.anchor_groups, self.unit = anchor_groups, unit
        self.common = np.zeros(0, np.uint64)
        self.groups = 1

    def windows(self, data: np.ndarray, offsets: np.ndarray):
        """Words, their hashes, and of each window within a row its first word, anchor and the anchor's place."""
        words = Words(data, offsets, BLANK_BYTES)
        hashes = words.hashes()
        n = max(len(hashes) - self.window + 1, 0)
        first = np.flatnonzero(whole(words.counts, self.window))
        least, at = _smallest(grams(hashes, self.anchor), n, self.window - self.anchor + 1)
        return words, hashes, first, least[first] & _ANCHOR, at[first]

    def find_anchors(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors by group with a row that has them, and for rows those that other rows of the unit have too."""
        for unit in _units(batches, self.unit):
            keys, rows = [], []
            for batch, lo, hi, data, offsets in unit:
                words, _, first, least, _ = self.windows(data, offsets)
                row = words.rows()[first]
                if len(least):
                    new = np.ones(len(least), bool)
                    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                    keys.append(least[new])
                    rows.append(batch.column("rid").to_numpy()[lo:hi][row[new]])
            if not keys:
                continue
            keys, rows = np.concatenate(keys), np.concatenate(rows)
            order = np.lexsort((rows, keys))
            keys, rows = keys[order], rows[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
            keys, rows = keys[new], rows[new]
            begin = _runs(keys)
            times = np.diff(np.append(begin, len(keys)))
            many = np.repeat(times > 1, times)
            if many.any():
                yield _told(rows[many], keys[many], self.anchor_groups)
            power = np.minimum(np.floor(np.log2(times)), 15).astype(np.uint64)
            yield _sent(keys[begin] | power, [rows[begin].view(np.uint64)], _dealt(keys[begin], self.anchor_groups), self.anchor_groups)

    def segments(self, batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        """Texts of the wanted windows of some rows, with row, first word, windows and group of each."""
        wanted = b"".join(x for xs in batch.column("anchors")[lo:hi].to_pylist() for x in xs or ())
        wanted = np.unique(np.frombuffer(wanted, np.uint64))
        words, hashes, first, least, at = self.windows(data, offsets)
        use = np.flatnonzero(_within(least, wanted))
        if not len(use):
            return None
        first, least, at = first[use], least[use], at[use]
        common = _within(least, self.common)
        new = common.copy()
        new[:1] = True
        new[1:] |= (first[1:] != first[:-1] + 1) | (at[1:] != at[:-1]) | common[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(first)))
        key = np.where(common[begin], grams(hashes, self.window)[first[begin]], least[begin])
        begin = first[begin]
        joined, place = words.joined()
        joined = joined.tobytes()
        texts = [joined[a:b] for a, b in zip(place[begin].tolist(), (place[begin + size + self.window - 1] - 1).tolist())]
        row = words.rows()[begin]
        return texts, row, begin - words.first[row], size, _dealt(key, self.groups)

    def send_segments(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by group, and places of repeats that the unit itself shows."""
        for unit in _units(batches, self.unit):
            texts, parts = [], []
            for batch, lo, hi, data, offsets in unit:
                found = self.segments(batch, lo, hi, data, offsets)
                if found is None:
                    continue
                texts += found[0]
                row, position, size, group = found[1:]
                doc, rid = (batch.column(c).to_numpy()[lo:hi][row] for c in ("doc", "rid"))
                every = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
                place = (position.astype(np.uint64) << _POSITION) | (every << _WINDOWS) | _check(doc)
                parts.append((doc, rid, place, group))
            if not texts:
                continue
            doc, rid, place, group = (np.concatenate(x) for x in zip(*parts))
            coded = pa.array(texts, pa.binary()).dictionary_encode()
            code, texts = coded.indices.to_numpy(), np.array(coded.dictionary.to_pylist(), object)
            order = np.lexsort((place, rid, doc, code))
            code, doc, rid, place, group = (x[order] for x in (code, doc, rid, place, group))
            same, least = _first_documents(code, doc, rid)
            later = ~same & least
            if later.any():
                yield _told(rid[later], place[later], self.groups)
            keep = same & least
            columns = [x.view(np.uint64) for x in (doc[keep], rid[keep], place[keep])]
            yield _sent(texts[code[keep]], columns, group[keep], self.groups)
            trim()


def _first_documents(node: np.ndarray, doc: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in order: does it stand in its node's first document; is it the first of its row in the node?"""
    change = np.ones(len(node), bool)
    change[1:] = node[1:] != node[:-1]
    same = doc == doc[np.flatnonzero(change)][np.cumsum(change) - 1]
    least = np.ones(len(node), bool)
    least[1:] = change[1:] | (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])
    return same, least


def _gathered(table: pa.Table, width: int) -> list[np.ndarray]:
    """The other columns that ``_sent`` wrote, over all rows of a group."""
    more = [np.frombuffer(x, np.uint64).reshape(width, -1) for x in table.column("more").to_pylist()]
    return list(np.concatenate(more, axis=1))


_OUT = "gid int, rid long, keys binary, n long"


def _out(gid: int, rids: np.ndarray, values: np.ndarray) -> pa.Table:
    own, lengths, values = _by_row(rids, values)
    gids, n = pa.array(np.full(len(own), gid, np.int32)), pa.array(np.zeros(len(own), np.int64))
    return pa.table({"gid": gids, "rid": pa.array(own, pa.int64()), "keys": packed(values, lengths), "n": n})


def _merge_anchors(table: pa.Table) -> pa.Table:
    """Rows' anchors that stand in other rows too; as group _COUNTS, rows behind common anchors and (key 0) behind all."""
    gid = table.column("gid")[0].as_py()
    if gid < 0:
        return table.select(["gid", "rid", "keys", "n"])
    keys, (rids,) = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]), _gathered(table, 1)
    order = np.argsort(keys, kind="stable")
    keys, rids = keys[order], rids[order].view(np.int64)
    rows = np.uint64(1) << (keys & _ROWS_BITS)
    keys &= _ANCHOR
    begin = _runs(keys)
    times = np.diff(np.append(begin, len(keys)))
    several = rows > 1
    repeated = np.repeat((times > 1) | np.logical_or.reduceat(several, begin), times)
    total = np.add.reduceat(rows.astype(np.int64), begin)
    often = np.flatnonzero(total > _COMMON)
    counts = pa.table({
        "gid": pa.array(np.full(len(often) + 1, _COUNTS, np.int32)),
        "rid": pa.array(np.append(keys[begin][often].view(np.int64), 0)),
        "keys": pa.nulls(len(often) + 1, pa.binary()),
        "n": pa.array(np.append(total[often], rows[repeated].sum().astype(np.int64))),
    })
    told = repeated & ~several  # the others have been told by their units
    return pa.concat_tables([counts, _out(gid, rids[told], keys[told])])


class SuffixTree:
    """Suffixes of some segments (texts of words with one blank between), sorted by their first words: ``window`` at least."""

    def __init__(self, texts: list[bytes], window: int):
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        words = split.flatten().dictionary_encode()
        order = pc.array_sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        sizes = split.value_lengths().to_numpy().astype(np.int64)
        self.window = window
        self.ends = np.cumsum(sizes)
        self.segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        n = len(self.segment)
        self.left = (self.ends[self.segment] - np.arange(n)).astype(np.int32)
        # names[k]: the rank of each suffix's first k words among all; a suffix that ends before comes first.
        self.names = {1: rank[words.indices.to_numpy()]}
        k = 1
        while k < window:
            name = self.names[k]
            after = np.zeros(n, np.int64)
            after[: n - k] = name[k:]
            after[self.left <= k] = 0
            _, back = np.unique(name * (int(name.max(initial=0)) + np.int64(1)) + after, return_inverse=True)
            k *= 2
            self.names[k] = (back + 1).astype(np.int32)
        starts = np.flatnonzero(self.left >= window)
        self.suffixes = starts[np.argsort(self.names[k][starts], kind="stable")]

    def common(self) -> np.ndarray:
        """Words that each suffix shares with the one before it in order."""
        a, b = self.suffixes[:-1], self.suffixes[1:]
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        for k in sorted(self.names, reverse=True):
            fits = np.flatnonzero(out + k <= most)
            at = out[fits]
            out[fits[self.names[k][a[fits] + at] == self.names[k][b[fits] + at]]] += k
        return np.concatenate([[0], out])[: len(self.suffixes)]

    def deep_nodes(self) -> np.ndarray:
        """Where, among the sorted suffixes, each set that shares ``window`` words begins."""
        return np.flatnonzero(self.common() < self.window)


def _repeats(window: int):
    def run(table: pa.Table) -> pa.Table:
        """Places of one group's leaves that stand in later documents than their deep node's first."""
        gid = table.column("gid")[0].as_py()
        if gid < 0:
            return table.select(["gid", "rid", "keys", "n"])
        texts = b"\n".join(table.column("keys").to_pylist()).split(b"\n")
        doc, rid, place = _gathered(table, 3)
        tree = SuffixTree(texts, window)
        segment = tree.segment[tree.suffixes]
        begin = tree.deep_nodes()
        own = doc.view(np.int64)[segment]
        first = np.minimum.reduceat(own, begin)
        later = own > np.repeat(first, np.diff(np.append(begin, len(own))))
        at = tree.suffixes[later] - np.concatenate([[0], tree.ends[:-1]])[segment[later]]
        found = np.zeros(len(texts), np.uint64)
        np.bitwise_or.at(found, segment[later], np.uint64(1) << at.astype(np.uint64))
        hit = np.flatnonzero(found)
        place = (place[hit] >> _POSITION << _POSITION) | (found[hit] << _WINDOWS) | (place[hit] & _LOW16)
        trim()
        return _out(gid, rid[hit].view(np.int64), place)

    return run


def repeat_starts(
    docs: DataFrame, window: int = 13, anchor: int = 5, group_bytes: int = GROUP_BYTES, unit: int = UNIT
) -> DataFrame:
    """rid, starts: where windows begin that also start in a document with a smaller id.

    ``starts`` is an array of binaries of places (see ``_POSITION``). A segment that a text
    repeats is given by its first place there. ``docs`` has the columns rid, doc, text.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Partitioner(window, anchor, int(size) // (64 << 20) + 16, unit)
    found = docs.select("rid", "text").mapInArrow(plan.find_anchors, _SCHEMA)
    found = settle(found.groupBy("gid").applyInArrow(_merge_anchors, _OUT))
    counts = found.filter(F.col("gid") == _COUNTS)
    total = int(counts.filter("rid = 0").agg(F.sum("n")).first()[0] or 0)
    # Fewer than _SHARE numbers, whatever the input's size.
    common = counts.filter("rid <> 0").filter(F.col("n") > max(_COMMON, total // _SHARE)).select("rid").collect()
    plan.common = np.sort(np.array([r[0] for r in common], np.int64).view(np.uint64))
    plan.groups = max(_LEAST_GROUPS, total * _SEGMENT_BYTES // group_bytes + 1)
    anchors = found.filter(F.col("gid") != _COUNTS).groupBy("rid").agg(F.collect_list("keys").alias("anchors"))
    # All columns of docs, so that one exchange of the texts serves this join and a later one.
    rows = docs.join(anchors, "rid").select(*docs.columns, "anchors")
    sent = rows.mapInArrow(plan.send_segments, _SCHEMA)
    starts = sent.groupBy("gid").applyInArrow(_repeats(window), _OUT)
    return starts.groupBy("rid").agg(F.collect_list("keys").alias("starts"))


def _starts(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (from 0) and word positions at which windows begin that are known to repeat."""
    lists = [b"".join(x) if x else b"" for x in batch.column("starts")[lo:hi].to_pylist()]
    row = np.repeat(np.arange(hi - lo), [len(x) // 8 for x in lists])
    places = np.frombuffer(b"".join(lists), np.uint64)
    own = (places & _LOW16) == _check(batch.column("doc").to_numpy()[lo:hi])[row]
    row, places = row[own], places[own]
    at = (places >> _POSITION).astype(np.int64)
    bits = places >> _WINDOWS & _LOW16
    found = [np.flatnonzero(bits >> np.uint64(k) & np.uint64(1)) for k in range(_MOST_WINDOWS)]
    return np.concatenate([row[f] for f in found]), np.concatenate([at[f] + k for k, f in enumerate(found)])


def _equal_windows(words: Words, text: np.ndarray, cuts: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
    """All windows that have the same words as one of those at ``begin`` in their row."""
    row = words.rows()
    keys = grams(words.hashes(), window)
    keys ^= mix(row[: len(keys)].astype(np.uint64))
    begin = begin[np.argsort(keys[begin], kind="stable")]
    found = np.flatnonzero(whole(words.counts, window) & _within(keys, keys[begin]))
    like = begin[np.searchsorted(keys[begin], keys[found])]
    # Names of words: two are the same if the words are.
    names = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(text)]).dictionary_encode().indices.to_numpy()
    same = row[found] == row[like]
    for j in range(window):
        same &= names[found + j] == names[like + j]
    return np.union1d(found[same], begin)


def _without_repeats(batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, window: int) -> list[pa.Array]:
    """Of some rows: the words that stay, how many there were, how many went, and the runs of those that went."""
    words = Words(data, offsets, BLANK_BYTES)
    text, cuts = words.joined()
    row, position = _starts(batch, lo, hi)
    whole_there = position + window <= words.counts[row]
    begin = np.unique((words.first[row] + position)[whole_there])
    n = len(words.starts)
    gone = np.zeros(n, bool)
    if len(begin):
        begin = _equal_windows(words, text, cuts, begin, window)
        depth = np.zeros(n + 1, np.int64)
        depth[begin] += 1
        depth[begin + window] -= 1
        gone = np.cumsum(depth[:-1]) > 0
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
    # Kept words, each with a blank behind it but the last one of its row.
    sizes = np.where(gone, 0, np.diff(cuts))
    ends = np.concatenate([[0], np.cumsum(sizes)])[words.first]
    text = text[np.repeat(~gone, np.diff(cuts))]
    some = np.diff(ends) > 0
    inside = np.ones(len(text), bool)
    inside[ends[1:][some] - 1] = False
    ends -= np.concatenate([[0], np.cumsum(some)])
    kept = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text[inside])])
    # Runs of words that went, within a row.
    opens, closes = gone.copy(), gone.copy()
    opens[1:] &= ~gone[:-1]
    closes[:-1] &= ~gone[1:]
    edge = words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < n)]
    opens[edge] |= gone[edge]
    closes[edge - 1] |= gone[edge - 1]
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
    own = words.rows()[opens]
    spans = pa.StructArray.from_arrays([pa.array(opens - words.first[own]), pa.array(closes + 1 - opens)], names=["start", "words"])
    runs = np.searchsorted(own, np.arange(hi - lo + 1)).astype(np.int32)
    return [kept.cast(pa.string()), pa.array(words.counts.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.ListArray.from_arrays(pa.array(runs), spans)]


def _kept(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch, "text"):
                columns = _without_repeats(batch, lo, hi, data, offsets, window)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *columns], names=["doc_id", "text", "n_words", "n_removed", "repeats"])

    return run


def substring_dedup(
    docs: DataFrame, window: int = 13, anchor: int = 5, group_bytes: int = GROUP_BYTES, unit: int = UNIT
) -> DataFrame:
    """For each row: doc_id, text (kept words, one space between them), n_words, n_removed, repeats.

    ``repeats`` are the maximal runs of words that went: their first word and their number.
    """
    text = text_or_empty(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("rid"), "text"
    )
    starts = repeat_starts(rows, window, anchor, group_bytes, unit)
    out = rows.join(starts, "rid", "left")
    out = out.select("doc_id", "rid", "doc", "text", "starts")
    schema = "doc_id long, text string, n_words long, n_removed long, repeats array<struct<start: long, words: long>>"
    return out.mapInArrow(_kept(window), schema)


def removed_by_force(docs: dict[int, str], window: int = 13) -> dict[int, list[str]]:
    """Kept words by id, from all windows in one dictionary; for tests."""
    split = {i: (t or "").encode().split() for i, t in docs.items()}
    first: dict[tuple, int] = {}
    for i in sorted(split):
        for j in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][j : j + window]), i)
    out = {}
    for i, words in split.items():
        gone = set()
        for j in range(len(words) - window + 1):
            if first[tuple(words[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = [w.decode() for j, w in enumerate(words) if j not in gone]
    return out


def sha256_of(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
