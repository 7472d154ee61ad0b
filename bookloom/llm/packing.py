"""Hierarchical packing of documents into sequences of several context sizes.

A document's tokens are its ids by the tokenizer and an end id. What fills whole
windows of the longest size is cut off at once; the rest is routed to the smallest
tier (a power of two) that holds it. Each tier opens a window for each of its pieces,
and fills the window's gap from the next shorter tiers, cutting the last filler to
size. The shortest tier runs its pieces together. Windows are therefore full, and
what a task has left at its end is cut into powers of two, so nothing is padded.

Step groups balance training steps: each holds windows of one size and ``group_tokens``
tokens, over all tasks; only the last group of a size is smaller.

Every task packs its own input partition in one pass with a bounded buffer and no
shuffle of texts, so hot sources or long texts change nothing. Sequence ids hold the
task's number; the rows are settled, so they are the same for all who read them. Then
each task's windows of a size are numbered after those of the tasks before it.

Cases: a null or empty text is its end id alone; null and repeated ids are carried
along; other columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookloom.llm.chunk_tokens import ChunkTokenizer
from bookloom.llm.common import settle, text_or_empty
from bookloom.llm.textkit import pieces

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " tier int, task long, nth long"
)
_FIELDS = [f.split()[0] for f in SCHEMA.split(",")]


class Packer:
    """Packs a stream of documents; rows come out of ``add`` and ``end``."""

    def __init__(self, longest: int, shortest: int, task: int, hold: int = 1 << 20):
        self.tiers = []
        while longest >= shortest:
            self.tiers.append(longest)
            longest //= 2
        self.queues: dict[int, deque] = {t: deque() for t in self.tiers}
        self.task, self.next_id, self.hold = task, task << 40, hold
        self.filled: dict[int, int] = {}
        self.held = 0
        self.rows: list[tuple] = []

    def _route(self, piece: tuple) -> None:
        length = piece[3]
        self.queues[next(t for t in reversed(self.tiers) if t >= length)].append(piece)

    def _window(self, pieces: list[tuple], size: int) -> None:
        """Write one sequence. A piece: doc_id, its bytes, start, length, tokens."""
        nth = self.filled.get(size, 0)
        self.filled[size] = nth + 1
        offset = 0
        for doc_id, ids, start, length, tokens in pieces:
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            self.rows.append((doc_id, start, length, crc, tokens, self.next_id, offset, size, self.task, nth))
            offset += length
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, start, top = len(ids) // 4, 0, self.tiers[0]
        while tokens - start >= top:
            self._window([(doc_id, ids, start, top, tokens)], top)
            start += top
        if tokens > start:
            self._route((doc_id, ids, start, tokens - start, tokens))
            self.held += tokens - start
        if self.held >= self.hold:
            self._flush()

    def _flush(self) -> None:
        """Fill windows tier by tier from the longest, while shorter pieces are there to fill their gaps."""
        for at, size in enumerate(self.tiers):
            queue = self.queues[size]
            while queue:
                window, room = [], size
                piece = queue.popleft()
                while True:
                    if piece[3] > room:
                        doc_id, ids, start, length, tokens = piece
                        window.append((doc_id, ids, start, room, tokens))
                        self._route((doc_id, ids, start + room, length - room, tokens))
                        room = 0
                    else:
                        window.append(piece)
                        room -= piece[3]
                    if not room:
                        break
                    piece = self._filler(at, room)
                    if piece is None:
                        break
                if room:  # nothing shorter is left; later documents may bring it
                    queue.extendleft(reversed(window))
                    break
                self._window(window, size)
        self.held = sum(p[3] for q in self.queues.values() for p in q)
        if self.held >= self.hold // 2:
            self._close()

    def _filler(self, at: int, room: int) -> tuple | None:
        """The first piece of the longest shorter tier that fits, else of any shorter tier, else of the same one."""
        fits = [t for t in self.tiers[at + 1 :] if t <= room]
        rest = [t for t in self.tiers[at + 1 :] if t > room]
        for t in [*fits, *reversed(rest), self.tiers[at]] if at + 1 == len(self.tiers) else [*fits, *reversed(rest)]:
            if self.queues[t]:
                return self.queues[t].popleft()
        return None

    def _close(self) -> None:
        """Run all pieces together in windows of the longest size, and cut the rest into powers of two."""
        pieces = deque(p for t in self.tiers for p in self.queues[t])
        for q in self.queues.values():
            q.clear()
        left = sum(p[3] for p in pieces)
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            left -= size
            window, room = [], size
            while room:
                doc_id, ids, start, length, tokens = pieces.popleft()
                take = min(length, room)
                window.append((doc_id, ids, start, take, tokens))
                if take < length:
                    pieces.appendleft((doc_id, ids, start + take, length - take, tokens))
                room -= take
            self._window(window, size)
        self.held = 0

    def end(self) -> None:
        self._flush()
        self._close()

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32() if f == "tier" else pa.int64() for f in _FIELDS]
    data = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types)], names=_FIELDS)


def pack_stream(batches: Iterable[pa.RecordBatch], packer: Packer, tokenizer: ChunkTokenizer, end_id: int) -> Iterator[pa.RecordBatch]:
    end = end_id.to_bytes(4, "little")
    for batch in batches:
        for lo, hi, data, offsets in pieces(batch, "text", 1 << 20):
            ids, begin = tokenizer.encode_slice(data, offsets)
            raw = ids.astype("<u4").tobytes()
            begin = (4 * begin).tolist()
            for k, doc_id in enumerate(batch.column(0)[lo:hi].to_pylist()):
                packer.add(doc_id, raw[begin[k] : begin[k + 1]] + end)
            if len(packer.rows) >= 20_000:
                yield _record(packer.take())
    packer.end()
    yield _record(packer.take())


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    longest: int = 2048,
    shortest: int = 128,
    end_id: int = 1,
    group_tokens: int = 1 << 16,
) -> DataFrame:
    """One row for each piece of a document; see the module for the columns' meaning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        packer = Packer(longest, shortest, task)
        yield from pack_stream(batches, packer, _tokenizer(tokenizer_path), end_id)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return _grouped(settle(rows.mapInArrow(run, SCHEMA)), group_tokens)


def _grouped(rows: DataFrame, group_tokens: int) -> DataFrame:
    """``rows`` with step_group instead of task and nth: windows of one size in equal groups over all tasks."""
    counts = rows.groupBy("tier", "task").agg((F.max("nth") + 1).alias("_n"))
    # One row for each task and size.
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tier", "task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.floor((F.col("_before") + F.col("nth")) * F.col("tier") / group_tokens)
    group = F.col("tier") * F.lit(1 << 40) + place
    return rows.join(counts, ["tier", "task"]).select(*_FIELDS[:-3], "tier", group.cast("long").alias("step_group"))
