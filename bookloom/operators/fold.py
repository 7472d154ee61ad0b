"""Ordered per-key folds: plain Python state machines under thin batch and stream adapters.

A fold is a class with ``step(event) -> iterable of rows`` and ``dump()``/``load(state)``.
``event`` is a tuple in the order of ``schema.EVENT``; ``finish()`` gives what is left to
say when a batch has no more events of the key (a stream never ends). In batch, rows are dealt by
instrument, sorted by sequence inside each partition and streamed through the fold in
Arrow batches: a task holds one instrument's state, never its events.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bookloom.schema import EVENT_COLUMNS

_ROWS = 20_000


class Fold:
    """Base of the folds: the state is the instance's dictionary."""

    def step(self, event: tuple) -> Iterable[tuple]:
        raise NotImplementedError

    def finish(self) -> Iterable[tuple]:
        return ()

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__)

    def load(self, state: bytes) -> Fold:
        self.__dict__.update(pickle.loads(state))
        return self


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def run(events: DataFrame, make: Callable[[], Fold], schema: T.StructType, key: str = "instrument_id", columns: list[str] | None = None) -> DataFrame:
    """Rows of ``schema`` from one fold for each key; the key must be among ``columns``, and "seq" too."""
    columns = columns or EVENT_COLUMNS
    at = columns.index(key)
    arrow = to_arrow_schema(schema)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Any = object()
        fold: Fold | None = None
        out: list[tuple] = []
        for batch in batches:
            for event in zip(*(c.to_pylist() for c in batch.columns)):
                if event[at] != current:
                    if fold is not None:
                        out.extend(fold.finish())
                    current, fold = event[at], make()
                out.extend(fold.step(event))
            if len(out) >= _ROWS:
                yield _record(out, arrow)
                out = []
        if fold is not None:
            out.extend(fold.finish())
        if out:
            yield _record(out, arrow)

    dealt = events.select(*columns).repartition(_parts(events.sparkSession), key).sortWithinPartitions(key, "seq")
    return dealt.mapInArrow(stream, schema)


def _parts(spark: SparkSession) -> int:
    """Several partitions a core, so that keys that fall together by hash leave few cores idle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def replay(events: Iterable[tuple], fold: Fold) -> list[tuple]:
    """All rows of one fold over events in order, but for its last words; for tests and small inputs."""
    return [row for event in events for row in fold.step(event)]
