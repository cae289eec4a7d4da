"""Operators whose state is carried from one row of a key to the next: one mechanism for batches and streams.

A ``Fold`` says what a key starts with and what a row does to it. ``carried`` runs it over a table: the rows of a key come
sorted into one task, which reads them as they come and holds one batch and one key's state, never a key's rows.
``spectraloom.streaming.carried`` runs the same fold over a stream, with rows held until the watermark has passed them, so both
give the same rows. A fold's state is made of lists, dicts, texts, numbers and truth values only.

A key is one sequence: what feeds back can't be cut, so the longest key bounds the time, not the memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spectraloom.sources.shared import spread

Row = tuple[Any, ...]


class Fold(Protocol):
    """``rows`` of one key, in order, change ``state`` in place and give results; ``end`` gives what is due at the end."""

    def start(self) -> Any: ...

    def step(self, state: Any, row: Row) -> Iterable[Row]: ...

    def end(self, state: Any) -> Iterable[Row]: ...


def schema_of(df: DataFrame, keys: list[str], result: str) -> StructType:
    """The keys' columns of ``df`` and those of ``result``."""
    out = StructType([df.schema[k] for k in keys])
    for f in StructType.fromDDL(result):
        out.add(f)
    return out


def to_batch(rows: list[Row], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def scan(fold: Fold, keys: int, schema: pa.Schema, most: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds rows that come sorted; the first ``keys`` columns are the key. Results leave by ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != key:
                    if key is not None:
                        out += [(*key, *r) for r in fold.end(state)]
                    key, state = row[:keys], fold.start()
                out += [(*key, *r) for r in fold.step(state, row[keys:])]
                if len(out) >= most:
                    yield to_batch(out, schema)
                    out = []
        if key is not None:
            out += [(*key, *r) for r in fold.end(state)]
        if out:
            yield to_batch(out, schema)

    return run


def carried(df: DataFrame, keys: list[str], columns: list[str], fold: Fold, result: str, order: list[str] | None = None) -> DataFrame:
    """keys and ``result``: ``fold`` over the ``columns`` of each key's rows, in the order of ``order``, else of ``columns``.

    Null keys are one key; nulls of the order come first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema_of(df, keys, result)
    by = [F.asc_nulls_first(c) for c in [*keys, *(order or columns)]]
    return spread(df.select(*keys, *columns), *keys).sortWithinPartitions(*by).mapInArrow(scan(fold, len(keys), to_arrow_schema(schema)), schema)
