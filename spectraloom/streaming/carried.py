"""Folds of ``spectraloom.operators.carried`` over streams.

Rows are held until the watermark has passed them, then go through the fold in order, so the result doesn't depend on how rows fall
into files and batches. Rows later than the watermark allows are dropped by Spark. Keys are dealt to ``GROUPS`` groups: a group holds
its rows in packs (Arrow) and has one timer at the oldest, so a call to the state store serves many keys and rows; each key's state
is an entry of its own, read and written only when the key has rows that are due.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from spectraloom.operators.carried import Fold, Row, schema_of
from spectraloom.sources.shared import scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys, a fixed number as they are part of a stream's state; and the most rows of a pack or of a frame given.
GROUPS = 4096
PACK = 10_000


def _order(row: Row) -> tuple:
    """Rows by their columns, nulls first."""
    return tuple((x is not None, x) for x in row)


def _packed(rows: pa.Table) -> list[tuple[bytes]]:
    """Rows as Arrow streams of at most ``PACK`` rows."""
    out = []
    for batch in rows.combine_chunks().to_batches(max_chunksize=PACK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


class Carried(StatefulProcessor):
    """Holds rows (their time in microseconds, then keys and columns) and folds those that the watermark has passed."""

    def __init__(self, fold: Fold, names: list[str], held: StructType, keys: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.fold, self.names, self.keys = fold, names, keys
        self.key_schema, self.schema = StructType(held.fields[1 : keys + 1]), to_arrow_schema(held)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", self.key_schema, "json string")
        self.held = handle.getListState("held", "pack binary")

    def _wake(self, rows: pa.Table) -> None:
        if len(rows):
            self.handle.registerTimer(pc.min(rows.column(0)).as_py() // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables(pa.Table.from_pandas(frame[self.schema.names], self.schema, preserve_index=False) for frame in rows)
        self.held.appendList(_packed(new))
        self._wake(new)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        packs = [_unpacked(bytes(pack)) for (pack,) in self.held.get()]
        if not packs:
            return
        rows = pa.concat_tables(packs)
        passed = pc.less(rows.column(0), timerValues.getCurrentWatermarkInMs() * 1000)
        due, rest = rows.filter(passed), rows.filter(pc.invert(passed))
        if not len(due):
            return
        if len(rest):
            self.held.put(_packed(rest))
        else:
            self.held.clear()
        self._wake(rest)
        out: list[Row] = []
        at = state = None
        for row in sorted(zip(*(c.to_pylist() for c in due.columns[1:]), strict=True), key=_order):
            if row[: self.keys] != at:
                self._keep(at, state)
                at = row[: self.keys]
                before = self.state.getValue(at)
                state = self.fold.start() if before is None else json.loads(before[0])
            out += [(*at, *r) for r in self.fold.step(state, row[self.keys :])]
            if len(out) >= PACK:
                yield self._frame(out)
                out = []
        self._keep(at, state)
        if out:
            yield self._frame(out)

    def _keep(self, at: Row | None, state) -> None:
        if at is not None:
            self.state.updateValue(at, (json.dumps(state),))

    def _frame(self, out: list[Row]) -> pd.DataFrame:
        return pd.DataFrame([[*r] for r in out], columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def carried_stream(stream: DataFrame, keys: list[str], columns: list[str], fold: Fold, result: str, ts: str, late: str) -> DataFrame:
    """The stream of keys and ``result``. ``columns`` order a key's rows, as the event time ``ts`` does."""
    spark = stream.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        raise ValueError(f"state of this kind needs {_PROVIDER}={_ROCKS}")
    schema = schema_of(stream, keys, result)
    held = _held(stream, keys, columns)
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("held_group")
    rows = stream.withWatermark(ts, late).select(group, F.unix_micros(ts).alias("held_us"), *keys, *columns, F.col(ts).alias("held_ts"))
    return rows.groupBy("held_group").transformWithStateInPandas(Carried(fold, schema.names, held, len(keys)), schema, "append", "EventTime")


def _held(stream: DataFrame, keys: list[str], columns: list[str]) -> StructType:
    return StructType([StructField("held_us", LongType()), *(StructField(c, stream.schema[c].dataType) for c in [*keys, *columns])])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column(0).to_pylist():
            yield from _unpacked(pack).to_batches()


def drained_carried(stream: DataFrame, name: str, keys: list[str], columns: list[str], fold: Fold, result: str, ts: str, late: str) -> DataFrame:
    """All rows of a finite stream: what it gave, and then, from its last state, what its held rows and the fold's end give."""
    spark = stream.sparkSession
    at = scratch(spark, f"stream-{name}")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        out = carried_stream(stream, keys, columns, fold, result, ts, late)
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        left = lambda var: spark.read.format("statestore").option("path", f"{at}/state").option("stateVarName", var).load()
        state = left("state").select("user_map_key.*", F.col("user_map_value.json").alias("__state"))
        held = left("held").select("list_element.pack").mapInArrow(_unpack, _held(stream, keys, columns))
        rest = _finished(state, held, keys, columns, fold, out.schema)
        return spark.read.schema(out.schema).parquet(f"{at}/out").unionByName(rest)
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Resumed:
    """A fold whose key may begin with a row that has its state."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def start(self) -> dict:
        return {"state": self.fold.start()}

    def step(self, state: dict, row: Row):
        held, before, *rest = row
        if not held:
            state["state"] = json.loads(before)
            return ()
        return self.fold.step(state["state"], tuple(rest))

    def end(self, state: dict):
        return self.fold.end(state["state"])


def _finished(state: DataFrame, held: DataFrame, keys: list[str], columns: list[str], fold: Fold, schema: StructType) -> DataFrame:
    from spectraloom.operators.carried import carried

    rows = state.unionByName(held.select(*keys, *columns, F.lit(None).cast("string").alias("__state")), allowMissingColumns=True)
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[len(keys) :])
    rows = rows.withColumn("__held", F.col("__state").isNull())
    return carried(rows, keys, ["__held", "__state", *columns], _Resumed(fold), result, ["__held", *columns])
