"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PIECE_BYTES = 8 << 20
PIECE_ROWS = 500


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a worker's own arrays stay small, whatever the session's batch limits are.

    A piece has at most ``PIECE_ROWS`` rows and ``most`` (else ``PIECE_BYTES``) bytes of a text or binary column, or is
    one row.
    """
    most = PIECE_BYTES if most is None else most
    for batch in batches:
        total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(total, total[first] + most, side="right")) - 1
            last = min(max(first + 1, last), first + PIECE_ROWS)
            yield batch.slice(first, last - first)
            first = last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def salted_hash(*cols: Column) -> Column:
    """The first 52 bits of an MD5 digest as a long: a hash that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("long")


def join_one(many: DataFrame, one: DataFrame, key: str, rows: int, share: int = 1000) -> DataFrame:
    """Rows of ``many`` with the row of ``one`` that has their key; ``one.weight`` tells how many of the ``rows`` rows have it.

    A key may hold any share of the rows: keys with over a ``share``-th of them, of which there are fewer than
    ``share``, are joined by broadcast; the others meet by shuffling. Keys aren't null; each is in ``one`` once.
    """
    least = rows // share
    hot = F.broadcast(one.where(F.col("weight") > least).drop("weight"))
    rest = many.join(hot.select(key), key, "left_anti").join(one.where(F.col("weight") <= least).drop("weight"), key)
    return many.join(hot, key).unionByName(rest)
