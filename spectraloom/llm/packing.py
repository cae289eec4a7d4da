"""Packing by power-of-two decomposition.

A document of n tokens (its ids and one closing id) is cut into whole sequences of ``LONGEST`` and then into the binary
parts of what is left, longest first. Each piece is a sequence of its own, so no sequence crosses documents and none
is padded; sequences of one length form a bucket from which batches of one shape are drawn. ``sequence_id`` is the
sequence's gapless number in its bucket times ``BUCKETS`` plus the bucket, the binary logarithm of the length.

Numbering takes one shuffle of the pieces' narrow columns, by ranges of a hash within a bucket (``sharding.number``), so no
task holds a bucket.

Defined results: a null or empty text is the closing id alone; equal rows give equal pieces in sequences of their own;
a null doc_id stays; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import pieces, table
from spectraloom.llm.sharding import number
from spectraloom.llm.tokens import Encoder, vocabulary_path
from spectraloom.sources.shared import written

LONGEST = 2048
CLOSING_ID = 1
BUCKETS = LONGEST.bit_length()


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """``n`` as whole ``longest`` (a power of two) and then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (unsigned 32-bit numbers) of every piece."""
    path, kind = path or vocabulary_path(), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = Encoder(path), CLOSING_ID.to_bytes(4, "little")
        for batch in pieces(batches):
            row, start, length, crc, total, held = [], [], [], [], [], []
            for d, ids in enumerate(encoder.ids(batch.column("text").to_pylist())):
                ids += closing
                at, n = 0, len(ids) // 4
                for size in binary_lengths(n):
                    piece = ids[4 * at : 4 * (at + size)]
                    row.append(d), start.append(at), length.append(size), crc.append(zlib.crc32(piece)), total.append(n)
                    if keep_ids:
                        held.append(piece)
                    at += size
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(np.array(c, np.int64)) for c in (start, length, crc, total)), *([pa.array(held, pa.binary())] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """The pieces of ``docs`` with their sequence_id and their offset in it, which is 0."""
    pieces = written(cut_documents(docs, path, keep_ids), "pieces")
    keyed = pieces.withColumn("piece", F.concat_ws(":", "doc_id", "start", "ids_crc32"))
    numbered = number(keyed, "length", "piece", ["doc_tokens"], "slot").drop("piece")
    bucket = F.round(F.log2("length")).cast("long")
    out = numbered.withColumn("sequence_id", F.col("slot") * BUCKETS + bucket).withColumn("offset", F.lit(0).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
