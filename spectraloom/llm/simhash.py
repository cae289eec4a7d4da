"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile by tile.

A fingerprint's bit is set if over half of the hashes of a text's word shingles have it. Equal fingerprints become one node
first, so copies, however many, are compared once. Nodes are dealt to tiles by their population counts; two fingerprints
within the radius differ by no more than it in those counts, so a tile meets only the tiles whose counts are that near, and
all other pairs of tiles are skipped. A pair of tiles is one task: exclusive-or and bit counts of numpy arrays, strip by strip,
where a strip again skips the fingerprints whose counts of 16-bit words are too far from its own. A pair of tiles gives
a spanning forest of its links, never the links themselves, so a group of near copies costs edges in proportion to its size.

The counts are taken of 1, 2, 4 or 8 equal parts of the fingerprint (``parts_for``): the finer, the more pairs are skipped
and the more often a tile is sent. Any choice gives the same result. All the same the comparison grows with the square of the distinct
fingerprints; how steeply is a matter of the parts.

Defined results: a null text, or one without words, has fingerprint zero and is linked like any other; fewer words than a
shingle's make one shingle; a null id takes part, and a component's id is its least id that isn't null; repeated rows
stay; extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import join_one, pieces, table
from spectraloom.llm.textwords import FOLD, SPACED
from spectraloom.operators.graph import connected_components
from spectraloom.sources.shared import Steps, written

RADIUS = 4
WORDS = 4
SEED = 42
TILE = 1 << 15  # fingerprints
STRIP = 64
SHINGLES = 1 << 16  # whose bits are added up at a time
#: How many population-count classes of 1, 2, 4 and 8 parts hold most of the fingerprints.
CLASSES = {1: 16, 2: 200, 4: 4_000, 8: 400_000}


def _spans(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch, lower-cased with one space behind each, in one buffer; their starts, ends and rows."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
    _, where, held = ended.buffers()
    offsets = np.frombuffer(where, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]
    part = SPACED[data]
    after = np.zeros(len(data), bool)
    after[1:] = part[:-1]
    kept = part | after  # a word's bytes and the space behind it
    first, last = np.flatnonzero(part & ~after), np.flatnonzero(after & ~part)
    place = np.cumsum(kept) - 1
    row = np.searchsorted(offsets - offsets[0], first, side="right") - 1
    return np.where(part, FOLD[data], np.uint8(32))[kept].tobytes(), place[first], place[last], row


def fingerprints(texts: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit number."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    if not n:
        return np.empty(0, np.uint64)
    data, start, end, row = _spans(texts)
    counts = np.bincount(row, minlength=n)
    head = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(max(0, len(row) - words + 1))
    at = at[row[at] == row[at + words - 1]]
    short = np.flatnonzero((counts > 0) & (counts < words))  # the whole sequence is one shingle
    start, end, row = np.concatenate([start[at], start[head[short]]]), np.concatenate([end[at + words - 1], end[head[short] + counts[short] - 1]]), np.concatenate([row[at], short])
    of = xxhash.xxh64_intdigest
    for k in range(0, len(row), SHINGLES):
        h = np.array([of(data[a:b], seed) for a, b in zip(start[k : k + SHINGLES].tolist(), end[k : k + SHINGLES].tolist(), strict=True)], "<u8")
        own = row[k : k + SHINGLES]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(ones, own[cut], np.add.reduceat(bits, cut, axis=0, dtype=np.int64))
    np.add.at(total, row, 1)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = fingerprints(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])


def parts_for(n: int, tile: int = TILE) -> int:
    """The most parts whose classes are still expected to fill a tile each."""
    return max([p for p, classes in CLASSES.items() if n >= classes * tile], default=1)


def near_offsets(parts: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Differences of population counts, part by part, that sum up to the radius at most."""
    if parts == 1:
        return [(d,) for d in range(-radius, radius + 1)]
    half = near_offsets(parts // 2, radius)
    return [a + b for a, b in product(half, half) if sum(map(abs, a + b)) <= radius]


def part_counts(c: Column, parts: int) -> Column:
    """The population counts of the equal parts of a long, as one number in base 128."""
    width = 64 // parts
    one = lambda k: F.bit_count(F.shiftrightunsigned(c, k * width).bitwiseAND(F.lit((1 << width) - 1 if parts > 1 else -1)))
    out = one(0).cast("long")
    for k in range(1, parts):
        out = out * 128 + one(k)
    return out


def _numbers(offsets: list[tuple[int, ...]]) -> list[int]:
    """Each offset as what it adds to a number in base 128."""
    out = []
    for offset in offsets:
        x = 0
        for d in offset:
            x = x * 128 + d
        out.append(x)
    return out


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (of each node, the least node of its group) after the links i-j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def link_tiles(x: np.ndarray, y: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one, as two arrays of fingerprints."""
    words = lambda v: np.bitwise_count(v.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    ordered = lambda v: v[np.lexsort(words(v).T[::-1])]
    x = ordered(x)
    nodes = x if y is None else np.concatenate([x, ordered(y)])
    other, base = (x, 0) if y is None else (nodes[len(x) :], len(x))
    count, own = np.ascontiguousarray(words(other).T), words(x)
    label = np.arange(len(nodes))
    for k in range(0, len(x), STRIP):
        low, high = own[k : k + STRIP].min(axis=0), own[k : k + STRIP].max(axis=0)
        first = k if y is None else 0  # within one tile each pair is met once
        gap = np.zeros(len(other) - first, np.int16)
        for part in range(4):
            c = count[part, first:]
            gap += np.maximum(low[part] - c, 0) + np.maximum(c - high[part], 0)
        near = np.flatnonzero(gap <= radius) + first
        i, j = np.nonzero(np.bitwise_count(x[k : k + STRIP, None] ^ other[None, near]) <= radius)
        if len(i):
            label = merge(label, i + k, near[j] + base)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def compare(pair: pa.Table) -> pa.Table:
        held = [np.array(r.values.to_numpy()).view(np.uint64) for r in pair.column("nodes")]
        a, b = link_tiles(held[0], held[1] if len(held) > 1 else None, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return compare


def links(nodes: DataFrame, n: int, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """a, b: edges that join the ``n`` distinct longs of ``nodes`` as all pairs within ``radius`` differing bits would."""
    parts = parts or parts_for(n, tile)
    keyed = nodes.select("fingerprint", part_counts(F.col("fingerprint"), parts).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("cuts"))
    few = F.broadcast(sizes) if parts <= 4 else sizes  # 17 ** 4 classes at most; one of 8 parts holds a few of 100,000 rows
    dealt = keyed.join(few, "key").withColumn("cut", F.pmod(F.xxhash64("fingerprint"), F.col("cuts")))
    tiles = dealt.groupBy("key", "cut").agg(F.collect_list("fingerprint").alias("nodes"))  # about `tile` of them
    near = F.array(*[F.lit(x).cast("long") for x in _numbers(near_offsets(parts, radius))])
    meets = sizes.select(F.col("key").alias("other"), "cuts").withColumn("key", F.explode(F.transform(near, lambda x: x + F.col("other"))))
    meets = meets.join(sizes.select("key"), "key").withColumn("other_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    own, others = F.struct("key", "cut"), F.struct(F.col("other").alias("key"), F.col("other_cut").alias("cut"))
    sent = tiles.join(meets.drop("cuts"), "key").select(F.least(own, others).alias("low"), F.greatest(own, others).alias("high"), "nodes")
    tasks = min(4096, max(3 * nodes.sparkSession.sparkContext.defaultParallelism, n // tile))
    return sent.repartition(tasks, "low", "high").groupBy("low", "high").applyInArrow(_compare(radius), "a long, b long")


def components(docs: DataFrame, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (a long), component_id for each row of ``docs`` (doc_id, text)."""
    steps = Steps(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = written(docs.select("doc_id", "text").mapInArrow(_fingerprint, f"doc_id {kind}, fingerprint long"), "fingerprints")
    classes = steps.written(each.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")), "classes")
    n, rows = classes.agg(F.count("*"), F.sum("rows")).first()
    root = connected_components(links(classes.select("fingerprint"), n, radius, parts, tile))
    linked = steps.written(classes.join(root, F.col("fingerprint") == F.col("node")).select("fingerprint", "root", "least_id", "rows"), "linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("weight"))
    found = join_one(linked, least, "root", n).select("fingerprint", "component_id", "rows")
    alone = classes.join(linked.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", F.col("least_id").alias("component_id"), "rows")
    found = written(found.unionByName(alone).withColumnRenamed("rows", "weight"), "components")
    steps.drop()
    return join_one(each, found, "fingerprint", rows or 0).select("doc_id", "fingerprint", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
