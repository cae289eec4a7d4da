"""Exact Jaccard join of documents' word 5-grams with token-combination prefixes, and its connected components.

1. Every text becomes a set of 64-bit shingle hashes. Documents with equal sets form a class; classes take part once.
2. A sketch of 2**20 to 2**28 cells, by the number of documents, counts the classes that hold a shingle. A shingle whose
   cell holds more than a threshold is *frequent*, any other *rare*. The sketch never counts too little, so a rare
   shingle is in fewer classes than the threshold; counting too much only makes a rare one frequent, which costs time
   and loses nothing.
3. In every set rare shingles come first, each class by hash. Two sets with similarity t share k of their first
   ``n - ceil(t n) + k`` shingles (the extended prefix; k grows with the smaller set). A set whose extended prefix
   is all rare indexes those single shingles. Pairs meet in short runs of the sorted index, and only a pair that meets
   k times is a candidate; a passage that two unlike texts share is too short for that.
4. The others, made of frequent shingles mostly, are the *pool*. Two similar sets of the pool share at least 0.67 of
   their frequent shingles and differ in at most a quarter of what they share, so two shingles that follow each other
   among the frequent ones of one set do so in the other: each difference parts one such combination, and there are more
   of them than differences. Pool sets index these 2-combinations, which link them into families; a family is cut into
   bands by size, and a band's blocks of bounded size are compared with its own and the next band's by matrix products of
   their incidence, so no pair is written out, and sets of unlike sizes, as a common passage joins them, never meet.
5. Candidates are verified on whole sets in integers, and links become components.

What reaches the driver is bounded: the bits of the sketch (32 MB at most), of one membership filter (8 MB at most) and, where one of
each component is kept, the words of a filter of the rows that go (2**20 rows of 16 bytes at most). No key collects a group in a
task: index runs are read from sorted partitions, families are cut into blocks, classes are grouped by partial counts.

Defined results: a null or empty text has an empty set, links with nothing and is its own component; a text of one to four
words is one shingle; texts with equal sets always link; equal rows and repeated doc_ids count as documents of their own;
a class with no doc_id but null has the null component; extra columns are ignored; an empty table gives an empty
result. Hashes of 64 bits stand for shingles and sets; a clash among those compared is as likely as pairs / 2**64.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import pieces, table
from spectraloom.llm.textwords import SPACED, U, mix, windows, word_hashes
from spectraloom.operators.graph import connected_components
from spectraloom.sources.shared import Steps, written

K = 5
SIMILARITY = 80  # of 100
CELL_BITS = (20, 28)
CELLS_PER_DOCUMENT = 64
FLUSH = 1 << 21  # shingles that a task counts before it hands them on
FILTER_BITS = (22, 26)
BITS_PER_MEMBER = 16
LEAST_FREQUENT = 48
BAND = math.log(1.26)  # of sizes, by their logarithm: similar sets lie in one band or in two next to each other
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21  # 16 MB of hashes
SEEN_CLASSES = 200_000
WORDS = 1 << 20  # of the filter of rows that go, 64 bits each
ROWS_PER_WORD = 4


def cell_bits_for(documents: int) -> int:
    least, most = CELL_BITS
    return min(most, max(least, (CELLS_PER_DOCUMENT * documents).bit_length()))


def part_bits_for(cell_bits: int) -> int:
    """The sketch is cut into 256 to 4,096 parts, each of which is summed by itself; a place in a part has 16 bits at most."""
    return max(12, cell_bits - 12)


def filter_bits_for(members: int) -> int:
    least, most = FILTER_BITS
    return min(most, max(least, (BITS_PER_MEMBER * members).bit_length()))


def frequent_from(shingles: int, cell_bits: int) -> int:
    """The count from which a cell is frequent: a floor, the usual load of a cell, and eight times its usual spread."""
    load = shingles / (1 << cell_bits)
    return int(LEAST_FREQUENT + load + 8 * load**0.5)


def extra(n):
    """k: how many shingles of their extended prefixes similar sets share."""
    return 1 + n // 32


def prefix(n):
    return n - -(-SIMILARITY * n // 100) + extra(n)


class Sets:
    """The shingle sets of one slice of a batch, one after the other, each sorted by hash."""

    def __init__(self, h: np.ndarray, row: np.ndarray, first: int, last: int):
        shingle, of, _ = windows(h, row, K)
        words = np.bincount(row - first, minlength=last - first)
        few = np.flatnonzero((words > 0) & (words < K))
        if len(few):
            starts = np.searchsorted(row, few + first)
            short = [windows(h[s : s + words[d]], row[s : s + words[d]], int(words[d]))[0] for d, s in zip(few, starts)]
            shingle, of = np.concatenate([shingle, *short]), np.concatenate([of, few + first])
        order = np.lexsort((shingle, of))
        shingle, of = shingle[order], of[order] - first
        new = np.ones(len(of), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
        self.shingle, self.of, self.first, self.rows = shingle[new], of[new], first, last - first
        self.n = np.bincount(self.of, minlength=self.rows)
        self.start = np.cumsum(self.n) - self.n
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.shingle + U(0x51ED270B)))])
        self.id = mix(total[self.start + self.n] - total[self.start] + self.n.astype(np.uint64) * U(0xD6E8FEB86659FD93)).view(np.int64)

    def fresh(self, seen: set) -> np.ndarray:
        """Which rows hold a class that this task meets for the first time, as far as it remembers."""
        out = np.zeros(self.rows, bool)
        for d, (i, n) in enumerate(zip(self.id.tolist(), self.n.tolist())):
            if n and i not in seen:
                out[d] = True
                seen.add(i)
        if len(seen) > SEEN_CLASSES:
            seen.clear()
        return out


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for batch in pieces(batches):
        for first, last, h, row in word_hashes(batch.column("text"), SPACED):
            yield batch, Sets(h, row, first, last)


def _counted(cells: np.ndarray, part_bits: int) -> Iterator[tuple[int, bytes]]:
    """Parts of the sketch of some shingles' cells: the places in the part and their counts."""
    cells = np.sort(cells)
    start = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    count, cell = np.diff(np.r_[start, len(cells)]).astype(np.uint32), cells[start]
    part = cell >> np.uint32(part_bits)
    place = (cell & np.uint32((1 << part_bits) - 1)).astype(np.uint16)
    pack = zstandard.ZstdCompressor(level=1).compress
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(part[i]), pack(place[i:j].tobytes() + count[i:j].tobytes())


def _classes(cell_bits: int):
    """Each document's set size and class; now and then, and at the end, what the task has counted for the sketch, in parts."""
    names = ["doc_id", "mark", "n_shingles", "class_id", "part", "cells"]

    def parts(held: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        found = list(_counted(np.concatenate(held), part_bits_for(cell_bits)))
        none = [pa.nulls(len(found), t) for t in (kind, pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array([i for i, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen, kind = [], 0, set(), None
        for batch, s in _slices(batches):
            fresh = s.fresh(seen)
            kind = batch.column("doc_id").type
            held.append((s.shingle[fresh[s.of]] & U((1 << cell_bits) - 1)).astype(np.uint32))
            n += len(held[-1])
            ids, marks = (batch.column(c).slice(s.first, s.rows) for c in ("doc_id", "mark"))
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(s.n, pa.int64()), pa.array(s.id), pa.nulls(s.rows, pa.int32()), pa.nulls(s.rows, pa.binary())], names)
            if n >= FLUSH:
                yield parts(held, kind)
                held, n = [], 0
        if n:
            yield parts(held, kind)

    return run


def _frequent_parts(threshold: int, part_bits: int):
    """Sums the parts of the sketch, which arrive sorted, and keeps one bit a cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, unpack = None, None, zstandard.ZstdDecompressor().decompress

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= threshold).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells")):
                if part != at:
                    if at is not None:
                        yield done()
                    at, total = part, np.zeros(1 << part_bits, np.uint64)
                raw = unpack(cells.as_py())
                n = len(raw) // 6
                total[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, np.uint32, n, 2 * n)  # places differ
        if at is not None:
            yield done()

    return run


class Order:
    """Rare shingles first: the split of each set by the sketch's bits."""

    def __init__(self, s: Sets, bits: np.ndarray):
        cell = (s.shingle & U(8 * len(bits) - 1)).astype(np.int64)
        self.frequent = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        self.n_rare = np.bincount(s.of[~self.frequent], minlength=s.rows)
        self.pool = (self.n_rare < prefix(s.n)) & (s.n > 0)


def _index(bits_of):
    """Entries key, class_id, about (2 * set size + in the pool), combo."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = set(), np.frombuffer(bits_of.value, np.uint8)
        for _, s in _slices(batches):
            order, fresh = Order(s, bits), s.fresh(seen)
            rare = np.flatnonzero(~order.frequent & fresh[s.of])
            of = s.of[rare]
            begins = np.searchsorted(of, np.arange(s.rows))
            rare = rare[np.arange(len(rare)) - begins[of] < prefix(s.n)[of]]
            often = np.flatnonzero(order.frequent & (fresh & order.pool)[s.of])
            pair = np.flatnonzero(s.of[often][1:] == s.of[often][:-1])
            a, b = often[pair], often[pair + 1] if len(pair) else often[pair]
            key = np.concatenate([s.shingle[rare], mix(mix(s.shingle[a]) + s.shingle[b])])
            of = np.concatenate([s.of[rare], s.of[a]])
            combo = np.zeros(len(key), bool)
            combo[len(rare) :] = True
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(s.id[of]), pa.array((2 * s.n + order.pool)[of].astype(np.int32)), pa.array(combo)], ["key", "class_id", "about", "combo"])

    return run


def _similar_size(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that meet in a run of single shingles, and each member of a combination's run with the run's first.

    Runs arrive sorted. Of single shingles the last run is carried over to the next batch: it is shorter than the
    sketch's threshold. Of combinations only the first member is carried.
    """
    names = ["a", "b", "least", "combo"]
    rest = None
    head_key = head = None
    for batch in batches:
        key, cls, about, combo = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "class_id", "about", "combo"))
        c = np.flatnonzero(combo)
        if len(c):
            k, m = key[c], cls[c]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            if head_key is not None and k[0] == head_key:
                new[0] = False
                firsts = np.concatenate([[head], m[new]])
                group = np.cumsum(new)
            else:
                firsts, group = m[new], np.cumsum(new) - 1
            pivot = firsts[group]
            head_key, head = k[-1], pivot[-1]
            edge = np.unique(np.stack([m, pivot], 1)[m != pivot], axis=0)
            if len(edge):
                yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0].copy()), pa.array(edge[:, 1].copy()), pa.nulls(len(edge), pa.int32()), pa.array(np.ones(len(edge), bool))], names)
        s = np.flatnonzero(~combo)
        entry = [key[s], cls[s], about[s].astype(np.int64)]
        if rest is not None:
            entry = [np.concatenate(x) for x in zip(rest, entry)]
        if not len(entry[0]):
            continue
        cut = int(np.searchsorted(entry[0], entry[0][-1]))
        rest = [x[cut:] for x in entry]
        yield from _run_pairs(*(x[:cut] for x in entry), names)
    if rest is not None:
        yield from _run_pairs(*rest, names)


def _run_pairs(key, cls, about, names) -> Iterator[pa.RecordBatch]:
    if len(key) < 2:
        return
    order = np.lexsort((cls, key))
    key, cls, about = key[order], cls[order], about[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])  # a class may come from several tasks
    key, cls, about = key[keep], cls[keep], about[keep]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    for length in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(length, 1)
        at = start[size == length]
        for piece in np.array_split(at, max(1, len(at) * len(i) // 200_000)):
            x, y = (piece[:, None] + i).ravel(), (piece[:, None] + j).ravel()
            n, m = about[x] >> 1, about[y] >> 1
            ok = _similar_size(n, m) & ((about[x] & about[y] & 1) == 0)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(cls[x[ok]]), pa.array(cls[y[ok]]), pa.array(extra(np.minimum(n, m)[ok]).astype(np.int32)), pa.array(np.zeros(int(ok.sum()), bool))], names)


def _wanted_sets(bits_of, filter_of, filter_bits: int):
    """class_id, pool, items of the pool's sets and of those that the membership filter lets through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits, wanted = set(), np.frombuffer(bits_of.value, np.uint8), np.frombuffer(filter_of.value, np.uint8)
        for _, s in _slices(batches):
            order = Order(s, bits)
            at = s.id & ((1 << filter_bits) - 1)
            rows = np.flatnonzero(s.fresh(seen) & (order.pool | (wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            items = [s.shingle[s.start[d] : s.start[d] + s.n[d]].tobytes() for d in rows]
            yield pa.RecordBatch.from_arrays([pa.array(s.id[rows]), pa.array(order.pool[rows]), pa.array(items, pa.binary())], ["class_id", "pool", "items"])

    return run


def _membership(ids: DataFrame, filter_bits: int) -> bytes:
    """A filter of 2**filter_bits bits over class ids. Others may pass, none is missed."""
    at = F.col("class_id").bitwiseAND((1 << filter_bits) - 1)
    words = ids.select(F.shiftright(at, 5).alias("w"), F.expr("shiftleft(1L, cast(class_id & 31 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    held, out = words.toArrow(), np.zeros(1 << (filter_bits - 5), np.uint32)
    out[held.column("w").to_numpy()] = held.column("bits").to_numpy().astype(np.uint32)
    return out.tobytes()


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            shared = int((q[at] == p).sum())
            keep.append(100 * shared >= SIMILARITY * (len(p) + len(q) - shared))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Whether each set of ``left`` links with each of ``right`` (with each other one of ``left`` if None)."""
    sets = left + (right or [])
    n = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), n)
    token, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_code = np.cumsum(count > 1) - 1
    ok = (count > 1)[code]
    row, code = row[ok], shared_code[code[ok]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    a = len(left)
    common = np.zeros((a, len(sets) - a if right is not None else a), np.float32)
    total, step = int((count > 1).sum()), 1024
    for c in range(0, total, step):
        lo, hi = np.searchsorted(code, [c, c + step])
        x = np.zeros((len(sets), min(step, total - c)), np.float32)
        x[row[lo:hi], code[lo:hi] - c] = 1
        common += x[:a] @ (x[a:].T if right is not None else x[:a].T)
    m = n[a:] if right is not None else n
    common = common.astype(np.int64)
    out = 100 * common >= SIMILARITY * (n[:a, None] + m[None, :] - common)
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _compare(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks of a family: a spanning forest of its links, and each member's number of linked documents."""
    _, i, j = key
    frame = frame.drop_duplicates("class_id")
    sets = [np.frombuffer(x, np.uint64) for x in frame["items"]]
    ids, copies, block = frame["class_id"].to_numpy(), frame["copies"].to_numpy(), frame["block"].to_numpy()
    if i == j:
        links = block_links(sets, None)
        counts = pd.DataFrame({"a": ids, "b": -1, "links": links @ copies, "edge": False})
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": [], "edge": []}).astype({"a": "int64", "b": "int64", "links": "int64", "edge": "bool"})
        some = block_links([sets[x] for x in left], [sets[x] for x in right])
        order = np.concatenate([left, right])
        ids, copies = ids[order], copies[order]
        counts = pd.DataFrame({"a": ids, "b": -1, "links": np.concatenate([some @ copies[len(left) :], some.T @ copies[: len(left)]]), "edge": False})
        links = np.zeros((len(ids), len(ids)), bool)
        links[: len(left), len(left) :] = some
        links[len(left) :, : len(left)] = some.T
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label, np.where(links, label[None, :], len(ids)).min(axis=1, initial=len(ids)))
        least = least[least]
        if (least == label).all():
            break
        label = least
    edges = pd.DataFrame({"a": ids, "b": ids[label], "links": 0, "edge": True})
    return pd.concat([edges[edges["a"] != edges["b"]], counts[counts["links"] > 0]])


def _components(docs: DataFrame, kept: Steps | None = None) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, class_id, root (the component's class), component_id, n_links.

    The tables that the result reads are among ``kept``, for the caller to drop.
    """
    spark, steps, kept = docs.sparkSession, Steps(docs.sparkSession), kept or Steps(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cell_bits = cell_bits_for(docs.count())
    part_bits = part_bits_for(cell_bits)
    first = kept.written(texts.mapInArrow(_classes(cell_bits), f"doc_id {kind}, mark long, n_shingles long, class_id long, part int, cells binary"), "classes")
    each = first.where("part is null").select("doc_id", "mark", "n_shingles", "class_id")
    classes = steps.written(each.where("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")), "class-rows")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    threshold = frequent_from(shingles, cell_bits)
    parts = first.where("part is not null").select("part", "cells").repartition("part").sortWithinPartitions("part")
    bits = bytearray(1 << (cell_bits - 3))
    for r in parts.mapInArrow(_frequent_parts(threshold, part_bits), "part int, bits binary").toLocalIterator():  # 2**cell_bits bits
        bits[r["part"] << (part_bits - 3) : (r["part"] + 1) << (part_bits - 3)] = r["bits"]
    bits_of = spark.sparkContext.broadcast(bytes(bits))

    texts = texts.select("text")
    index = texts.mapInArrow(_index(bits_of), "key long, class_id long, about int, combo boolean")
    met = index.repartition("key").sortWithinPartitions("key").mapInArrow(_meetings, "a long, b long, least int, combo boolean")
    met = steps.written(met.groupBy("a", "b", "combo").agg(F.count("*").alias("times"), F.max("least").alias("least")).where("combo or times >= least").select("a", "b", "combo"), "met")
    pairs = met.where("not combo").select("a", "b")
    filter_bits = filter_bits_for(2 * pairs.count())
    filter_of = spark.sparkContext.broadcast(_membership(pairs.select(F.explode(F.array("a", "b")).alias("class_id")), filter_bits))
    sets = texts.mapInArrow(_wanted_sets(bits_of, filter_of, filter_bits), "class_id long, pool boolean, items binary")
    sets = steps.written(sets.dropDuplicates(["class_id"]), "sets")

    x = sets.select(F.col("class_id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("class_id").alias("b"), F.col("items").alias("y"))
    links = steps.written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "links")

    family = connected_components(met.where("combo")).join(classes.select(F.col("class_id").alias("node"), "copies", "n"), "node")
    family = steps.written(family.withColumn("band", F.floor(F.ln("n") / BAND).cast("long")), "family")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    bands = family.groupBy("root", "band").agg(blocks.alias("blocks")).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("bands"))  # some 100 bands at most
    place = lambda band, k: band * (1 << 32) + k
    many = lambda z: F.coalesce(F.try_element_at("bands", z), F.lit(0).cast("long"))
    blocks_of = lambda z: F.when(many(z) > 0, F.transform(F.sequence(F.lit(0).cast("long"), many(z) - 1), lambda k: place(z, k))).otherwise(F.array().cast("array<long>"))
    met_blocks = F.concat(*(blocks_of(F.col("band") + d) for d in (-1, 0, 1)))
    own = place(F.col("band"), F.pmod(F.xxhash64("class_id"), many(F.col("band"))))
    sized = family.join(bands, "root").select("root", "node", "copies", "band", "bands")
    members = (
        sets.where("pool")
        .join(sized, F.col("class_id") == F.col("node"))
        .withColumn("block", own)
        .withColumn("other", F.explode(met_blocks))
        .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class_id", "copies", "items")
    )
    compared = steps.written(members.groupBy("root", "i", "j").applyInPandas(_compare, "a long, b long, links long, edge boolean"), "compared")

    root = connected_components(links.unionByName(compared.where("edge").select("a", "b")))
    count = F.col("copies")
    numbers = (
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .join(classes.select(F.col("class_id").alias("b"), "copies"), "b")
        .select("a", count.alias("links"))
        .unionByName(compared.where("not edge").select("a", "links"))
        .groupBy(F.col("a").alias("class_id"))
        .agg(F.sum("links").alias("links"))
    )
    of_class = classes.join(root, F.col("class_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class_id"))
    least = of_class.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = of_class.join(least, "root").join(numbers, "class_id", "left")
    known = known.select(F.col("class_id").alias("known_id"), "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = kept.written(known, "components")
    steps.drop()
    linked = each.join(known, (F.col("class_id") == F.col("known_id")) & (F.col("n_shingles") > 0), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return linked.select("doc_id", "mark", "n_shingles", "class_id", "root", own.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents that the document links with), one row a document."""
    return _components(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def words_for(members: int) -> int:
    return min(WORDS, 1 << max(0, (members // ROWS_PER_WORD).bit_length()))


def sifted(docs: DataFrame, named: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that ``named`` (__id, __mark) surely doesn't name, and those that it may: all it names, and a few others.

    Each name sets four bits of one of ``words`` (a power of two) words, which travel by broadcast. Too few words cost time only.
    """
    word = lambda h: F.col(h).bitwiseAND(words - 1)
    bits = lambda h: F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {k}) & 63 as int))" for k in (40, 46, 52, 58)))
    held = named.select(F.xxhash64("__id", "__mark").alias("__h")).groupBy(word("__h").alias("__word")).agg(F.bit_or(bits("__h")).alias("__bits"))
    met = docs.withColumn("__of", F.xxhash64("doc_id", F.xxhash64("text"))).join(F.broadcast(held), word("__of") == F.col("__word"), "left")
    may = F.coalesce(F.col("__bits").bitwiseAND(bits("__of")) == bits("__of"), F.lit(False))
    return met.where(~may).select(*docs.columns), met.where(may).select(*docs.columns)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of every component, with all its columns: the one with the least doc_id (null ids last).

    Rows that share the least doc_id are told apart by a hash of their texts; of rows that share both, one stays.
    Documents without a set all stay.
    """
    steps = Steps(docs.sparkSession)
    kept = Steps(docs.sparkSession)
    rows = _components(docs, kept).where("n_shingles > 0").groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    rows = steps.written(rows, "rows")
    kept.drop()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    best = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "mark", "n"), order).alias("best"))
    mark = F.struct(F.col("doc_id"), F.col("mark"))
    gone = rows.join(best.select(F.col("root").alias("of"), F.struct("best.doc_id", "best.mark").alias("kept")), F.col("root") == F.col("of")).where(~mark.eqNullSafe(F.col("kept")))
    again = best.where("best.n > 1").select("best.doc_id", "best.mark")
    gone = gone.select("doc_id", "mark").unionByName(again)
    away = written(gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), "away")
    again = written(again.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), "again")
    steps.drop()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__mark"))
    sure, open_ = sifted(docs, away, words_for(away.count()))  # so that only a few texts besides those that go are shuffled
    left = sure.unionByName(open_.join(away, same, "left_anti"))
    if again.isEmpty():
        return left
    repeated = docs.join(again, same, "left_semi")
    one = repeated.groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__mark")).agg(F.max_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return left.unionByName(one.select("__row.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 80 * (n + m - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = s.doc_id)::BIGINT AS component_id,
       (SELECT count(*) FROM links WHERE links.a = s.doc_id)::BIGINT AS n_links
FROM s"""
