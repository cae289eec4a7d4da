"""The manifest against a plain recomputation, with blocks small enough for several rounds."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spectraloom.llm import merkle


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, low=False):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if low and row["text"] is not None:
        values[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node, proof = leaf_of(r, True) if tampered else leaf, ""
            for tree, k in ((trees[s], at), (top, g)):
                for level in tree[:-1]:
                    run = level[k // 16 * 16 : k // 16 * 16 + 16]
                    proof += "".join(run[: k % 16] + run[k % 16 + 1 :])
                    node = h("".join([*run[: k % 16], node, *run[k % 16 + 1 :]]))
                    k //= 16
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def run(docs):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return sorted(map(tuple, merkle.manifest(merkle.leaves(docs, tampered)).collect()), key=str)


def test_odd_rows(documents, odd_texts):
    docs = documents([*odd_texts, (3, "again"), (3, "again"), (None, None), (-7, "Below Zero"), *[(100 + i, f"Text {i}") for i in range(90)]])
    assert run(docs) == plain([r.asDict() for r in docs.collect()])


def test_one_row_and_none(documents):
    docs = documents([(5, "Only One")])
    assert run(docs) == plain([r.asDict() for r in docs.collect()])
    assert run(docs.where("doc_id < 0")) == []


@pytest.mark.parametrize("n", [16, 17, 4096, 4097, 9000])
def test_block_borders(spark, n):
    """One source with ``n`` leaves, a hot one, beside 20 small ones: several rounds and lone last runs."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    small = spark.range(40).select((F.col("id") + n).alias("doc_id"), F.lit("X").alias("text"), F.lit(None).cast("string").alias("lang"), F.concat(F.lit("s"), F.col("id") % 20).alias("source"), F.lit(None).cast("long").alias("n_chars"))
    docs = docs.unionByName(small)
    assert run(docs) == plain([r.asDict() for r in docs.collect()])


def test_many_groups(spark):
    """More groups than one block of the upper tree has leaves."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("T").alias("text"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert run(docs) == plain([r.asDict() for r in docs.collect()])
