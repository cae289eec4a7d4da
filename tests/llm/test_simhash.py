"""Fingerprints and components against plain recomputations."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from spectraloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, radius=4):
    v = np.array(prints, np.uint64)
    label = np.arange(len(v))
    while True:
        near = np.array([label[np.bitwise_count(v ^ x) <= radius].min() for x in v])
        if (near == label).all():
            break
        label = near
    least = {}
    for i, c in zip(ids, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [least.get(c) for c in label]


def planted(n, rng):
    """Random numbers, families within a few bits, chains, and numbers of very few and very many bits."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n // 10):
        x = rng.choice(out)
        for _ in range(rng.randrange(1, 12)):
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out + [0, 1, 15, 31, 2**64 - 1, 2**64 - 32, 2**63, 2**63 + 1]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_plain_ones(odd_texts):
    rng = random.Random(5)
    texts = [*odd_texts, "A b C d e", " lead", "trail ", *[" ".join(rng.choices(["Foo", "bar", "ÄÖ", "x", "日本"], k=rng.randrange(40))) for _ in range(60)]]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts))] == [plain_fingerprint(t) for t in texts]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts)[3:9])] == [plain_fingerprint(t) for t in texts[3:9]]


def test_long_text_is_added_up_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    texts = [" ".join(str(i * k) for i in range(50)) for k in range(4)]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts))] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_offsets_keep_every_near_pair(parts):
    offsets, rng, width = set(simhash.near_offsets(parts)), random.Random(parts), 64 // parts
    counts = lambda x: [(x >> (k * width) & ((1 << width) - 1)).bit_count() for k in range(parts)]
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert tuple(a - b for a, b in zip(counts(x), counts(y), strict=True)) in offsets


@pytest.mark.parametrize(("parts", "tile"), [(1, 1 << 15), (1, 40), (2, 50), (4, 7), (8, 3)])
def test_components_equal_brute_force(spark, parts, tile, monkeypatch):
    """Whatever the tiles are, all links count; a third of the rows are copies of one text."""
    prints = planted(300 if parts < 8 else 60, random.Random(parts * tile))
    prints += [prints[0]] * (len(prints) // 2)
    rows = list(enumerate(prints))
    random.Random(1).shuffle(rows)
    ids, prints = zip(*rows, strict=True)

    def given(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([int(t) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "fingerprint"])

    monkeypatch.setattr(simhash, "_fingerprint", given)
    docs = spark.createDataFrame([(i, str(signed(x))) for i, x in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(docs, parts=parts, tile=tile).collect()}
    assert got == dict(zip(ids, plain_components(ids, prints), strict=True))


def test_documents(documents, odd_texts):
    """Nulls, empties, repeated rows and ids, null ids, long texts and near copies."""
    rng = random.Random(3)
    base = [str(rng.randrange(500)) for _ in range(400)]
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (5, 90, 200)]
    texts = [*odd_texts, (2, "again"), (2, "again"), (None, "nobody"), (None, None), *[(900 + k, t) for k, t in enumerate([" ".join(base), *near])]]
    docs = documents(texts)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], [signed(x) for x in prints], plain_components([r["doc_id"] for r in rows], prints), strict=True), key=str)
    assert sorted(map(tuple, simhash.components(docs).collect()), key=str) == want
    assert simhash.components(docs.where("doc_id < -9")).collect() == []
    assert {x[2] for x in want if x[0] is not None and x[0] >= 900} == {900}


def test_query(spark):
    from spectraloom.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{x:016x}", c) for r, x, c in zip(rows, prints, plain_components([r["doc_id"] for r in rows], prints), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op11_simhash"](spark, sf).collect()} == want
