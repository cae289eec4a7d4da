"""Collocations against a plain recomputation; sorting, cutting and packing by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spectraloom.llm import collocations


def plain(rows, top=2000, least=10):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, words[i : i + k]] += 1
    candidates = {(lang, x): a for (lang, x), a in f.items() if len(x) > 1 and a >= least}
    found = defaultdict(list)
    for (lang, x), a in candidates.items():
        if len(x) == 2 and any(100 * b >= 50 * a and x in (y[:2], y[1:]) for (other, y), b in candidates.items() if other == lang and len(y) == 3):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, x[:k]] * f[lang, x[k:]]), k, f[lang, x[:k]], f[lang, x[k:]]) for k in range(1, len(x)))
        found[lang].append((-score, -a, " ".join(x).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def run(docs, **kwargs):
    return sorted(map(tuple, collocations.best_phrases(docs, **kwargs).collect()))


def rows_of(docs):
    return [(r["text"], r["lang"]) for r in docs.collect()]


def corpus(n, rng):
    """Words of very unequal frequency, planted phrases, pieces and odd white space."""
    words = [f"w{k}" for k in range(40)] + ["Ünï", "日本", "x\x1cy", "A"]
    weights = [1 / (k + 1) for k in range(len(words))]
    out = []
    for _ in range(n):
        parts = rng.choices(words, weights, k=rng.randrange(60))
        if rng.random() < 0.5:
            parts[len(parts) // 2 : 0] = ["new", "york", "city"] if rng.random() < 0.7 else ["New", "York"]
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? "]) for w in parts))
    return out


@pytest.mark.parametrize(("chunk", "span", "sorted_words"), [(8 << 20, 1 << 20, 1 << 20), (500, 300, 13)])
def test_equals_plain_counts(documents, odd_texts, monkeypatch, chunk, span, sorted_words):
    monkeypatch.setattr(collocations, "SORTED", sorted_words)
    docs = documents([*odd_texts, *corpus(120, random.Random(chunk)), *["the same text, again and again"] * 75, (None, "no id"), (3, "again")])
    rows = rows_of(docs)
    assert run(docs, chunk=chunk, span=span) == plain(rows)
    assert run(docs, top=3, chunk=chunk, span=span) == plain(rows, top=3)


def test_no_rows_and_no_candidates(documents):
    docs = documents(["a few words", None, ""])
    assert run(docs) == [] and run(docs.where("doc_id < 0")) == []


def test_products_beyond_64_bits(spark):
    a = 9 * 10**13
    df = spark.createDataFrame([(a, a + 1, a + 7)], "a long, l long, r long")
    assert df.select(collocations._score("a", "l", "r")).first()[0] == 1000000 * a * a // ((a + 1) * (a + 7))


def test_radix_order_and_runs():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32) & m for m in (np.uint32(0x30003), np.uint32(7), np.uint32(0xFFFF0000))]
    counts = rng.integers(1, 9, 5000)
    keys, n = collocations.run_lengths(columns, counts)
    want = Counter()
    for key, c in zip(zip(*(c.tolist() for c in columns), strict=True), counts.tolist(), strict=True):
        want[key] += c
    assert list(zip(*(k.tolist() for k in keys), strict=True)) == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


def test_cuts_keep_pieces():
    text = b"one.two three.four" + b"x" * 40 + b".end"
    parts = list(collocations._cut(text, 12))
    assert b".".join(parts) == text and all(b"." not in p for p in parts if len(p) > 12)


def test_ids_are_gapless(spark):
    df = spark.createDataFrame([("en" if k % 2 else "de", f"w{k}", k + 10) for k in range(500)], "lang string, word string, f long")
    got = sorted((r["id"], r["before"], r["f"]) for r in collocations.dictionary(df).collect())
    assert [x[0] for x in got] == list(range(1, 501))
    assert [x[1] for x in got] == [sum(y[2] for y in got[:k]) for k in range(500)]
