import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import compression_classifier, jaccard_join, mixing, packing, registry, sharding, url_filters
from spectraloom.llm.tokens import vocabulary_path
from spectraloom.operators.graph import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (7, 6), (7, 6)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    assert got == {x: r for x, r in want.items() if any(x in e and e[0] != e[1] for e in edges)}


def brute_links(texts):
    sets = []
    for t in texts:
        w = [x for x in (t or "").translate(LOWER).encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(texts)
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    degree = collections.Counter(x for e in links for x in e)
    return [(i, len(sets[i]), find(i), degree[i]) for i in range(n)]


def family(rng, size, copies, edits):
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("frequent, shingles", [(1, 1 << 21), (4, 200), (48, 1 << 21)])
def test_jaccard_equals_brute_force(spark, documents, odd_texts, monkeypatch, frequent, shingles):
    """With 1 and 4 most sets are in the pool and families are cut into several blocks."""
    monkeypatch.setattr(jaccard_join, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles)
    rng = random.Random(frequent)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = list(odd_texts)
    for size, copies, edits in ((40, 30, 3), (150, 25, 8), (12, 10, 1), (6, 8, 1), (300, 4, 30), (9, 6, 1)):
        texts += family(rng, size, copies, edits)
    texts += [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randrange(5, 120)))} {passage}" for _ in range(25)]
    texts += [texts[20], texts[20].upper(), texts[20].replace(" ", "\n")]
    rng.shuffle(texts)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(documents(texts)).collect())
    assert got == brute_links(texts)


def test_jaccard_of_many_sets_with_one_passage(spark, documents):
    """20,000 sets of all sizes share a passage, so they are one family; the few that are near copies link, no others."""
    rng = random.Random(20)
    passage = " ".join(f"p{i}" for i in range(40))
    own = lambda: [f"u{rng.randrange(10**7)}" for _ in range(int(20 * 1.0004 ** rng.randrange(3000)))]
    texts, want = [], {}
    for k in range(20_000):
        words = own()
        texts.append(" ".join(words) + " " + passage)
        want[k] = k
    for k in range(0, 20_000, 400):
        words = texts[k].split(" ")
        words[0] = "changed"
        want[len(texts)] = k
        texts.append(" ".join(words))
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_components(documents(texts, more=False)).collect()}
    assert {i: c for i, (c, _) in got.items()} == want
    assert sum(n for _, n in got.values()) == 100


def test_jaccard_odd_ids(spark, documents):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A B c d e  f"), (None, "null's own"), (None, "")]
    out = sorted(jaccard_join.jaccard_components(documents(rows)).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in out) == sorted([("5", 2, "2", 3), ("5", 2, "2", 3), ("None", 2, "2", 3), ("2", 2, "2", 3), ("None", 1, "None", 0), ("None", 0, "None", 0)])
    kept = jaccard_join.keep_one_of_each(documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "x y"), (None, "a b c d e f")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4"]
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "its own words that no other has"), (2, "A b c d e f"), (None, "x y"), (None, "x y"), (None, ""), (None, "")]
    kept = jaccard_join.keep_one_of_each(documents(rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c d e f"), ("1", "its own words that no other has"), ("None", ""), ("None", ""), ("None", "x y")]
    assert kept.columns == documents(["x"]).columns


def test_rows_that_may_go(spark, documents):
    docs = documents([(None if i % 97 == 0 else i // 2, f"text {i % 5}" if i % 11 else None) for i in range(4000)])
    rows = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__mark"))
    named = rows.where("__id is null or __id % 10 = 3").distinct()
    gone = {(r["__id"], r["__mark"]) for r in named.collect()}
    marked = lambda df: [(r.doc_id, r.mark) for r in df.select("doc_id", F.xxhash64("text").alias("mark")).collect()]
    want = marked(docs)
    for words in (jaccard_join.words_for(named.count()), 1):
        sure, may = jaccard_join.sifted(docs, named, words)
        assert sure.columns == may.columns == docs.columns
        sure, may = marked(sure), marked(may)
        assert collections.Counter(sure + may) == collections.Counter(want)
        assert not gone & set(sure)
        assert words == 1 or len(may) - sum(x in gone for x in want) < 0.05 * len(want)
    kept = jaccard_join.keep_one_of_each(documents([(i, f"a b c d e f g h {i % 300}") for i in range(900)], more=False))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "__bits" in plan[plan.index("LeftAnti") :]  # only rows that the filter lets through meet in the anti join
    assert jaccard_join.words_for(0) == 1 and jaccard_join.words_for(10**9) == jaccard_join.WORDS


def test_sharding_law(spark, documents, odd_texts):
    rows = list(enumerate(odd_texts)) + [(i, f"text {i % 5}") for i in range(20, 900)] + [(None, "x"), (7, "again"), (7, "again")]
    docs = documents(rows, more=False)
    docs.createOrReplaceTempView("d")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    place = lambda n: sharding.place(narrow, "doc_id", [1.0] * n)
    out = sharding.number(place(8), "shard", "doc_id", ["text_crc32", "size"]).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(8))
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    def best(key, n):
        draws = [(int(hashlib.md5(f"{'null' if key is None else key}@{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in range(n)]
        return max(range(n), key=lambda s: (-1 / math.log(draws[s]), -s))

    assert all(r.shard == best(r.doc_id, 8) for r in out)
    before = {r.doc_id: r.shard for r in place(8).collect()}
    after = {r.doc_id: r.shard for r in place(9).collect()}
    moved = [k for k in before if before[k] != after[k]]
    assert all(after[k] == 8 for k in moved) and 0 < len(moved) < 0.2 * len(before)
    heavy = collections.Counter(r.shard for r in sharding.place(narrow, "doc_id", [1.0, 3.0]).collect())
    assert 2.2 < heavy[1] / heavy[0] < 4.2


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = registry.QUERIES["op6_quality_classifier"](spark, d)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    assert out.count() == docs.count()
    good = sorted(r.score for r in rows if r.quality == 1)
    bad = sorted(r.score for r in rows if r.quality == 0)
    assert np.mean([[g > b for b in bad] for g in good]) > 0.93
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_classifier_odd_cases(spark, documents, odd_texts):
    docs = documents(odd_texts)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (400, 1, 0), (3, 1, 0), (3, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = compression_classifier.score(docs, compression_classifier.fit(docs, labels)).collect()
    assert len(out) == len(odd_texts) and all(0 <= r.score <= 1 for r in out)
    none = compression_classifier.fit(docs, labels.where("false"))
    assert {r.score for r in compression_classifier.score(docs, none).collect()} == {0.5}
    kept = compression_classifier.keep_accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts)


def test_scores_are_the_curve_of_the_size_difference(spark, documents):
    import zstandard

    rng = random.Random(4)
    good = [" ".join(rng.choice(["calm", "river", "stone", "walks", "evening"]) for _ in range(60)) for _ in range(40)]
    bad = [" ".join(rng.choice(["BUY", "$$$", "click", "win", "now!!"]) for _ in range(60)) for _ in range(40)]
    texts = good + bad + [None, "", "calm river", "BUY now!!"]
    docs = documents([(f"d{i}", t) for i, t in enumerate(texts)], kind="string")
    labels = spark.createDataFrame([(f"d{i}", int(i < 40)) for i in range(80)] * 3, "doc_id string, quality int")
    repeated = docs.unionByName(docs.where("doc_id = 'd3'")).unionByName(docs.where("doc_id = 'd3'"))
    model = compression_classifier.fit(repeated, labels)
    assert model == compression_classifier.fit(docs, labels)
    out = {r.doc_id: r.score for r in compression_classifier.score(docs, model).collect()}
    sizes = []
    for held in (model.good, model.bad):
        c = zstandard.ZstdCompressor(level=compression_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=False, write_dict_id=False)
        sizes.append([len(c.compress((t or "").encode())) for t in texts])
    for i, t in enumerate(texts):
        z = model.offset + model.slope * (sizes[1][i] - sizes[0][i]) / max(1, len((t or "").encode()))
        assert math.isclose(out[f"d{i}"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert min(out[f"d{i}"] for i in range(40)) > 0.5 > max(out[f"d{i}"] for i in range(40, 80))


def test_packing_round_trip(spark, documents, odd_texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    rows = list(enumerate(odd_texts)) + [(50, "word " * 5000), (None, "word"), (3, "word")]
    out = packing.pack(documents(rows)).collect()
    found = collections.defaultdict(list)
    for r in out:
        found[r.doc_id, r.doc_tokens].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert len({r.sequence_id for r in out}) == len(out)
    want = collections.Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
    got = collections.Counter()
    for (i, n), pieces in found.items():
        copies = sum(p.start == 0 for p in pieces)
        ids = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start)[::copies])
        got[i, tuple(np.frombuffer(ids, "<u4").tolist())] += copies
        assert len(ids) == 4 * n
    assert got == want
    for n in (1, 2047, 2048, 2049, 5000):
        cut = packing.binary_lengths(n)
        assert sum(cut) == n and cut == sorted(cut, reverse=True) and len(cut) == n // 2048 + (n % 2048).bit_count()


def test_url_filters_follow_aliases(spark):
    canonical = '<link href="{}" rel="canonical">'.format
    pages = [
        (1, "http://A.example.com/en/x?q=1#f", canonical("http://b.example.info/y"), "n"),
        (2, "https://b.example.info/y", None, "n"),
        (3, "https://c.example.info/z", canonical("//b.example.info/y"), "n"),
        (4, "http://d.example.info/", '<META http-equiv="Refresh" content="0; URL=http://example.com/en/7/k">', "n"),
        (5, "http://e.example.info/", '<link rel="canonical" href="http://d.example.info/">' + '<meta http-equiv=refresh content="1;url=http://www.example.net/de/8">', "n"),
        (6, None, None, "n"),
        (7, "no scheme", canonical("http://b.example.info/y"), None),
        (8, "http://example.net/de/8/z", None, "n"),
        (9, "http://www.example.net/de/9", "<link rel=canonical href=/es/1>", "n"),
        (10, "http://www.example.net/es/1", None, "n"),
        (11, "http://notexample.com/en/7", None, "n"),
        (12, "http://example.org/es/?", None, "n"),
        (12, "http://example.org/es/?", None, "n"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, node string")
    out = {r.page_id: r for r in url_filters.judge_urls(df).collect()}
    assert {k: (r.rule, r.verdict) for k, r in out.items()} == {
        1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "block"),
        4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"),
        8: ("example.net/de/8", "block"), 9: ("net/de/", "block"), 10: (None, "block"), 11: ("com/en/", "block"), 12: ("org/es/", "block"),
    }
    assert (out[1].host, out[1].path) == ("a.example.com", "/en/x") and (out[6].host, out[6].path, out[7].path) == ("", "", "")
    extra = spark.createDataFrame([("http://q.info/1", "http://example.org/es/"), (None, "http://x.info")], "source string, target string")
    more = spark.createDataFrame([(1, "http://q.info/1#x", "")], "page_id long, url string, html string")
    assert url_filters.judge_urls(more, redirects=extra).first().verdict == "block"


def brute_topics(rows):
    """The topic of each (lang, text), from counts over all of them."""
    held = [((lang or ""), re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))) for lang, text in rows]
    docs, holds = collections.Counter(lang for lang, _ in held), collections.Counter((lang, w) for lang, words in held for w in set(words))
    anchors = {}
    for lang, n in docs.items():
        words = sorted((-k, w) for (of, w), k in holds.items() if of == lang and len(w) >= 4 and mixing.SCARCE * n <= k <= mixing.COMMON * n)
        anchors[lang] = [(w, math.log(n / -k)) for k, w in words[: mixing.ANCHORS]] if n * 1000 >= len(held) else []
    out = []
    for lang, words in held:
        weighed = sorted((-words.count(w) * rarity, w) for w, rarity in anchors[lang] if w in words)
        out.append(weighed[0][1] if weighed else "")
    return out


def test_mixing_meets_targets(spark, documents):
    rng = random.Random(5)
    words = lambda: " ".join(rng.choice(["w", f"Word{rng.randrange(300)}", f"common{rng.randrange(3)}"]) for _ in range(rng.randrange(1, 60)))
    texts = [words() for _ in range(400)] + [None, "", "License"]
    docs = documents(texts)
    out = sorted(mixing.mixture(docs).collect(), key=lambda r: r.doc_id)
    assert [r.topic for r in out] == brute_topics([(r.lang, r.text) for r in docs.orderBy("doc_id").collect()])
    assert len({r.topic for r in out}) > 8
    cells = spark.createDataFrame([(r.source, r.lang, r.topic, r.n_tokens) for r in out], "source string, lang string, topic string, n long").groupBy("source", "lang", "topic").agg(F.sum("n").alias("n"))
    targets = mixing.power_targets(cells)
    rows = mixing.rake(cells, targets)
    fitted = rows.toPandas()
    for d in mixing.DIMENSIONS:
        want = {r.level: r.share for r in targets[d].collect()}
        got = fitted.groupby(d)["w"].sum().to_dict()
        assert all(abs(got[k] - v) < 1e-3 for k, v in want.items())
    assert mixing.residual(rows, targets) < mixing.TOLERANCE
    rates = {(r.source, r.lang, r.topic): r.rate for r in out if r.n_tokens}
    assert max(rates.values()) == 1.0 and min(rates.values()) > 0
    assert all(r.kept == (int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52 < r.rate) for r in out)
    kept = mixing.sample_mixture(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)
    again = {r.doc_id: r.kept for r in mixing.mixture(docs.union(docs)).collect()}
    assert len(again) == len(texts)


def test_sweeps_are_planned_one_at_a_time(spark):
    rng = random.Random(8)
    cells = {(f"s{i % 5}", f"l{i % 3}", f"t{i % 7}"): rng.randrange(1, 1000) for i in range(60)}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, n long")
    targets = mixing.power_targets(df)
    share = {d: {r.level: r.share for r in targets[d].collect()} for d in mixing.DIMENSIONS}
    want = {k: float(n) for k, n in cells.items()}
    for _ in range(mixing.SWEEPS):
        for at, d in enumerate(mixing.DIMENSIONS):
            whole = collections.Counter()
            for k, w in want.items():
                whole[k[at]] += w
            want = {k: w * share[d][k[at]] / whole[k[at]] for k, w in want.items()}
    out = mixing.rake(df, targets)
    assert out._jdf.queryExecution().analyzed().toString().count("Window [") == len(mixing.DIMENSIONS)
    got = {(r.source, r.lang, r.topic): r.w for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], w, rel_tol=1e-9) for k, w in want.items())


def test_targets_that_cannot_be_met_are_warned_of(spark, documents):
    docs = documents(["one two"] * 6)
    rows = mixing.described(docs)
    cells = rows.groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("n"))
    targets = mixing.power_targets(cells) | {"topic": spark.createDataFrame([("", 0.5), ("none has it", 0.5)], "level string, share double")}
    with pytest.warns(UserWarning, match="aren't met"):
        mixing.cell_rates(rows, targets)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "labels", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path))
    assert out.columns and out.count() == 0
