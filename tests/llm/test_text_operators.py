import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spectraloom.llm import license_scan, media_columns, quality_rules, textwords, token_counts
from spectraloom.llm.tokens import Encoder, vocabulary_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_word_hashes_stand_for_words(odd_texts):
    for table, pattern in ((textwords.SPACED, r"[^\x20\x09-\x0D]+"), (textwords.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        words = [re.findall(pattern, (t or "").translate(LOWER)) for t in odd_texts]
        got = [[] for _ in odd_texts]
        for _, _, h, row in textwords.word_hashes(pa.array(odd_texts), table):
            for x, r in zip(h.tolist(), row.tolist()):
                got[r].append(x)
        assert [len(w) for w in words] == [len(g) for g in got]
        seen = {}
        for w, g in zip(words, got):
            for x, y in zip(w, g):
                assert seen.setdefault(x, y) == y
        assert len(set(seen.values())) == len(seen)


def test_word_hashes_cross_slices(monkeypatch):
    monkeypatch.setattr(textwords, "SLICE_BYTES", 16)
    texts = ["one two three", None, "", "four five six seven eight", "one two"] * 3
    got = [(r, x) for _, _, h, row in textwords.word_hashes(pa.array(texts), textwords.SPACED) for r, x in zip(row.tolist(), h.tolist())]
    assert [r for r, _ in got] == [i for i, t in enumerate(texts) for _ in (t or "").split()]
    assert got[0][1] == got[8][1] and got[1][1] == got[9][1]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in license_scan.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_license_scan_counts_base_places(spark, documents, odd_texts):
    texts = odd_texts + [
        "Under the MIT License, or the mit-license. CC BY cc by",
        "This work is licensed under the GNU General Public License, version 3.",
        "apache license apache license mit license",
        "the gnu general license public",
        "...apache\nlicense",
    ] * 2
    rows = list(enumerate(texts)) + [(None, "mit license"), (None, "mit license"), (3, "cc by other text")]
    out = license_scan.license_labels(documents(rows), license_scan.template_table(spark)).collect()
    assert len(out) == len(rows)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in out)
    want = []
    for i, t in rows:
        n, places = base_places(t)
        at = [p for p, _ in places]
        want.append((str(i), n, len(places), str(min(at, default=None)), str(max(at, default=None)), ",".join(sorted({x for _, x in places}))))
    assert got == sorted(want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)


def test_license_scan_finds_changed_notices(spark, documents):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    changed = notice.replace("free of charge ", "free of any charge ").replace("copy", "version")
    texts = ["lorem ipsum " * 20 + changed + " dolor", notice.upper(), "permission to copy of this software is not granted", "of this software " * 40]
    out = {r.doc_id: r for r in license_scan.license_labels(documents(texts), license_scan.template_table(spark)).collect()}
    assert "mit-text" in out[0].labels and out[1].labels == "mit-text" and out[1].score == 1
    assert out[2].labels == "" and out[3].labels == "" and out[3].n_base == 0


def plain_rows(png):
    """The samples of a grey PNG by the letter of its specification, one after the other."""
    at, data = 8, b""
    while at < len(png):
        n, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        assert int.from_bytes(png[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, out, above = zlib.decompress(data), [], [0] * width
    for y in range(height):
        kind, row = raw[y * (width + 1)], []
        for x, v in enumerate(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)]):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            by_distance = sorted((abs(a + b - c - v), i, v) for i, v in enumerate((a, b, c)))
            row.append((v + (0, a, b, (a + b) // 2, by_distance[0][2])[kind]) % 256)
        out.append(row)
        above = row
    return out


def plain_hash(rows):
    """The 64 signs of the lowest cosine terms of the 32 x 32 band means, term by term."""
    import statistics

    def bands(a):
        edges = [i * len(a) // 32 for i in range(33)]
        if len(a) < 32:
            return [a[e] for e in edges[:-1]]
        return [[sum(c) / (q - p) for c in zip(*a[p:q])] for p, q in zip(edges, edges[1:])]

    small = list(zip(*bands(list(zip(*bands(rows))))))
    cosine = lambda u, x: np.cos(np.pi * u * (2 * x + 1) / 64)
    terms = [round(float(sum(small[y][x] * cosine(v, y) * cosine(u, x) for y in range(32) for x in range(32))), 6) for v in range(8) for u in range(8)]
    middle = statistics.median(terms[1:])
    return f"{int(''.join(str(int(i > 0 and t > middle)) for i, t in enumerate(terms)), 2):016x}"


def test_media_round_trip(spark, documents, odd_texts):
    out = {r.doc_id: r for r in media_columns.media_features(media_columns.store_media(documents(odd_texts))).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media_columns.store_media(documents(odd_texts)).collect()}
    for i, t in enumerate(odd_texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = out[i]
        assert media_columns.decode_png(stored[i]).tobytes() == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        rows = plain_rows(stored[i])
        assert bytes(x for row in rows for x in row) == payload
        assert r.feature == plain_hash(rows)
    assert out[3].feature == out[4].feature and out[0].payload_sha256 == out[1].payload_sha256


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 24), dtype=np.uint8)
    for kind in (0, 1, 2, 3, 4, None):
        assert (media_columns.decode_png(media_columns.encode_png(image, kind)) == image).all()
    rows, above = np.empty((9, 25), np.uint8), np.zeros(24, int)
    for y, kind in enumerate([3, 4, 0, 1, 2, 4, 3, 4, 3]):
        left, corner = np.r_[0, image[y, :-1]].astype(int), np.r_[0, above[:-1]]
        p = left + above - corner
        pick = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows[y, 0], rows[y, 1:] = kind, image[y] - np.array([0 * left, left, above, (left + above) // 2, pick][kind])
        above = image[y].astype(int)
    assert (media_columns.unfilter(rows) == image).all()
    slope = (np.add.outer(np.arange(96), 2 * np.arange(96)) % 256).astype(np.uint8)
    mixed = np.concatenate([slope, rng.integers(0, 256, (9, 96), dtype=np.uint8), np.tile(slope[:1], (9, 1))])
    assert len(set(media_columns.filter_rows(mixed)[:, 0].tolist())) > 2
    images = [mixed, image, mixed[:7], image[:1]]
    assert all((a == b).all() for a, b in zip(media_columns.decode_pngs([media_columns.encode_png(x) for x in images]), images))
    assert [media_columns.width_for(576 * n) for n in (1, 4, 16, 64, 4000)] == [24, 48, 96, 192, 576]
    media = bytearray(media_columns.encode_png(image))
    for at in (0, 20, len(media) // 2, len(media) - 6):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media_columns.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media_columns.decode_png(bytes(media[:-3]))


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 500 else set(range(len(words)))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_quality_counts_and_verdict(spark, documents, odd_texts):
    prose = " ".join(f"word{i}" + "abcdefgh"[i % 8] for i in range(80))
    texts = odd_texts + [prose, prose.upper(), "one two three four " * 20, prose + " a b c a b c", prose + "#" * 40, (prose + "\n") * 1 + "same line\n" * 30]
    out = {r.doc_id: r for r in quality_rules.quality_report(documents(texts)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not any(rule(quality_rules.Text(t)) for _, rule in quality_rules.RULES))
    kept = quality_rules.keep_good(documents(texts))
    assert {r.doc_id for r in kept.collect()} == {i for i in out if out[i].kept}
    assert kept.columns == documents(texts).columns
    assert out[len(odd_texts)].kept and not out[len(odd_texts) + 1].kept


def test_cascade_puts_rejections_per_second_first():
    import time

    dear = ("dear", lambda t: time.sleep(0.002) or True)
    rules = [dear, ("never", lambda t: False), ("cheap", lambda t: t.n_words < 5)]
    texts = lambda *x: [quality_rules.Text(t) for t in x]
    assert quality_rules.greedy_order(texts("a b", "a b c d e f"), rules) == ["cheap", "dear", "never"]
    calls = []
    cascade = [("first", lambda t: calls.append("first") or True), ("second", lambda t: calls.append("second") or True)]
    assert not quality_rules.passes(quality_rules.Text("x"), cascade) and calls == ["first"]


def test_cascade_counts_shared_work_once_and_survivors_only():
    import time

    class Slow(quality_rules.Text):
        @quality_rules.cached_property
        def shared(self):
            time.sleep(0.003)
            return len(self.text)

    # "b" alone is as dear as "a", but what it needs is at hand once "a" has run, while "c" rejects what "a" has rejected already
    rules = [("c", lambda t: time.sleep(0.002) or t.text.startswith("x")), ("b", lambda t: t.shared > 8), ("a", lambda t: t.shared < 5)]
    texts = [Slow("x" * n) for n in (1, 2, 3, 4)] + [Slow("y" * 9), Slow("y" * 6)]
    assert quality_rules.greedy_order(texts, rules[1:]) == ["a", "b"]
    order = quality_rules.greedy_order([Slow("x")] * 3 + [Slow("y" * 9)], rules)
    assert order[0] == "c" and order[1] == "b"


def test_capitals_and_letters_as_categories_say(spark):
    import unicodedata

    text = "ABC abc 123 Ünï ΣΑΣ Ⅷ ⅷ Ⓐ ⓐ 🄰 ǅ ᾈ ª 日 𝐀 Ḁ"
    t = quality_rules.Text(text)
    assert t.n_upper == sum(unicodedata.category(c) == "Lu" for c in text) and t.n_letters == sum(unicodedata.category(c)[0] == "L" for c in text)


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_encoder_equals_library(odd_texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    texts = odd_texts + ["éa ´x", "Å 가각", "a b c", "word, word. word; (word)", "WORD Word wOrd", "x" * 5000]
    for encoder in (Encoder(vocabulary_path()), Encoder(vocabulary_path())):
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert Encoder(vocabulary_path(), counts=True).n_tokens(texts) == library_counts(texts)


def test_token_counts_and_cache(spark, documents, odd_texts, tmp_path, monkeypatch):
    rows = list(enumerate(odd_texts)) + [(None, "word"), (None, "other words"), (3, "same id"), (3, "same id")]
    cache = str(tmp_path / "cache")
    for _ in range(2):
        out = token_counts.count_tokens(documents(rows), cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == sorted((str(i), len((t or "").encode()), n) for (i, t), n in zip(rows, library_counts([t for _, t in rows])))
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("version", "digest").distinct().count()
    version = token_counts.tokenizer_version(vocabulary_path())
    lacking = lambda rows, version: token_counts.misses(documents(rows), token_counts.digested(documents(rows)), token_counts.read_cache(spark, cache, version)).count()
    assert lacking(rows, version) == 0 and lacking(rows + [(99, "new text")], version) == 1 and lacking([(1, "x")], "other") == 1
    assert lacking([(1, "new"), (1, "new"), (1, " new\n"), (2, "newer")], version) == 2


@pytest.mark.parametrize("gap", ["  ", "\t", "\n\n", " \x0b", "\x0c", "\r\n"])
def test_white_space_changes_no_count(spark, gap):
    plain = ["a b c", "it's don't", "<|endoftext|> word <|endoftext|>", "x <| y |> z", "word , word . 12 3", "Ünï cödé", "don 't", "( a )"]
    other = [gap + t.replace(" ", gap) + gap for t in plain]
    assert library_counts(plain) == library_counts(other) == Encoder(vocabulary_path(), counts=True).n_tokens(other)


def test_encoder_on_random_texts():
    import random

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(11)
    marks = [*"aAbB'sdtreé ÀßÿŸ.,,  *%()-_12½²\n\t\x0b\x1c\xa0\x85Σσς İıſḰ<|>日中́ﬀǅΆक़", "<|endoftext|>", "'ll", "'re", " , ", ". ", "word", "Word, "]
    encoder = Encoder(vocabulary_path())
    for _ in range(10):
        texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(200)]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_png_rows_are_undone_by_sums():
    """Filters 0 to 2 in any mixture and of several images at once, as the diagonals undo them; text is stored without a filter."""
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 256, (h, 24), dtype=np.uint8) for h in (1, 2, 9, 30)]
    rows = [np.concatenate([np.full((1, 1), k, np.uint8), media_columns.filter_rows(np.concatenate([m[max(0, y - 1) : y], m[y : y + 1]]), int(k))[-1:, 1:]], axis=1) for m in images for y, k in enumerate(rng.integers(0, 3, len(m)))]
    place = np.concatenate([np.arange(len(m)) for m in images])
    assert (media_columns._summed(np.concatenate(rows), place) == np.concatenate(images)).all()
    prose = np.frombuffer((b"the quick brown fox jumps over the lazy dog and runs away from it " * 99)[:5760], np.uint8).reshape(-1, 96)
    slope = (np.arange(96)[None, :] * 2 + np.arange(60)[:, None] * 3 + rng.integers(0, 2, (60, 96))).astype(np.uint8)
    assert media_columns.filter_for(prose) == 0 and media_columns.filter_for(slope) is None
    for m in (prose, slope):
        assert (media_columns.decode_png(media_columns.encode_png(m)) == m).all()


def test_cascade_is_ordered_on_what_it_meets(spark):
    """Texts that the base rejects don't count for the order of the other rules, wherever they stand in the table."""
    from spectraloom.llm import quality_rules

    words = " ".join(f"word{k}" for k in range(60))
    texts = ["A A A A"] * 300 + [words.upper()] * 40 + ["# " * 30 + words] * 90 + [words] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    others = [r for r in quality_rules.RULES if r[0] not in quality_rules.BASE]
    base = [r for r in quality_rules.RULES if r[0] in quality_rules.BASE]
    order = quality_rules.cascade_order(df, others, after=base, counts=["n_words", "n_symbols"])
    assert set(order[:2]) == {"symbols", "shouting"} and order[0] == "symbols"
    assert sorted(quality_rules._sampled(df, 10)) != sorted(texts[:10]) and len(quality_rules._sampled(df, 10)) == 10
