"""Phrases of two and three words that occur together more often than their words or parts would.

Words are dictionary-encoded: workers give a chunk of texts as numbers of the chunk's own dictionary, the dictionaries are added
up by Spark, frequent words get gapless ids, and each chunk gets back the ids of its own words only, so no vocabulary is held
whole anywhere. Pieces break at rare words, which no frequent phrase can hold. A chunk's n-grams are packed into keys
of three 32-bit ids (a pair's third is 0), radix-sorted and run-length counted; the counted keys are dealt to ranges of
the key space, and each range is sorted and counted again the same way, batch by batch.

Ranges are cut by the words' own counts: word w covers ``[before, before + f)`` of all frequent occurrences, a key lies at
``before1 + f1 * (before2 + f2 * before3 / all) / all``, and a range is ``RANGE`` of that. So a hot first word is spread over
its second and third words. What a task holds is at most a range's distinct keys and one batch.

Defined results: a null text has no words; a null language is ``und``; repeated rows count as often as they stand; extra columns
take no part; an empty table gives an empty result. Counts are longs, scores are exact by decimals (up to 10 ** 14 places).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import UPPER, pieces, table
from spectraloom.sources.shared import Steps, written

LEAST = 10  # occurrences of a candidate
WITHIN = 50  # per cent of a candidate's occurrences inside a longer one
TOP = 2000
CHUNK = 8 << 20  # bytes of text
SALTS = 8  # of a language's phrases are ranked by themselves first
SORTED = 1 << 20  # words whose n-grams are sorted at a time
RANGE = 1 << 20  # occurrences
MOST_WORDS = (1 << 32) - 2
#: A-Z become small, all that ends a piece becomes a full stop, tabs become spaces.
PLAIN = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if chr(b) in UPPER else b for b in range(256))


class Numbers(dict):
    """Words in the order they were met; 0 is the full stop."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """A text, cut at ends of pieces where it is longer than ``most``; a longer piece stays whole."""
    first = 0
    while len(text) - first > most:
        at = text.rfind(b".", first, first + most)
        at = at if at >= 0 else text.find(b".", first + most)
        if at < 0:
            break
        yield text[first:at]
        first = at + 1
    yield text[first:]


def _encode(texts: list[bytes]) -> tuple[Numbers, np.ndarray]:
    numbers = Numbers({b".": 0})
    words = b".".join(texts).replace(b".", b" . ").split()
    return numbers, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))


_CHUNKS = "chunk long, lang string, ids binary, n long, word string, local int"


def _chunks(chunk_bytes: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk of one language a row with its words' numbers, and a row for each word with its count."""
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            numbers, ids = _encode(held.pop(lang))
            counts = np.bincount(ids, minlength=len(numbers))
            size.pop(lang)
            packed = ids.astype(np.uint16) if len(numbers) <= 1 << 16 else ids
            n = len(numbers) - 1
            chunk, made = (part << 32) + made, made + 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * (n + 1), pa.int64()),
                    pa.array([lang] * (n + 1)),
                    pa.array([packed.tobytes()] + [None] * n, pa.binary()),
                    pa.array(np.concatenate([[len(ids)], counts[1:]]).astype(np.int64)),
                    pa.array([None, *[w.decode() for w in list(numbers)[1:]]], pa.string()),
                    pa.array(np.arange(n + 1, dtype=np.int32)),
                ],
                names=["chunk", "lang", "ids", "n", "word", "local"],
            )

        for batch in pieces(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                lang = "und" if lang is None else lang
                for cut in _cut(text.encode().translate(PLAIN), chunk_bytes):
                    held.setdefault(lang, []).append(cut)
                    size[lang] = size.get(lang, 0) + len(cut) + 1
                    if sum(size.values()) > chunk_bytes:
                        yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    return chunks


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order of keys given as 32-bit columns, the most significant first: passes over 16-bit digits."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16):
            digit = (column >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    if not len(counts):
        return columns, counts
    order = radix_order(columns)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first)


def _grams(ids: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Keys of all pairs and triples of a chunk's ids, a slice at a time; 0 breaks."""
    for k in range(0, len(ids), SORTED):
        a, b, c = (np.pad(ids[k + j : k + j + SORTED], (0, max(0, min(SORTED, len(ids) - k) - len(ids[k + j : k + j + SORTED])))) for j in range(3))
        pair = np.flatnonzero((a > 0) & (b > 0))
        triple = pair[c[pair] > 0]
        at = np.concatenate([pair, triple])
        yield [a[at], b[at], np.concatenate([np.zeros(len(pair), np.uint32), c[triple]])]


def _keys(total: int, span: int):
    """Counted keys of a chunk, packed range by range."""

    def keys(stream: pa.Table, words: pa.Table) -> pa.Table:
        out: dict[str, list] = {"range": [], "keys": [], "counts": []}
        if stream.num_rows:
            n, packed = stream.column("n")[0].as_py(), stream.column("ids")[0].as_py()
            local = np.frombuffer(packed, np.uint16 if len(packed) == 2 * n else np.uint32)
            where = words.column("local").to_numpy()
            known = max(int(local.max(initial=0)), int(where.max(initial=0))) + 1
            ids, before, count = np.zeros(known, np.uint32), np.zeros(known), np.zeros(known)
            ids[where] = words.column("id").to_numpy()
            before[where], count[where] = words.column("before").to_numpy(), words.column("f").to_numpy()
            local_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32) if int(ids.max(initial=0)) < 1 << 22 else None
            if local_of is not None:
                local_of[ids[where]] = where
            by_id = np.argsort(ids)
            for columns in _grams(ids[local]):
                if not len(columns[0]):
                    continue
                columns, counts = run_lengths(columns, np.ones(len(columns[0]), np.int64))
                x, y, z = (local_of[c] if local_of is not None else by_id[np.searchsorted(ids, c, sorter=by_id)] for c in columns)
                inner = np.where(columns[2] > 0, before[z], 0.0) / total
                at = ((before[x] + count[x] * ((before[y] + count[y] * inner) / total)) // span).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                for first, last in zip(cut, [*cut[1:], len(at)], strict=True):
                    out["range"].append(int(at[first]))
                    out["keys"].append(np.concatenate([c[first:last] for c in columns]).tobytes())
                    out["counts"].append(counts[first:last].tobytes())
        return pa.table({"range": pa.array(out["range"], pa.int64()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return keys


def _counted(least: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys with their counts over all chunks, ``least`` or more; rows come sorted by range."""
        at, columns, counts, waiting, size = None, [np.empty(0, np.uint32)] * 3, np.empty(0, np.int64), [], 0

        def settle() -> None:
            nonlocal columns, counts, waiting, size
            columns, counts = run_lengths([np.concatenate([c, *[w[0][k] for w in waiting]]) for k, c in enumerate(columns)], np.concatenate([counts, *[w[1] for w in waiting]]))
            waiting, size = [], 0

        def result() -> pa.RecordBatch:
            settle()
            kept = np.flatnonzero(counts >= least)
            return pa.RecordBatch.from_arrays([*[pa.array(c[kept].astype(np.int64)) for c in columns], pa.array(counts[kept])], names=["w1", "w2", "w3", "a"])

        for batch in pieces(batches, "keys"):
            for where, keys, n in zip(batch.column("range").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if where != at:
                    if at is not None:
                        yield result()
                    at, columns, counts = where, [np.empty(0, np.uint32)] * 3, np.empty(0, np.int64)
                waiting.append((np.frombuffer(keys, np.uint32).reshape(3, -1), np.frombuffer(n, np.int64)))
                size += len(n) // 8
                if size > max(SORTED, len(counts)):
                    settle()
        if at is not None:
            yield result()

    return counted


def dictionary(counts: DataFrame) -> DataFrame:
    """lang, word, f, id (from 1, gapless, by a hash) and before (occurrences of words with lower ids) of counted words."""
    hashed = counts.withColumn("h", F.xxhash64("lang", "word")).withColumn("r", F.shiftright("h", 52))  # 4096 ranges
    sizes = hashed.groupBy("r").agg(F.count("*").alias("words"), F.sum("f").alias("places"))
    so_far = Window.orderBy("r")  # of at most 4096 rows
    starts = sizes.select("r", (F.sum("words").over(so_far) - F.col("words")).alias("id0"), (F.sum("places").over(so_far) - F.col("places")).alias("before0"))
    within = Window.partitionBy("r").orderBy("h", "lang", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hashed.withColumn("k", F.count("*").over(within)).withColumn("p", F.sum("f").over(within) - F.col("f"))
    return ranked.join(starts, "r").select("lang", "word", "f", (F.col("id0") + F.col("k")).alias("id"), (F.col("before0") + F.col("p")).alias("before"))


def _score(a: str, left: str, right: str):
    big = lambda c, digits: f"cast({c} as decimal({digits}, 0))"
    return F.expr(f"({big(1000000, 7)} * {big(a, 14)} * {big(a, 14)}) div ({big(left, 18)} * {big(right, 18)})")


def phrases(docs: DataFrame, least: int = LEAST, within: int = WITHIN, chunk: int = CHUNK, span: int = RANGE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate that no longer one holds in ``within`` per cent or more of its places."""
    spark, steps = docs.sparkSession, Steps(docs.sparkSession)
    chunks = steps.written(docs.select("lang", "text").mapInArrow(_chunks(chunk), _CHUNKS), "chunks")
    words = chunks.where("word is not null").select("chunk", "lang", "word", "local", "n")
    counts = steps.written(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = written(counts.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
    known = written(dictionary(counts.where(F.col("f") >= least)), "dictionary")
    total, most = known.agg(F.sum("f"), F.count("*")).first()
    if most > MOST_WORDS:
        raise ValueError("a key has 32 bits for a word")
    own = words.join(known, ["lang", "word"]).select(F.col("chunk").alias("of"), "local", "id", "before", "f")
    streams = chunks.where("ids is not null").select("chunk", "ids", "n")
    keys = streams.groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(_keys(total or 1, span), "range long, keys binary, counts binary")
    tasks = min(65536, max(spark.sparkContext.defaultParallelism, (total or 0) // span + 1))
    counted = keys.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(_counted(least), "w1 long, w2 long, w3 long, a long")
    found = steps.written(counted, "phrases")

    pairs, triples = found.where("w3 = 0"), found.where("w3 > 0")
    inside = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    most_inside = inside.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    free = pairs.join(most_inside, ["w1", "w2"], "left").where(f"longer is null or 100 * longer < {within} * a").select("w1", "w2", "w3", "a")
    part = lambda x, y, name: pairs.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name))
    cut = triples.join(part("w1", "w2", "f12"), ["w1", "w2"]).join(part("w2", "w3", "f23"), ["w2", "w3"])
    whole = cut.unionByName(free, allowMissingColumns=True)
    for k in (1, 2, 3):
        of = known.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"x{k}"), F.col("f").alias(f"f{k}"), *["lang"] * (k == 1))
        whole = whole.join(of, f"w{k}", "inner" if k < 3 else "left")
    whole = whole.withColumn("first", _score("a", "f1", "coalesce(f23, f2)")).withColumn("second", F.when(F.col("w3") > 0, _score("a", "f12", "f3")))
    later = F.coalesce(F.col("second") < F.col("first"), F.lit(False))
    scored = whole.select(
        "lang",
        F.concat_ws(" ", "x1", "x2", "x3").alias("phrase"),
        "a",
        F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f3")).otherwise(F.coalesce("f23", "f2")).alias("r"),
        F.when(later, F.col("second")).otherwise(F.col("first")).alias("score"),
    )
    scored = written(scored, "scored")
    steps.drop()
    return scored.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best_phrases(docs: DataFrame, top: int = TOP, **kwargs) -> DataFrame:
    """The first ``top`` of ``phrases`` of each language by score, occurrences and phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = phrases(docs, **kwargs).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_phrases(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, len(x) AS k, x FROM (
  SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i])) AS x FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) FROM w)),
f AS MATERIALIZED (SELECT lang, k, x, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, x, f AS a FROM f WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT c.lang, c.k, c.x, c.a, j.f AS l, r.f AS r, j.k AS cut, ((1000000::HUGEINT * c.a * c.a) // (j.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f j ON j.lang = c.lang AND j.k < c.k AND j.x = c.x[1:j.k] JOIN f r ON r.lang = c.lang AND r.k = c.k - j.k AND r.x = c.x[j.k + 1:]),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, cut) = 1),
gone AS (SELECT DISTINCT lang, x FROM (SELECT lang, x[1:2] AS x, a AS longer FROM c WHERE k = 3 UNION ALL SELECT lang, x[2:3], a FROM c WHERE k = 3) i
  JOIN c USING (lang, x) WHERE c.k = 2 AND 100 * i.longer >= {WITHIN} * c.a),
kept AS (SELECT low.lang, array_to_string(x, ' ') AS phrase, a, l, r, n, score FROM low ANTI JOIN gone USING (lang, x) JOIN n USING (lang))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= {TOP}"""
