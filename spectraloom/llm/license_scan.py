"""License scans by diagonal voting.

Every rolling word k-gram of every text is joined to the k-grams of the templates. A match of word ``i`` with
template position ``j`` is a vote for the diagonal ``i - j``, the word where the template would start. Votes are
summed by diagonal, neighbouring diagonals (a word inserted or left out) are merged, and a merged span counts when
the words it covers make up enough of the template within a span of about the template's length. Diagonals of chance
pairs may chain on beyond that length; such a chain is looked at again, from each of its diagonals over about that length.
A word that stands alone between changed ones is in no pair and isn't covered.

The template table is a few hundred rows whatever the corpus is, so it is the side that is broadcast. Word pairs are
hashed to 64 bits batch by batch with numpy (``textwords``); joining, voting, merging and verifying are Spark's.

Defined results: a null or empty text has no words and no hits; equal rows get equal results; rows with the same
``doc_id`` and different texts are told apart by the text's hash; a null ``doc_id`` is a key like any other; extra
columns are ignored. Ties don't arise: every place counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import pieces, table
from spectraloom.llm.textwords import ALNUM, text_hash, windows, word_hashes

K = 2
#: What stands between words: ASCII but for digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Places of these phrases are counted exactly. Fixed values.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Notices that the method finds with a few words changed; wording of the public licences. At most 62 words each.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("this program is free software you can redistribute it and or modify it", "gpl-text"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
]
MAX_WORDS = 62
MIN_COVERAGE = 0.8
MAX_SHIFT = 2


def _parts(text: Column) -> Column:
    """The text cut at what isn't a word; an empty first or last part stands for a gap at that end."""
    return F.split(F.coalesce(text, F.lit("")), GAP)


def n_words_of(text: Column) -> Column:
    parts = _parts(text)
    n = F.size(parts)
    return (n - (parts[0] == "").cast("int") - F.when(n > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)).cast("long")


def _rolled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, hashes = batch.column("doc_id"), batch.column("text_hash").to_numpy(zero_copy_only=False)
        for _, _, h, row in word_hashes(batch.column("text"), ALNUM):
            gram, of, at = windows(h, row, K)
            first = np.searchsorted(row, of)  # the place of the text's first word
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(hashes[of]), pa.array((at - first).astype(np.int32)), pa.array(gram.view(np.int64))], ["doc_id", "text_hash", "i", "h"])


def rolling_grams(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, i, h: every word pair of every text, by the place of its first word."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_rolled, f"doc_id {kind}, text_hash long, i int, h long")


def template_table(spark: SparkSession, base=None, notices=None) -> DataFrame:
    """One row per template position: template, label, is_base, m (words), j, h (the hash of the words at j)."""
    rows = []
    for is_base, group in ((True, BASE_PHRASES if base is None else base), (False, NOTICES if notices is None else notices)):
        for phrase, label in group:
            w = phrase.split()
            if not K <= len(w) <= MAX_WORDS:
                raise ValueError(f"a template needs {K} to {MAX_WORDS} words: {phrase!r}")
            rows += [(f"{'base' if is_base else 'notice'}:{phrase}", label, is_base, len(w), j, text_hash(w[j : j + K])[0]) for j in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "template string, label string, is_base boolean, m int, j int, h long")


def license_spans(docs: DataFrame, templates: DataFrame, min_coverage: float = MIN_COVERAGE, max_shift: int = MAX_SHIFT) -> DataFrame:
    """Verified spans: doc_id, text_hash, template, label, is_base, start_word, end_word, coverage.

    ``docs`` needs doc_id and text. Base templates count only where all their words stand consecutively; others where
    the merged diagonals cover ``min_coverage`` of the template's words within a span of about its length.
    """
    cells = templates.select("h", "j", F.xxhash64("template").alias("t"))
    about = templates.select(F.xxhash64("template").alias("t"), "template", "label", "is_base", "m").distinct()
    votes = (
        rolling_grams(docs)
        .join(F.broadcast(cells), "h")
        .groupBy("doc_id", "text_hash", "t", (F.col("i") - F.col("j")).alias("diagonal"))
        .agg(F.bit_or(F.expr("shiftleft(3L, j)")).alias("covered"), F.min("i").alias("i0"), (F.max("i") + 1).alias("i1"))
        .join(F.broadcast(about), "t")
    )
    exact = votes.where(F.col("is_base") & (F.bit_count("covered") == F.col("m")) & F.expr("i1 - i0 + 1 = m"))
    exact = exact.select("doc_id", "text_hash", "template", "label", "is_base", F.col("i0").alias("start_word"), F.col("i1").alias("end_word"), F.lit(1.0).alias("coverage"))
    by = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    chain = Window.partitionBy("doc_id", "text_hash", "template", "span")
    longest = 1.25 * F.col("m") + 2
    # one diagonal spans at most m words, so those from d to d + longest - m span at most the longest
    starts = F.sequence(F.col("diagonal") - F.floor(longest - F.col("m")).cast("int"), F.col("diagonal"))
    merged = (
        votes.where(~F.col("is_base"))
        .withColumn("opens", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > max_shift).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("opens").over(by))
        .withColumn("words", F.max("i1").over(chain) - F.min("i0").over(chain) + 1)
        .withColumn("start", F.explode(F.when(F.col("words") <= longest, F.array(F.lit(None).cast("int"))).otherwise(starts)))
        .groupBy("doc_id", "text_hash", "template", "label", "is_base", "m", "span", "start")
        .agg(F.bit_or("covered").alias("covered"), F.min("i0").alias("start_word"), F.max("i1").alias("end_word"))
        .withColumn("coverage", F.bit_count("covered") / F.col("m"))
    )
    verified = merged.where((F.col("coverage") >= min_coverage) & (F.col("end_word") - F.col("start_word") + 1 <= longest))
    # of one place's overlapping spans the best
    before = chain.orderBy("start_word", "end_word", "start").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("start_word") > F.max("end_word").over(before)).cast("int"), F.lit(1))
    order = chain.orderBy("start_word", "end_word", "start").rowsBetween(Window.unboundedPreceding, 0)
    verified = verified.withColumn("opens", opens).withColumn("place", F.sum("opens").over(order))
    best = F.max_by(F.struct("start_word", "end_word", "coverage"), F.struct("coverage", F.col("start_word") - F.col("end_word"), "start_word"))
    verified = verified.groupBy("doc_id", "text_hash", "template", "label", "is_base", "span", "place").agg(best.alias("best")).select("*", "best.*")
    return exact.unionByName(verified.select(*exact.columns))


def license_labels(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per row of ``docs``: what ``license_spans`` found in it, joined back by document and text."""
    base = F.col("is_base")
    found = (
        license_spans(docs, templates)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start_word"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start_word"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("coverage").alias("score"),
        )
    )
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words_of(F.col("text")).alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    return each.join(found.alias("f"), same, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"), template_table(spark))


def _sql() -> str:
    rows = [
        (f"{kind}:{phrase}", label, str(kind == "base").lower(), len(w), j, " ".join(w[j : j + K]))
        for kind, group in (("base", BASE_PHRASES), ("notice", NOTICES))
        for phrase, label in group
        for w in [phrase.split()]
        for j in range(len(w) - K + 1)
    ]
    values = ", ".join(f"('{t}', '{label}', {b}, {m}, {j}, '{g}')" for t, label, b, m, j, g in rows)
    lower = f"translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return rf"""
WITH templates(template, label, is_base, m, j, gram) AS (VALUES {values}),
words AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(range(len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) AS gram FROM words),
votes AS (SELECT doc_id, template, label, is_base, m, i - j AS diagonal, bit_or(3::BIGINT << j) AS covered, min(i) AS i0, max(i) + 1 AS i1
          FROM grams JOIN templates USING (gram) GROUP BY ALL),
base AS (SELECT doc_id, label, true AS is_base, i0 AS start_word, 1.0::DOUBLE AS coverage FROM votes WHERE is_base AND bit_count(covered) = m AND i1 - i0 + 1 = m),
seeds AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {MAX_SHIFT})::INT, 1) AS opens
          FROM votes WHERE NOT is_base),
spans AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM seeds),
sized AS (SELECT *, max(i1) OVER (PARTITION BY doc_id, template, span) - min(i0) OVER (PARTITION BY doc_id, template, span) + 1 AS words FROM spans),
started AS (SELECT *, unnest(CASE WHEN words <= 1.25 * m + 2 THEN [NULL::BIGINT] ELSE range(diagonal - floor(0.25 * m + 2)::BIGINT, diagonal + 1) END) AS start FROM sized),
merged AS (SELECT doc_id, label, m, bit_count(bit_or(covered)) / m::DOUBLE AS coverage, min(i0) AS start_word, max(i1) AS end_word
           FROM started GROUP BY doc_id, template, label, m, span, start),
hits AS (SELECT * FROM base UNION ALL
         SELECT doc_id, label, false, start_word, coverage FROM merged WHERE coverage >= {MIN_COVERAGE} AND end_word - start_word + 1 <= 1.25 * m + 2),
found AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(start_word) FILTER (is_base) AS first_word, max(start_word) FILTER (is_base) AS last_word,
                 array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels,
                 array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words w LEFT JOIN found USING (doc_id)"""


ORACLE_SQL = _sql()
