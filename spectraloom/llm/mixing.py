"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells by source, language and topic. The cells' token sums are raked: in each sweep they are scaled to
the target share of every source, then of every language, then of every topic. After the sweeps a cell's weight over its
tokens, divided by the largest such ratio, is the chance with which each of its documents is kept, so expected tokens
stand in the fitted proportions and no document is repeated. A document's draw is a hash of its id.

Topics are learned from the documents: of each language the ``ANCHORS`` words that most documents hold, among those of at
least ``ANCHOR_LETTERS`` characters that at most ``COMMON`` and at least ``SCARCE`` of its documents hold. A document's topic
is the anchor with the largest product of its count in the text and its logarithmic rarity in the language.

The target share of a level is its share of tokens to the power ``ALPHA``, scaled to sum 1, unless targets are given.
Targets that contradict each other can't be met: ``residual`` tells how far a fit is from them, and a fit that is further
off than ``TOLERANCE`` is warned of.

The cells, not the documents, go through the sweeps, by windows over their few columns, and are written after each, so that
the driver plans one sweep at a time; the fitted rates are joined to the documents by whichever join the planner finds their
size fit for. Anchors are bounded: a language needs a thousandth of
all documents to have any, so they are ``ANCHORS`` times a thousand at most and travel by broadcast.

Defined results: a null source or language is the level ''; a null or empty text has no tokens and the topic ''; a text
without an anchor has the topic ''; ties of words go to the one that sorts first; a cell without tokens is kept whole
(rate 1); a null doc_id draws by its text; equal rows share their draw; extra columns stay in ``sample_mixture``; an empty
table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import UPPER, salted_hash, table
from spectraloom.sources.shared import written

DIMENSIONS = ("source", "lang", "topic")
ALPHA = 0.9
SWEEPS = 12
TOLERANCE = 1e-3
ANCHORS = 4
ANCHOR_LETTERS = 4
COMMON, SCARCE = 0.1, 0.005
LEAST_LANGUAGE = 1000  # a language needs one document in so many
SALTS = 64
GAP = r"[\x20\x09-\x0D]+"


def _parts(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), GAP)


def _evened(text: Column) -> Column:
    """The text with A-Z in small letters and spaces for all its white space, in one pass."""
    return F.translate(text, UPPER + "\t\n\x0b\x0c\r", UPPER.lower() + " " * 5)


def word_count(text: Column) -> Column:
    """Words between ASCII white space, the tokens that are weighed."""
    parts = _parts(text)
    n = F.size(parts)
    return (n - (parts[0] == "").cast("int") - F.when(n > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)).cast("long")


def anchors(docs: DataFrame) -> DataFrame:
    """lang, anchors: each language's anchor words, in order, with their rarity (the logarithm of its documents over theirs)."""
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    n = docs.groupBy(lang).agg(F.count("*").alias("docs"))
    n = n.withColumn("all", F.sum("docs").over(Window.partitionBy())).where(F.col("docs") * LEAST_LANGUAGE >= F.col("all")).drop("all")  # a row a language
    words = docs.select(lang, F.explode(F.array_distinct(F.split(_evened(F.col("text")), " "))).alias("word")).where(F.length("word") >= ANCHOR_LETTERS)
    held = words.groupBy("lang", "word").agg(F.count("*").alias("n")).join(F.broadcast(n), "lang")
    # a language has no more words of at least this share than its documents' mean number of words over the share
    held = held.where((F.col("n") <= COMMON * F.col("docs")) & (F.col("n") >= SCARCE * F.col("docs")))
    order = [F.desc("n"), "word"]
    salted = held.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))  # first of every salt, so that no task ranks a whole language
    few = salted.withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= ANCHORS)
    best = few.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("i") <= ANCHORS)
    each = F.struct("word", F.ln(F.col("docs") / F.col("n")).alias("rarity"))
    return best.groupBy("lang").agg(F.array_sort(F.collect_list(each)).alias("anchors"))


def with_topic(docs: DataFrame, learned: DataFrame, into: str = "topic") -> DataFrame:
    """``docs`` with the topic of each row by ``learned`` anchors.

    A word stands between spaces of its own in a text whose white space is doubled, so it is counted by what is left without it.
    """
    known = learned.select(F.col("lang").alias("__of"), F.col("anchors").alias("__anchors"))
    held = docs.join(F.broadcast(known), F.coalesce("lang", F.lit("")) == F.col("__of"), "left")
    spaced = F.replace(_evened(F.col("text")), F.lit(" "), F.lit("  "))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  # a row made of a row: what is worked out here isn't worked out again by what reads it
    held = held.select("*", once(F.when(F.col("__anchors").isNotNull(), F.concat(F.lit(" "), spaced, F.lit(" ")))).alias("__words"))

    def weight(i: int) -> Column:
        anchor = F.get("__anchors", F.lit(i))
        alone = F.concat(F.lit(" "), anchor["word"], F.lit(" "))
        count = (F.octet_length("__words") - F.octet_length(F.replace("__words", alone, F.lit("")))) / F.octet_length(alone)
        return F.struct(F.coalesce(count * anchor["rarity"], F.lit(0.0)).alias("weight"), F.lit(-i).alias("i"), anchor["word"].alias("word"))

    best = F.greatest(*(weight(i) for i in range(ANCHORS)), F.struct(F.lit(0.0).alias("weight"), F.lit(1).alias("i"), F.lit("").alias("word")))
    return held.select(*docs.columns, once(best["word"]).alias(into))


def _draw() -> Column:
    return salted_hash(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))) / float(1 << 52)


def described(docs: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens and the draw of every row."""
    # only these columns, so that no other column's name can clash with one of ours
    docs = docs.select("doc_id", "text", "source", "lang")
    return with_topic(docs, anchors(docs) if learned is None else learned).select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        "topic",
        word_count(F.col("text")).alias("n_tokens"),
        _draw().alias("draw"),
    )


def power_targets(cells: DataFrame, alpha: float = ALPHA) -> dict[str, DataFrame]:
    """For each dimension its levels' target shares: level, share."""
    out = {}
    for d in DIMENSIONS:
        levels = cells.groupBy(F.col(d).alias("level")).agg(F.sum("n").alias("n")).where("n > 0")
        powered = levels.select("level", F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("p"))
        whole = powered.agg(F.sum("p")).first()[0] or 1.0
        out[d] = powered.select("level", (F.col("p") / whole).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (source, lang, topic, n) with the fitted share ``w`` of each; cells of a level without target get none."""
    for d in DIMENSIONS:
        cells = cells.join(targets[d].select(F.col("level").alias(d), F.col("share").alias(f"to_{d}")), d, "left")
    swept = cells.withColumn("w", F.col("n").cast("double"))
    for done in range(sweeps):
        if done:
            swept = written(swept, "sweep")
        for d in DIMENSIONS:
            whole = F.sum("w").over(Window.partitionBy(d))
            swept = swept.withColumn("w", F.when(whole > 0, F.col("w") * F.coalesce(f"to_{d}", F.lit(0.0)) / whole).otherwise(0.0))
    return swept.select(*DIMENSIONS, "n", "w")


def residual(fitted: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest difference between a level's fitted share and its target; 0 for no levels."""
    worst = None
    for d in DIMENSIONS:
        off = fitted.groupBy(F.col(d).alias("level")).agg(F.sum("w").alias("w")).join(targets[d], "level", "full")
        one = off.agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("share", F.lit(0.0)))).alias("off"))
        worst = one if worst is None else worst.unionByName(one)
    return worst.agg(F.max("off")).first()[0] or 0.0


def cell_rates(rows: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """source, lang, topic, rate (rounded to 6 places) of every cell of ``described`` rows."""
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), "cells")
    targets = targets or power_targets(cells)
    fitted = written(rake(cells, targets), "fitted")
    off = residual(fitted, targets)
    if off > TOLERANCE:
        warnings.warn(f"the targets aren't met: a level's share is off by {off:.3g}", stacklevel=2)
    peak = fitted.agg(F.max(F.when(F.col("n") > 0, F.col("w") / F.col("n")))).first()[0] or 1.0
    rate = F.when(F.col("n") > 0, F.col("w") / F.col("n") / peak).otherwise(1.0)
    return fitted.select(*DIMENSIONS, F.round(rate, 6).alias("rate"))


def mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, rate and whether the document is kept."""
    rows = written(described(docs), "described")
    joined = rows.join(cell_rates(rows, targets), list(DIMENSIONS))
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", "rate", (F.col("draw") < F.col("rate")).alias("kept"))


def sample_mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents kept, with all their columns.

    Only narrow columns are written. A draw below all rates of its source and language, whatever the topic, keeps a document,
    one that isn't below any drops it; the topic is worked out again for the others alone.
    """
    learned = written(anchors(docs), "anchors")
    rates = written(cell_rates(described(docs, learned), targets), "rates")
    bounds = rates.groupBy(F.col("source").alias("__source"), F.col("lang").alias("__lang")).agg(F.min("rate").alias("__low"), F.max("rate").alias("__high"))
    level = lambda c: F.coalesce(c, F.lit(""))
    bounded = docs.withColumn("__draw", _draw()).join(bounds, (level("source") == F.col("__source")) & (level("lang") == F.col("__lang")))
    sure = bounded.where("__draw < __low").select(*docs.columns)
    open_ = with_topic(bounded.where("__draw >= __low and __draw < __high").select(*docs.columns, "__draw"), learned, "__topic")
    cell = rates.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__cell"), F.col("rate").alias("__rate"))
    same = (level("source") == F.col("__source")) & (level("lang") == F.col("__lang")) & (F.col("__topic") == F.col("__cell"))
    return sure.unionByName(open_.join(cell, same).where("__draw < __rate").select(*docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _sql() -> str:
    steps, last = [], "w0"
    for i in range(SWEEPS * len(DIMENSIONS)):
        d = DIMENSIONS[i % len(DIMENSIONS)]
        steps.append(f"w{i + 1} AS (SELECT * REPLACE (w * to_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM {last})")
        last = f"w{i + 1}"
    share = "SELECT {d}, p / sum(p) OVER () AS to_{d} FROM (SELECT {d}, pow(sum(n)::DOUBLE, {a}) AS p FROM cells GROUP BY {d} HAVING sum(n) > 0)"
    to = ", ".join(f"t{d} AS ({share.format(d=d, a=ALPHA)})" for d in DIMENSIONS)
    return rf"""
WITH x AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT lang, count(*) AS docs FROM x GROUP BY lang QUALIFY count(*) * {LEAST_LANGUAGE} >= sum(count(*)) OVER ()),
h AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(words)) AS word FROM x) WHERE length(word) >= {ANCHOR_LETTERS} GROUP BY ALL),
k AS (SELECT lang, word, ln(docs / n) AS rarity FROM h JOIN l USING (lang) WHERE n <= {COMMON} * docs AND n >= {SCARCE} * docs
      QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {ANCHORS}),
a AS MATERIALIZED (SELECT lang, list({{'word': word, 'rarity': rarity}} ORDER BY word) AS anchors FROM k GROUP BY lang),
d AS MATERIALIZED (SELECT doc_id, source, lang, len(words)::BIGINT AS n_tokens,
  coalesce(list_sort(list_transform(list_filter(list_transform(anchors, lambda y: {{'weight': -len(list_filter(words, lambda w: w = y.word)) * y.rarity, 'word': y.word}}), lambda z: z.weight < 0), lambda z: z))[1].word, '') AS topic,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(x))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM x LEFT JOIN a USING (lang)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n FROM d GROUP BY ALL),
{to},
w0 AS (SELECT *, n::DOUBLE AS w FROM cells LEFT JOIN tsource USING (source) LEFT JOIN tlang USING (lang) LEFT JOIN ttopic USING (topic)),
{', '.join(steps)},
r AS (SELECT source, lang, topic, round(CASE WHEN n > 0 THEN w / n / max(CASE WHEN n > 0 THEN w / n END) OVER () ELSE 1.0 END, 6) AS rate FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, rate, draw < rate AS kept FROM d JOIN r USING (source, lang, topic)"""


ORACLE_SQL = _sql()
