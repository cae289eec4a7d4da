"""Token counts through a digest cache.

A text is normalised where that can't change its count (runs of ASCII white space become one space, none stays at the
ends) and digested with SHA-256; the tokenizer's version is the digest of its vocabulary file. Counts are looked up in a
stored table by both digests. One text for each digest that the table lacks is encoded, and its count appended to
the table; every document then takes its count from there. So copies, and texts met in earlier runs, aren't encoded again.

Digests are worked out once a row and written with its id. The cache is a folder of Parquet files by tokenizer version, appended to by each run; a run that dies leaves whole files or none. Two
runs at once may both append a digest: both rows agree, and reading takes one.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; equal rows give equal results; rows that share a
doc_id, or have none, are told apart by their digests; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spectraloom.llm.common import pieces, table
from spectraloom.llm.tokens import Encoder, vocabulary_path
from spectraloom.sources.shared import scratch, written

LIMIT = 2048
CACHE_SCHEMA = "digest binary, n_tokens long, version string"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def content_digest(text: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(F.trim(spaced), 256))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; an empty table before the first append."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.where(F.col("version") == version).select("digest", "n_tokens")


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_bytes, digest of every row; ``mark`` is a quick hash that tells a document's texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest"))


def misses(docs: DataFrame, each: DataFrame, known: DataFrame) -> DataFrame:
    """digest, text: one text for each digest of ``each`` (the digested ``docs``) that ``known`` lacks.

    Only digests are grouped; a text moves once at most, keyed by its document, so a group of copies is no hot key.
    """
    chosen = each.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("c")).join(known, "digest", "left_anti")
    chosen = chosen.select("digest", F.col("c.doc_id").alias("doc_id"), F.col("c.mark").alias("mark")).alias("c")
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text").alias("t")
    first = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.mark") == F.col("c.mark"))
    return texts.join(chosen, first).select("digest", "text")


def encode_misses(missing: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens, encoded by the library."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done = Encoder(path, counts=True), set()
        for batch in pieces(batches):
            digests = batch.column("digest").to_pylist()
            fresh = [i for i, d in enumerate(digests) if d not in done and not done.add(d)]  # repeated rows
            counts = encoder.n_tokens([batch.column("text")[i].as_py() for i in fresh])
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(fresh, pa.int64())), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return missing.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: str, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; the cache at ``cache`` is brought up to date first."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    version = tokenizer_version(path)
    each = written(digested(docs), "digests")
    counted = encode_misses(misses(docs, each, read_cache(spark, cache, version)), path)
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache)
    known = read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return each.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """The query starts from an empty cache of its own, so that it does the whole work whenever it runs."""
    counted = count_tokens(table(spark, sf_dir, "documents"), cache or scratch(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
