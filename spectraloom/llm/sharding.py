"""Sharding by rendezvous hashing over weighted shards, law ``key``: a record's key and the shard list decide alone.

Every shard draws a number for every key; the shard with the best weighted draw, ``weight / -ln(draw)``, holds the record.
A new shard wins only the records whose best draw becomes its own, so no record moves between old shards. Placement is
a projection; nothing is shuffled for it. The slot, a gapless number within a shard, takes one shuffle of the narrow
columns: keys are cut into ranges of their hash, numbered within each range, and the ranges' counts (at most 4096 for
a shard) give each range its start. Both sides of that join are dealt by shard and range already.

Defined results: a null key is a key like any other (the text ``null``); a null text has size 1 and the CRC of no bytes;
rows alike in key and content get neighbouring slots, in any order, as they are the same rows; equal texts under different
keys may part; extra columns pass through ``place``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import table

DIGITS = 3  # of the key's hash make a range: 4096 of them


def _draw(key: Column, shard: int) -> Column:
    """A number above 0 and below 1 for a key at a shard."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"@{shard}"))), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a string key; ``weights[s]`` is the share that shard s gets. Ties go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need weights above 0")
    scored = [F.struct((F.lit(-float(w)) / F.ln(_draw(key, s))).alias("score"), F.lit(-s).alias("s")) for s, w in enumerate(weights)]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["s"]).cast("int")


def key_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def place(df: DataFrame, key: str, weights: list[float], into: str = "shard") -> DataFrame:
    """``df`` with the shard of each row."""
    return df.withColumn(into, rendezvous(key_text(F.col(key)), weights))


def number(df: DataFrame, group: str, key: str, within: list[str], into: str = "slot") -> DataFrame:
    """``df`` with a gapless number from 0 in each group, in the order of the key's hash, the key and ``within``.

    No task holds a whole group: rows are numbered within ranges of the hash, and the ranges are added up.
    """
    hashed = df.withColumn("__h", F.md5(key_text(F.col(key)))).withColumn("__r", F.substring("__h", 1, DIGITS))
    counts = hashed.groupBy(group, "__r").count()
    starts = counts.select(group, "__r", (F.sum("count").over(Window.partitionBy(group).orderBy("__r")) - F.col("count")).alias("__start"))
    by = Window.partitionBy(group, "__r").orderBy("__h", key, *within)
    ranked = hashed.withColumn("__n", F.row_number().over(by))
    return ranked.join(starts, [group, "__r"]).withColumn(into, (F.col("__start") + F.col("__n") - 1).cast("long")).drop("__h", "__r", "__start", "__n")


def op4_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(place(narrow, "doc_id", [1.0] * shards), "doc_id", [1.0] * (shards + 1), "grown_shard")
    return number(placed, "shard", "doc_id", ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql(shards: int = 8) -> str:
    """CRC-32 is linear over two-element arithmetic: what a byte turns the register by is the sum of what its bits do."""
    step = [1]
    for bit in range(8):
        r = 1 << bit
        for _ in range(8):
            r = r >> 1 ^ (0xEDB88320 if r & 1 else 0)
        step.append(r)
    turned = lambda x: "0"
    for bit in range(8):
        turned = lambda x, bit=bit, inner=turned: f"xor({inner(x)}, (({x} >> {bit}) & 1) * {step[bit + 1]})"
    low = "(xor(c, b) & 255)"
    draw = lambda s: f"(-1.0 / ln((('0x' || substr(md5(k || '@{s}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE))"
    best = lambda n: f"list_position([{', '.join(draw(s) for s in range(n))}], list_max([{', '.join(draw(s) for s in range(n))}])) - 1"
    return f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
p AS (SELECT doc_id, k, (octet_length(raw) + 1)::BIGINT AS size, ({best(shards)})::INT AS shard, ({best(shards + 1)})::INT AS grown_shard,
  list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT)) AS v FROM t),
c AS (SELECT * EXCLUDE (v), xor(list_reduce(v, lambda c, b: xor(c >> 8, {turned(low)})), 4294967295)::BIGINT AS text_crc32 FROM p)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard FROM c"""


ORACLE_SQL = _sql()
