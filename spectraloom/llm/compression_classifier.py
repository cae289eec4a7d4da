"""Quality classifier by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is trained on texts labelled good, one on texts labelled bad. A text's feature is the difference of its
compressed sizes divided by its own size, ``(with bad - with good) / bytes``; a logistic curve fitted on labelled texts that
went into neither dictionary turns it into a probability, the classes weighted as they stand in all labels.

Fitting is bounded: from the labels at most ``SAMPLE`` rows of each class, the least by a hash of doc_id, with texts of at
most ``LONGEST`` bytes. Scoring covers every whole text. Neither label, lang, source nor doc_id enters a score.

Defined results: a null or empty text has the feature 0 and so the curve's score there; equal texts get equal scores; a label
without document, with a null, or repeated is left out or taken once (the larger quality), as is a document (the least of
its texts that fit); ids may be of any type; where a class has no usable text every score is the
share of good labels (0.5 with no labels); extra columns stay where a filter returns documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import pieces, table

SAMPLE = 1500
LONGEST = 32_000
DICTIONARY = 32_768
LEVEL = 3


def fold(doc_id: Column) -> Column:
    """0, 1 or 2: crc32 of the id as text, modulo 3. Labels of fold 1 are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or where there is too little to train on, the texts themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


class Compressors:
    def __init__(self, model: Model):
        self.each = []
        for held in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(held)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def feature(self, text: bytes) -> float:
        good, bad = (len(c.compress(text)) for c in self.each)
        return (bad - good) / max(1, len(text))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit by Newton's steps, with a slight pull of the slope to 0."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    beta, pull = np.zeros(2), np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + pull, a.T @ (weight * (y - p)) - pull @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labels given; the caller leaves out those to be held out."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    totals = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    order = F.md5(F.col("doc_id").cast("string"))
    first, second = (usable.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1))
    ids = F.broadcast(first.unionByName(second))  # 2 * sample ids
    short = docs.where(F.octet_length("text").between(1, LONGEST)).select("doc_id", "text")
    # one text an id, however often its row is repeated, so 2 * sample texts of LONGEST bytes at most
    chosen = short.join(ids, "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    rows = sorted((str(r["doc_id"])[::-1], r["quality"], r["text"]) for r in chosen.collect())
    texts = {q: [t.encode() for _, label, t in rows if label == q] for q in (0, 1)}
    n = sum(totals.values())
    if not all(len(t) >= 2 for t in texts.values()):
        p = min(max(totals.get(1, 0) / n, 1e-6), 1 - 1e-6) if n else 0.5
        return Model(b"", b"", 0.0, math.log(p / (1 - p)))
    made = Model(*(_dictionary(texts[q][::2]) for q in (1, 0)), 0.0, 0.0)
    c = Compressors(made)
    x = np.array([c.feature(t) for q in (0, 1) for t in texts[q][1::2]])
    y = np.repeat([0.0, 1.0], [len(texts[q][1::2]) for q in (0, 1)])
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum()) * (len(y) / n)
    return Model(made.good, made.bad, *_curve(x, y, weight))


def _scores(model: Model, batch: pa.RecordBatch, compressors: Compressors | None) -> list[float]:
    out = []
    for t in batch.column("text"):
        text = (t.as_py() or "").encode()
        z = model.offset + (model.slope * compressors.feature(text) if compressors else 0.0)
        out.append(1 / (1 + math.exp(-min(max(z, -700.0), 700.0))))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(held.value) if held.value.slope else None
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(held.value, batch, c), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(held.value) if held.value.slope else None
        for batch in pieces(batches):
            yield batch.filter(pa.array([s >= least for s in _scores(held.value, batch, c)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(F.col("doc_id")) != 1))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
