import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from spectraloom.llm import jaccard_join, packing, quality_rules
from spectraloom.sources.shared import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        held.append(docs)
    rules, classified, unique, mixed, packed = held
    assert all(d.columns == columns for d in held[:-1])
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in rules.collect()} == {r.doc_id for r in whole.collect() if not any(rule(quality_rules.Text(r.text)) for _, rule in quality_rules.RULES)}
    assert 0.8 * rules.count() < classified.count() <= rules.count()
    groups = jaccard_join.jaccard_components(classified)
    assert {r.doc_id for r in unique.collect()} == {r.component_id for r in groups.collect()}
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in unique.collect()}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert sorted(map(tuple, packing.pack(mixed, keep_ids=False).collect())) == sorted(map(tuple, packed.collect()))


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_tables(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, documents, odd_texts):
    prose = " ".join(f"word{i}" + "abcdefgh"[i % 8] for i in range(80))
    rows = list(enumerate(odd_texts)) + [(None, prose), (70, prose), (71, prose + " end"), (71, prose + " end"), (72, prose.upper())]
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    assert {r.doc_id for r in docs.collect()} <= {None, 70, 71}


def test_tables_between_stages_have_small_row_groups(spark, tmp_path, monkeypatch):
    """A task holds a whole row group of texts that it reads and one that it writes, so a small heap needs small ones."""
    text = F.expr("concat_ws(' ', transform(sequence(1, 300), k -> sha2(concat(id, ':', k), 256)))")
    spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("as it is", lambda spark, docs, sf_dir: docs)] * 2)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 2000
    held = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in out.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in held for i in range(m.num_row_groups)]
    assert sum(sizes) > 3e7 and max(sizes) < 1.5e7
