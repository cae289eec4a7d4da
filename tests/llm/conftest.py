import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of texts, or of (doc_id, text) pairs; further columns have names that operators use inside."""

    def make(texts, more=True, kind="long"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, ("en", "de", None)[k % 3], f"src{k % 4}" if k % 7 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(rows, DOCS.replace("doc_id long", f"doc_id {kind}"))
        if more:
            from pyspark.sql import functions as F

            for name in ("h", "class_id", "template", "digest", "shard", "slot", "rate", "score", "length", "topic", "n_tokens", "media", "a", "b", "key", "part", "items"):
                df = df.withColumn(name, F.lit("extra"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, one word, long, repeated and non-ASCII texts."""
    return [None, "", " \n\t ", "word", "word", "Ünï cödé 日本語 text\x1cwith\x0bseparators", "a b c d", "a b c d e", "x " * 30_000, "<|endoftext|> it's don't 'S", "K İ ſ Σς", "line one\nline one\n\n \nline two", "#*$%&|<>" * 9]
