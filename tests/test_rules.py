from pyspark.sql import functions as F

from spectraloom.functions import rules as U


def test_times_and_steps(spark):
    texts = ["2024-02-29T12:34:56Z", "2024-02-29T12:34:56.5Z", "1969-12-31 23:59:59Z", "2024-02-30T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01", None, "x"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(U.iso_micros(F.col("x")).alias("t")).collect()]
    assert got == [1709210096000000, 1709210096500000, -1000000, None, None, None, None, None]
    df = spark.createDataFrame([(2.5,), (-2.5,), (2.4,), (0.0,)], "x double")
    assert [r.y for r in df.select(U.fixed_point(F.col("x"), 1.0).alias("y")).collect()] == [3.0, -3.0, 2.0, 0.0]


def test_hash_and_identifiers(spark):
    def fnv(raw):
        h = 0xCBF29CE484222325
        for b in raw:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    frames = [b"", b"a", b"foobar", bytes(range(256))]
    df = spark.createDataFrame([(list(f),) for f in frames], "v array<int>")
    assert [r.h for r in df.select(U.fnv1a(F.col("v")).alias("h")).collect()] == [fnv(f) for f in frames]
    names = spark.createDataFrame([("a-b",), ("-a",), ("A",), ("",), (None,), ("x" * 64,), ("x" * 65,)], "x string")
    assert [r.ok for r in names.select(U.valid_identifier(F.col("x")).alias("ok")).collect()] == [True, False, False, False, False, True, False]


def test_metadata_and_flags(spark):
    df = spark.createDataFrame([({"n": "12", "t": "ok", "x": "1"},), ({"n": "1.5", "t": "a b"},), ({},), (None,)], "m map<string,string>")
    kept, dropped = U.sanitised(F.col("m"), {"n": "integer", "t": "token"})
    assert [(r.k, r.d) for r in df.select(kept.alias("k"), dropped.alias("d")).collect()][:3] == [({"n": "12", "t": "ok"}, 1), ({}, 2), ({}, 0)]
    d = spark.createDataFrame([(100.02, 1.0), (100.2, 1.0), (4.0, 1.0), (100.0, 9.0)], "f double, w double")
    line = U.reference_harmonic(F.col("f"), F.col("w"), F.lit(0.1), 10.0, 100.0, 0.05, 3.0, 1.0)
    assert [r.h for r in d.select(line.alias("h")).collect()] == [100.0, None, None, None]
    coarse = U.reference_harmonic(F.col("f"), F.col("w"), F.lit(2.0), 10.0, 100.0, 0.05, 3.0, 1.0)
    assert {r.h for r in d.select(coarse.alias("h")).collect()} == {None}
