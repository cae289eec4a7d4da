"""Check polynomials, layouts, length fields and cyclic rates that were planted, and what noise gives instead."""

import random

import numpy as np
import pytest

from spectraloom.operators import inference as I


def check(data, width, poly, start, final, reflected):
    """A cyclic check bit by bit."""
    r = start
    for byte in data:
        for b in range(8):
            bit = byte >> (b if reflected else 7 - b) & 1
            top = r >> (width - 1) & 1
            r = (r << 1 & (1 << width) - 1) ^ (poly if top ^ bit else 0)
    return r ^ final


def framed(data, width, poly, start, final, reflected):
    value = check(data, width, poly, start, final, reflected)
    if reflected:
        value = int(f"{value:0{width}b}"[::-1], 2)
    return data + value.to_bytes(width // 8, "little" if reflected else "big")


def test_checks_as_zlib_makes_them():
    import zlib

    assert framed(b"123456789", 32, 0x04C11DB7, 0xFFFFFFFF, 0xFFFFFFFF, True) == b"123456789" + zlib.crc32(b"123456789").to_bytes(4, "little")


def test_random_models_come_back(spark):
    """Models of 8 to 32 bits from 20 frames each of two lengths; a key of random bytes has none."""
    rng, rows, want = random.Random(12), [], []
    for k in range(12):
        width = rng.choice([8, 16, 24, 32])
        model = (width, rng.getrandbits(width) | 1, rng.getrandbits(width), rng.getrandbits(width), k % 2 == 1)
        frames = [framed(rng.randbytes(20 if i < 10 else 27), *model) for i in range(20)]
        rows += [(f"k{k}", f) for f in frames]
        want.append((f"k{k}", model[4], width, model[1]))
        start, final = I.check_values(frames, width, model[1], model[4])
        assert all(framed(f[: -width // 8], width, model[1], start, final, model[4]) == f for f in frames)
    rows += [("noise", rng.randbytes(24)) for _ in range(20)] + [("one", b"abc"), ("null", None)]
    got = I.check_polynomials(spark.createDataFrame(rows, "k string, f binary").repartition(7), ["k"], "f").collect()
    assert sorted((r["k"], r["reflected"], r["width"], r["poly"]) for r in got) == sorted(want)


def test_start_and_final_values():
    rng = random.Random(5)
    model = (16, 0x1021, 0x1D0F, 0x00FF, False)
    frames = [framed(rng.randbytes(n), *model) for n in (5, 5, 8, 13, 14)]
    start, final = I.check_values(frames, 16, 0x1021, False)
    more = [framed(rng.randbytes(n), *model) for n in (1, 2, 3, 77)]
    assert all(framed(f[:-2], 16, 0x1021, start, final, False) == f for f in frames + more)
    odd = (32, 0x04C11DB7, 0xFFFFFFFF, 0xFFFFFFFF, True)  # without the factor x + 1 the values are the only ones
    assert I.check_values([framed(rng.randbytes(n), *odd) for n in (9, 10, 12, 30)], 32, 0x04C11DB7, True) == odd[2:4]
    assert I.check_values(frames[:2], 16, 0x1021, False) is None
    assert I.check_values([*frames, b"anything else"], 16, 0x1021, False) is None


def bursts(rng, n, sync, scale, add):
    out = []
    for _ in range(n):
        v = rng.randrange(4, 60)
        body = "".join(rng.choice("01") for _ in range(v * scale + add - len(sync) - 6))
        out.append(sync + f"{v:06b}" + body)
    return out


def test_layouts_of_families(spark):
    rng = random.Random(8)
    families = {"a": ("1010101011110000", 8, 30), "b": ("110011010111", 4, 40), None: ("0111111000010100", 2, 48)}
    rows = [(k, i, b) for k, (sync, scale, add) in families.items() for i, b in enumerate(bursts(rng, 300, sync, scale, add))]
    rows += [("a", 999, None), ("a", 998, "")]
    df = spark.createDataFrame(rows, "family string, burst long, bits string").repartition(6)
    counts = I.column_counts(df, ["family"], "bits", 64)
    assert counts.where("family = 'a' and column = 0").first().n == 300
    runs = [r for r in I.layout(counts, ["family"]).collect() if r["first"] == 0]
    assert {r["family"]: (r["kind"], r["value"]) for r in runs} == {k: ("fixed", s) for k, (s, *_) in families.items()}
    found = {r["family"]: (r["first"], r["width"], r["scale"], r["add"]) for r in I.length_fields(df, ["family"], "bits", range(24), (4, 5, 6)).collect()}
    assert found == {k: (len(s), 6, float(scale), float(add)) for k, (s, scale, add) in families.items()}
    noise = spark.createDataFrame([("x", "".join(rng.choice("01") for _ in range(rng.randrange(50, 300)))) for _ in range(200)], "family string, bits string")
    assert I.length_fields(noise, ["family"], "bits", range(24)).collect() == []


def burst(rng, rate, baud, n, noise):
    """A shaped two-level signal on a carrier: its power dips where the level changes."""
    at = np.arange(n) * baud / rate + rng.random()
    bits = 2 * rng.integers(0, 2, int(at[-1]) + 3) - 1
    part = at % 1
    k = at.astype(int)
    level = np.where(part < 0.25, bits[k] + (bits[k + 1] - bits[k]) * 0, bits[k]) * np.minimum(1, 4 * np.minimum(part, 1 - part) + (bits[k] == bits[np.maximum(k - 1, 0)]) * (part < 0.5) + (bits[k] == bits[k + 1]) * (part >= 0.5))
    return level * np.cos(2 * np.pi * 0.31 * np.arange(n)) + noise * rng.standard_normal(n)


def test_cyclic_rates(spark):
    rng = np.random.default_rng(3)
    rows = [("s", i, burst(rng, 48_000.0, 2_400.0, 6000, 0.3).tolist()) for i in range(8)] + [("n", i, rng.standard_normal(6000).tolist()) for i in range(40)]
    rows += [("n", 99, None), ("n", 98, [1.0] * 400), ("n", 97, [])]
    df = spark.createDataFrame(rows, "k string, burst long, x array<double>").repartition(4)
    lines = df.select("k", "burst", I.cyclic_lines(48_000.0, 300.0)("x").alias("lines")).cache()
    false = sum(len(r.lines) for r in lines.where("k = 'n'").collect())
    assert false <= 4  # 0.4 are expected
    agreed = I.rate_consensus(lines, ["k"], "burst", "lines").collect()
    assert {r["k"] for r in agreed} == {"s"}
    assert any(r["hz"] == pytest.approx(2_400, rel=0.005) and r["n_agree"] >= 6 for r in agreed)
    lines.unpersist()


def test_consensus_of_rates(spark):
    rows = [("a", i, [(1000.0 + d, 20.0), (3000.0 * (1 + i), 9.0)]) for i, d in enumerate((-1, 0, 2, 1))] + [("b", 1, []), ("b", 2, None)]
    df = spark.createDataFrame(rows, "k string, i long, l array<struct<hz:double,excess:double>>")
    got = I.rate_consensus(df, ["k"], "i", "l").collect()
    assert [(r.k, round(r.hz, 1), r.n_agree, r.n_bursts) for r in got] == [("a", 1000.5, 4, 4)]


def test_signatures_meet_only_where_all_three_fields_are_near(spark, tmp_path):
    import duckdb

    from spectraloom.plans import ORACLE_SQL, QUERIES

    name = str(tmp_path)
    spark.range(700).selectExpr("id as s_suppkey", "cast(id % 2 as int) as s_nationkey", "if(id % 90 = 0, null, (id * 37 % 4000) / 4.0) as s_acctbal").coalesce(1).write.parquet(f"{name}/supplier.parquet")
    spark.range(2100).selectExpr("id as c_custkey", "cast(id % 2 as int) as c_nationkey", "(id * 53 % 4000) / 4.0 - 100 as c_acctbal").coalesce(1).write.parquet(f"{name}/customer.parquet")
    duck = duckdb.connect()
    for t in ("supplier", "customer"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{name}/{t}.parquet/*.parquet')")
    got = QUERIES["signature_match"](spark, name)
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(ORACLE_SQL["signature_match"]).fetchall())
    keys = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() > 5000 and "p#" in keys.split("Join Inner")[1].split("\n")[0]  # the remainders are keys of the join
