"""Readers and writers of signal files: recordings with metadata, sweeps, observation logs, orbit and position lines, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDING_SCHEMA = """
global struct<`core:datatype`: string, `core:version`: string, `core:sample_rate`: double, `core:description`: string, `core:hw`: string>,
captures array<struct<`core:sample_start`: bigint, `core:frequency`: double, `core:datetime`: string>>,
annotations array<struct<`core:sample_start`: bigint, `core:sample_count`: bigint, `core:freq_lower_edge`: double, `core:freq_upper_edge`: double, `core:label`: string>>
"""


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """file, datatype, sample_rate, captures, annotations of recording metadata files (JSON)."""
    raw = spark.read.schema(RECORDING_SCHEMA).json(path, multiLine=True)
    return raw.select(
        F.input_file_name().alias("file"),
        F.col("global.`core:datatype`").alias("datatype"),
        F.col("global.`core:sample_rate`").alias("sample_rate"),
        "captures",
        "annotations",
    )


def recording_annotations(recordings: DataFrame) -> DataFrame:
    """One row an annotation, with its times in seconds."""
    a = recordings.select("file", "sample_rate", F.posexplode("annotations").alias("index", "a"))
    start, count = F.col("a.`core:sample_start`"), F.col("a.`core:sample_count`")
    return a.select(
        "file",
        "index",
        F.col("a.`core:label`").alias("label"),
        (start / F.col("sample_rate")).alias("t_start_s"),
        ((start + count) / F.col("sample_rate")).alias("t_end_s"),
        F.col("a.`core:freq_lower_edge`").alias("f_lo_hz"),
        F.col("a.`core:freq_upper_edge`").alias("f_hi_hz"),
    )


def read_samples(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, samples: raw sample files as interleaved values in [-1, 1); a file is one row."""
    from spectraloom.operators.spectral import decode_samples

    return spark.read.format("binaryFile").load(path).select("path", decode_samples(kind)("content").alias("samples"))


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """t, f_hz, db from sweep lines ``date, time, hz_low, hz_high, bin_width, num_samples, dB...``.

    Lines with another shape are left out; a cell that isn't a number was not observed and has a null.
    """
    part = F.transform(F.split("value", ","), lambda x: F.trim(x))
    lines = spark.read.text(path).select(part.alias("p")).where((F.size("p") > 6) & F.col("p")[2].rlike(r"^[0-9.eE+]+$") & F.col("p")[4].rlike(r"^[0-9.eE+]+$"))
    cells = lines.select(
        F.try_to_timestamp(F.concat_ws(" ", F.col("p")[0], F.col("p")[1])).alias("t"),
        F.col("p")[2].cast("double").alias("lo"),
        F.col("p")[4].cast("double").alias("width"),
        F.posexplode(F.slice("p", 7, 1 << 20)).alias("i", "x"),
    )
    value = F.expr("try_cast(x as double)")
    return cells.where("t is not null").select("t", (F.col("lo") + (F.col("i") + 0.5) * F.col("width")).alias("f_hz"), F.when(~F.isnan(value), value).alias("db"))


def sweep_lines(cells: DataFrame, width_hz: float, per_line: int) -> DataFrame:
    """One text column of sweep lines from (t, bin, db), ``per_line`` neighbouring bins each."""
    line = cells.groupBy("t", F.floor(F.col("bin") / per_line).alias("block")).agg(F.array_sort(F.collect_list(F.struct("bin", "db"))).alias("c"))
    lo = F.col("c")[0]["bin"] * width_hz
    values = F.transform("c", lambda s: F.coalesce(F.format_number(s["db"], 2), F.lit("nan")))
    n = F.size("c")
    return line.select(F.concat_ws(", ", F.date_format("t", "yyyy-MM-dd"), F.date_format("t", "HH:mm:ss"), lo.cast("long").cast("string"), (lo + n * width_hz).cast("long").cast("string"), F.lit(f"{width_hz:.2f}"), n.cast("string"), F.array_join(values, ", ")).alias("value"))


def read_observation_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of log lines ``crc32-hex json``; a line whose check fails, or that isn't JSON of the schema, is skipped."""
    lines = spark.read.text(path).select(F.substring_index("value", " ", 1).alias("crc"), F.expr("substring(value, instr(value, ' ') + 1)").alias("json"))
    good = lines.where(F.lpad(F.lower(F.hex(F.crc32(F.col("json").cast("binary")))), 8, "0") == F.lower("crc"))
    return good.select(F.from_json("json", schema).alias("r")).where("r is not null").select("r.*")


def observation_log_lines(rows: DataFrame) -> DataFrame:
    json = F.to_json(F.struct(*rows.columns))
    return rows.select(F.concat_ws(" ", F.lpad(F.lower(F.hex(F.crc32(json.cast("binary")))), 8, "0"), json).alias("value"))


DAY_US = 86_400_000_000


def append_by_day(rows: DataFrame, path: str, micros: str, end: str) -> None:
    """Append rows to a store that is cut by the day of their start and by how many days on they end."""
    day = F.floor(F.col(micros) / DAY_US)
    lasts = F.greatest(F.floor(F.col(end) / DAY_US) - day, F.lit(0))
    rows.withColumns({"day": day, "lasts": F.coalesce(lasts, F.lit(0))}).write.mode("append").partitionBy("day", "lasts").parquet(path)


def scan_days(spark: SparkSession, path: str, micros: str, end: str, lo: int, hi: int, most: int) -> tuple[DataFrame, Column]:
    """Rows of a store by day that meet the half-open span, ``most`` + 1 at most, and a flag column that tells a cut.

    Only folders whose rows can reach the span are opened, however long rows are.
    """
    may = (F.col("day") + F.col("lasts") >= lo // DAY_US) & (F.col("day") <= hi // DAY_US)
    found = spark.read.parquet(path).where(may).where((F.col(micros) < hi) & (F.col(end) > lo)).drop("lasts")
    return found.orderBy(micros).limit(most + 1), F.count("*") > most


def days_to_drop(files: DataFrame, budget: int, oldest: int | None = None) -> DataFrame:
    """Days (day, bytes) beyond the newest that fit the byte budget, and those before the day ``oldest``."""
    from pyspark.sql.window import Window

    kept = F.sum("bytes").over(Window.orderBy(F.desc("day")))  # a row a day
    too_old = F.lit(False) if oldest is None else F.col("day") < oldest
    return files.groupBy("day").agg(F.sum("bytes").alias("bytes")).withColumn("kept", kept).where((F.col("kept") > budget) | too_old).select("day")


def orbit_elements(lines: DataFrame) -> DataFrame:
    """catalog, inclination, eccentricity, mean_motion from the second lines of two-line elements (column ``value``) with a right check digit."""
    from spectraloom.operators.frames import line_checksum

    v = F.col("value")
    second = lines.where(v.startswith("2 ") & (F.length(v) >= 69)).where(line_checksum(v) == F.substring(v, 69, 1).cast("int"))
    cut = lambda a, n: F.trim(F.substring(v, a, n))
    return second.select(cut(3, 5).cast("int").alias("catalog"), cut(9, 8).cast("double").alias("inclination"), (cut(27, 7).cast("double") / 1e7).alias("eccentricity"), cut(53, 11).cast("double").alias("mean_motion"))


def positions(lines: DataFrame) -> DataFrame:
    """time_s, lat, lon, quality from position sentences (GGA) with a right checksum."""
    from spectraloom.operators.frames import byte_values, xor_checksum

    v = F.trim("value")
    body, check = F.regexp_extract(v, r"^\$([^*]*)\*", 1), F.regexp_extract(v, r"\*([0-9A-Fa-f]{2})$", 1)
    good = lines.where(v.rlike(r"^\$..GGA,.*\*[0-9A-Fa-f]{2}$")).where(xor_checksum(byte_values(body)) == F.conv(check, 16, 10).cast("int"))
    p = F.split(body, ",")
    degrees = lambda x, n, sign, neg: (F.substring(x, 1, n).cast("double") + F.expr("0") + F.substring(x, n + 1, 12).cast("double") / 60) * F.when(sign == neg, -1).otherwise(1)
    t = p[1]
    seconds = F.substring(t, 1, 2).cast("int") * 3600 + F.substring(t, 3, 2).cast("int") * 60 + F.substring(t, 5, 9).cast("double")
    return good.select(seconds.alias("time_s"), degrees(p[2], 2, p[3], "S").alias("lat"), degrees(p[4], 3, p[5], "W").alias("lon"), p[6].cast("int").alias("quality"))


def device_specs(lines: DataFrame) -> DataFrame:
    """The settings of ``key=value,key=value`` lines as a map column ``spec``; empty and comment lines are left out."""
    v = F.trim("value")
    return lines.where((F.length(v) > 0) & ~v.startswith("#")).select(F.str_to_map(v, F.lit(","), F.lit("=")).alias("spec"))


def messages(lines: DataFrame, schema: str, allowed: list[str], kind: str = "type") -> DataFrame:
    """Rows of JSON messages of the allowed kinds; what doesn't parse is left out."""
    return lines.select(F.from_json("value", schema).alias("m")).where(F.col(f"m.{kind}").isin(*allowed)).select("m.*")


def latest_snapshot(snapshots: DataFrame, keys: list[str], fetched: str, now: int, stale_after: int) -> DataFrame:
    """A feed's newest row for each natural key, and whether it is stale."""
    from spectraloom.operators.sequences import latest

    return latest(snapshots, keys, [fetched]).withColumn("stale", F.lit(now) - F.col(fetched) > stale_after)
