"""Array operators on blocks of samples and spectra: built-in array expressions where they serve, numpy over Arrow batches else."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.operators.aggregates import exact_quantiles
from spectraloom.sources.shared import written


def taper(kind: str, n: int) -> np.ndarray:
    """Periodic window functions."""
    x = 2 * np.pi * np.arange(n) / n
    terms = {"rectangular": [1.0], "hann": [0.5, -0.5], "hamming": [0.54, -0.46], "blackman": [0.42, -0.5, 0.08]}[kind]
    return sum(a * np.cos(k * x) for k, a in enumerate(terms))


def taper_figures(w: np.ndarray) -> dict[str, float]:
    """Coherent gain and equivalent noise bandwidth in bins."""
    return {"gain": float(w.mean()), "enbw": float(len(w) * (w**2).sum() / w.sum() ** 2)}


def welch(n: int, overlap: float = 0.5, kind: str = "hann"):
    """A pandas UDF: array of real samples to the averaged two-sided power density, lowest frequency first."""
    w = taper(kind, n)
    step = max(1, round(n * (1 - overlap)))

    @F.pandas_udf("array<double>")
    def psd(blocks: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float)
            if len(x) < n:
                return None
            frames = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
            return (np.abs(np.fft.fftshift(np.fft.fft(frames * w), axes=1)) ** 2).mean(0) / (w**2).sum()

        return blocks.map(one, na_action="ignore")

    return psd


def best_lag(most: int):
    """A pandas UDF of two arrays: struct(lag, correlation) of the largest normalised correlation within ``most`` samples."""

    @F.pandas_udf("lag int, correlation double")
    def search(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x, y = np.asarray(x, float), np.asarray(y, float)
            best = (0, -2.0)
            for lag in range(-most, most + 1):
                p, q = (x[lag:], y[: len(y) - lag]) if lag >= 0 else (x[:lag], y[-lag:])
                p, q = p - p.mean(), q - q.mean()
                norm = np.sqrt((p * p).sum() * (q * q).sum())
                r = float((p * q).sum() / norm) if norm > 0 else 0.0
                if r > best[1] + 1e-12:
                    best = (lag, r)
            rows.append(best)
        return pd.DataFrame(rows, columns=["lag", "correlation"])

    return search


def kurtosis_of_power(p: Column) -> Column:
    """Spectral kurtosis of an array of M power estimates: 1 for noise, about 0 for a steady carrier."""
    m = F.size(p)
    s1 = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x)
    return (m + 1) / (m - 1) * (m * s2 / (s1 * s1) - 1)


def oscillator(n: Column, step: int) -> tuple[Column, Column]:
    """Cosine and sine of an oscillator at absolute sample n; the phase is exact in 2**-32 turns, so partitions may be cut anywhere."""
    phase = F.pmod(n * step, F.lit(1 << 32)) / float(1 << 32) * (2 * np.pi)
    return F.cos(phase), F.sin(phase)


def noise_floor_fcme(factor: float = 2.97, start: float = 0.1):
    """A pandas UDF: the mean of the bins that forward consecutive mean excision calls noise, from an array of powers."""

    @F.pandas_udf("double")
    def floor(blocks: pd.Series) -> pd.Series:
        def one(p):
            p = np.sort(np.asarray(p, float))
            if not len(p):
                return None
            n = max(1, int(start * len(p)))
            while n < len(p):
                grown = int(np.searchsorted(p, factor * p[:n].mean(), side="right"))
                if grown <= n:
                    break
                n = grown
            return float(p[:n].mean())

        return blocks.map(one, na_action="ignore")

    return floor


def ordered_cfar(df: DataFrame, keys: list[str], at: str, tie: str, value: str, reach: int, rank: int, factor: float) -> DataFrame:
    """Rows above ``factor`` times the ``rank``-th smallest of the neighbours within ``reach`` rows on both sides."""
    by = Window.partitionBy(*keys).orderBy(at, tie)
    near = F.array_sort(F.concat(F.collect_list(value).over(by.rowsBetween(-reach, -1)), F.collect_list(value).over(by.rowsBetween(1, reach))))
    marked = df.withColumn("__near", near)
    return marked.where(F.size("__near") >= rank).withColumn("level_k", F.element_at("__near", rank)).where(F.col(value) > factor * F.col("level_k")).drop("__near")


def robust_bursts(df: DataFrame, keys: list[str], at: str, value: str, factor: float) -> DataFrame:
    """Rows above median + factor * 1.4826 * MAD of their key; both medians are found by bins and joined back."""
    middle = exact_quantiles(df, keys, value, {"__m": 0.5})
    off = written(df.join(middle, keys).withColumn("__d", F.abs(F.col(value) - F.col("__m"))), "distances")
    spread = exact_quantiles(off, keys, "__d", {"__s": 0.5})
    return off.join(spread, keys).where(F.col(value) > F.col("__m") + factor * 1.4826 * F.col("__s")).drop("__m", "__d", "__s")


def raster_offset(centre: Column, step: float) -> tuple[Column, Column]:
    """Circular mean of centres modulo a raster step, and how well they agree (0 to 1), as aggregates."""
    turn = centre / step * (2 * np.pi)
    c, s = F.avg(F.cos(turn)), F.avg(F.sin(turn))
    return F.pmod(F.atan2(s, c) / (2 * np.pi) * step, F.lit(float(step))), F.sqrt(c * c + s * s)


def scintillation(x: Column) -> Column:
    """S4 of intensities, as an aggregate."""
    return F.sqrt((F.avg(x * x) - F.avg(x) * F.avg(x)) / (F.avg(x) * F.avg(x)))


def kaiser_lowpass(taps: int, cutoff: float, attenuation: float) -> np.ndarray:
    """A low-pass of unit gain at zero; ``cutoff`` in cycles a sample."""
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * (attenuation - 21) ** 0.4 + 0.07886 * (attenuation - 21) if attenuation >= 21 else 0.0
    n = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * n) * np.kaiser(taps, beta)
    return h / h.sum()


def down_convert(offset: float, decimate: int, taps: np.ndarray):
    """A pandas UDF: interleaved I/Q arrays mixed down by ``offset`` cycles a sample, filtered and decimated."""

    @F.pandas_udf("array<double>")
    def convert(blocks: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float)
            z = (x[0::2] + 1j * x[1::2]) * np.exp(-2j * np.pi * offset * np.arange(len(x) // 2))
            y = np.convolve(z, taps, mode="same")[::decimate]
            return np.stack([y.real, y.imag], 1).ravel()

        return blocks.map(one, na_action="ignore")

    return convert


def demodulate_fm():
    """A pandas UDF: interleaved I/Q arrays to the phase step between samples, in turns."""

    @F.pandas_udf("array<double>")
    def demodulate(blocks: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float)
            z = x[0::2] + 1j * x[1::2]
            return np.angle(z[1:] * np.conj(z[:-1])) / (2 * np.pi)

        return blocks.map(one, na_action="ignore")

    return demodulate


def decode_samples(kind: str):
    """A pandas UDF: raw bytes of ci8, cu8, ci16 or cf32 samples to interleaved values in [-1, 1)."""
    dtype, zero, scale = {"ci8": ("i1", 0, 128), "cu8": ("u1", 127.5, 128), "ci16": ("<i2", 0, 32768), "cf32": ("<f4", 0, 1)}[kind]

    @F.pandas_udf("array<double>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: (np.frombuffer(b, dtype).astype(float) - zero) / scale, na_action="ignore")

    return decode


def channelise(channels: int, taps_per_channel: int = 8):
    """A pandas UDF: interleaved I/Q arrays to the power in each of the channels of a polyphase filter bank, lowest first."""
    taps = kaiser_lowpass(channels * taps_per_channel, 0.5 / channels, 60.0) * channels
    branches = taps.reshape(taps_per_channel, channels)

    @F.pandas_udf("array<double>")
    def powers(blocks: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float)
            z = x[0::2] + 1j * x[1::2]
            frames = len(z) // channels - taps_per_channel + 1
            if frames < 1:
                return None
            rows = z[: (frames + taps_per_channel - 1) * channels].reshape(-1, channels)
            held = np.lib.stride_tricks.sliding_window_view(rows, taps_per_channel, axis=0)
            bank = np.fft.fftshift(np.fft.fft((held * branches[::-1].T).sum(2), axis=1), axes=1)
            return (np.abs(bank) ** 2).mean(0) / channels**2

        return blocks.map(one, na_action="ignore")

    return powers


def holds(df: DataFrame, keys: list[str], block: str) -> DataFrame:
    """keys, bin, max_hold, min_hold, mean: holds of blocks of equal length, by bin."""
    return df.select(*keys, F.posexplode(block).alias("bin", "x")).groupBy(*keys, "bin").agg(F.max("x").alias("max_hold"), F.min("x").alias("min_hold"), F.avg(F.col("x").cast("double")).alias("mean"))


def clipped(x: Column, rail: float) -> Column:
    """How many samples of an array are at or beyond the rails."""
    return F.size(F.filter(x, lambda v: F.abs(v) >= rail))


def overloaded(df: DataFrame, keys: list[str], at: str, count: str, least: int, of: int, need: int) -> DataFrame:
    """Frames with ``least`` clipped samples that ``need`` of the last ``of`` frames have too."""
    high = (F.col(count) >= least).cast("int")
    by = Window.partitionBy(*keys).orderBy(at).rowsBetween(1 - of, 0)
    return df.withColumn("overload", (high == 1) & (F.sum(high).over(by) >= need))


def chirp_rate(df: DataFrame, keys: list[str], t: str, f: str) -> DataFrame:
    """Slope of the peak frequency over time, its fit and the number of points."""
    return df.groupBy(*keys).agg(F.regr_slope(f, t).alias("rate"), F.regr_r2(f, t).alias("r2"), F.count("*").alias("n"))
