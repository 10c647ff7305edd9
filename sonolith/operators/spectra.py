"""Spectrum operators over rows: long-form cells, frames and whole signals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from ..session import materialize
from .failures import safe_map


def db_cells(cells: DataFrame) -> DataFrame:
    """cells with db relative to the maximum of their spectrogram; the maxima are pre-aggregated."""
    top = cells.groupBy("spec_id").agg(F.max(F.abs("power")).alias("_top"))
    return cells.join(top, "spec_id").withColumn("db", A.power_to_db(F.col("power"), F.col("_top"))).drop("_top")


def contrast(cells: DataFrame, low: float = 0.02, high: float = 0.98, value: str = "power") -> DataFrame:
    """cells with ``stretched``: values between two percentiles of their spectrogram (linear interpolation) on [0, 1]."""
    q = cells.groupBy("spec_id").agg(F.percentile(value, [low, high]).alias("_q"))
    return cells.join(q, "spec_id").withColumn("stretched", A.stretch(F.col(value), F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))).drop("_q")


def element_statistics(df: DataFrame, values: str) -> DataFrame:
    """Minimum, maximum, mean, population deviation and count over all elements of an array column.

    Each row is reduced to five numbers first, so one small row per partition is shuffled.
    """
    x = F.transform(values, lambda v: v.cast("double"))
    total = lambda g: F.aggregate(x, F.lit(0.0), lambda a, v: a + g(v))
    parts = df.select(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), total(lambda v: v).alias("s"), total(lambda v: v * v).alias("q"), F.size(x).alias("n"))
    a = parts.agg(F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    return a.select("min", "max", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"), "n")


def signal_blocks(signals: DataFrame, size: int, hop: int, samples: str = "samples", frames: int = 256) -> DataFrame:
    """Signals of one row each cut into blocks of so many frames, with ``start`` (first sample) and the halo that the last
    frame needs. A signal shorter than a frame has no block."""
    x = F.col(samples)
    last = F.floor((F.size(x) - size) / hop)
    starts = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.floor(last / frames)), lambda i: i * (frames * hop)))
    out = signals.withColumn("start", F.explode(starts))
    return out.withColumn(samples, F.slice(x, (F.col("start") + 1).cast("int"), F.lit((frames - 1) * hop + size)))


def frame_power(x: np.ndarray, size: int, hop: int, low: int, high: int) -> tuple[np.ndarray, float]:
    """(one-sided power of bins low to high - 1 per Hann-windowed frame, largest power of any bin), few frames at a time."""
    n = max(0, 1 + (len(x) - size) // hop)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    out, top = np.empty((n, high - low)), 0.0
    at_once = max(1, (8 << 20) // (16 * size))
    cut = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if n else None
    for a in range(0, n, at_once):
        z = np.fft.rfft(cut[a : min(n, a + at_once)] * window, axis=1)
        power = z.real**2 + z.imag**2
        top = max(top, float(power.max()))
        out[a : a + len(power)] = power[:, low:high]
    return out, top


def band_bins(size: int, fs: float, low_hz: float, high_hz: float) -> tuple[int, int]:
    """Bins of low_hz to high_hz, both included; all bins where none lies there."""
    bins = size // 2 + 1
    low, high = max(0, math.ceil(low_hz * size / fs - 1e-9)), min(bins, math.floor(high_hz * size / fs + 1e-9) + 1)
    return (low, high) if low < high else (0, bins)


def band_power(blocks: DataFrame, size: int, hop: int, block: int, key: str = "clip_id", rate: str = "fs", band_hz: tuple[float, float] | None = None, samples: str = "samples", start: str = "start", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, first_frame, first_bin, power, top, error) of blocks of recordings that begin every ``block`` samples with a halo of
    a frame: power[i][j] is that of bin first_bin + j in frame first_frame + i, top the largest of any bin.

    Only the band leaves the task. Each frame belongs to the block in which it begins. A block that can't be transformed
    (recordings shorter than a frame too) has the reason as error and nulls.
    """

    def one(row: dict) -> dict:
        x, at, fs = np.asarray(row[samples], np.float64), row[start], row[rate]
        if len(x) and not np.isfinite(x).all():
            raise ValueError("samples that aren't finite")
        if at == 0 and len(x) < size:
            raise ValueError("fewer samples than a frame")
        low, high = (0, size // 2 + 1) if band_hz is None else band_bins(size, fs, *band_hz)
        first = -(-at // hop)
        skip = first * hop - at
        frames = max(0, min(-(-(at + block) // hop) - first, 1 + (len(x) - skip - size) // hop))
        power, top = frame_power(x[skip : skip + (frames - 1) * hop + size] if frames else x[:0], size, hop, low, high)
        return {"first_frame": first, "first_bin": low, "power": list(power), "top": top}

    given = [key, *keep, rate, start, samples] + (["error"] if "error" in blocks.columns else [])
    out = safe_map(blocks.select(*given), one, "first_frame long, first_bin int, power array<array<double>>, top double", keep=[key, *keep])
    return out.filter("error IS NOT NULL OR size(power) > 0")


def band_spectrum(blocks: DataFrame, size: int, hop: int, block: int, key: str = "clip_id", rate: str = "fs", band_hz: tuple[float, float] | None = None, samples: str = "samples", start: str = "start") -> DataFrame:
    """band_power() with ``db``, relative to the largest power of the whole recording, all bins counted.

    The blocks' powers are written once; their maxima are pre-aggregated and joined back.
    """
    p = materialize(band_power(blocks, size, hop, block, key, rate, band_hz, samples, start), "band-power")
    top = p.groupBy(key).agg(F.max("top").alias("_top"))
    j = p.join(top, key)
    return j.withColumn("db", F.transform("power", lambda f: F.transform(f, lambda x: A.power_to_db(x, F.col("_top"))))).drop("top", "_top")


def spectrum_matrix(spectrum: DataFrame, key: str = "clip_id", value: str = "db") -> DataFrame:
    """(key, first_bin, matrix): one matrix per recording, a row per bin and a column per frame. For bands, which are narrow."""
    parts = spectrum.filter("error IS NULL").groupBy(key, "first_bin").agg(F.array_sort(F.collect_list(F.struct("first_frame", value))).alias("_p"))
    parts = parts.withColumn("_frames", F.flatten(F.transform("_p", lambda p: p[value])))  # a column, else flattened for every bin
    frames = F.col("_frames")
    bins = F.sequence(F.lit(1), F.size(F.element_at(frames, 1)))
    return parts.select(key, "first_bin", F.transform(bins, lambda i: F.transform(frames, lambda f: F.element_at(f, i))).alias("matrix"))


def spectrograms(signals: DataFrame, size: int, hop: int, key: str, samples: str = "samples") -> DataFrame:
    """(key, frame, bin, db) of signals of one row each, by FFT of blocks: Hann window, power relative to the signal's
    maximum. Cells are unfolded from matrices by expressions."""
    one = signals.select(key, F.col(samples).cast("array<double>").alias("samples"), F.lit(1).alias("fs"))
    blocks = signal_blocks(one, size, hop)
    s = band_spectrum(blocks, size, hop, 256 * hop, key, "fs")
    s = s.select(key, "first_frame", F.posexplode("db").alias("_i", "_row")).select(key, (F.col("first_frame") + F.col("_i")).cast("int").alias("frame"), F.posexplode("_row").alias("bin", "db"))
    return s.select(key, "frame", "bin", "db")


def table_fingerprints(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group a fingerprint of its rows whatever their order: hash of their number and of sums of their hashes.

    The sums are pre-aggregated, so a group of any size is a few numbers.
    """
    row = F.sha2(S.framed(*[F.col(c).cast("string") for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    g = df.groupBy(by).agg(F.concat_ws(",", F.count("*").cast("string"), *[part(i) for i in range(4)]).alias("_sums"))
    return g.select(by, F.concat(F.lit("sha256-"), F.substring(F.sha2("_sums", 256), 1, 12)).alias("fingerprint"))
