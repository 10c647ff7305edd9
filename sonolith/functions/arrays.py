"""Matrix and spectrum expressions; a matrix is an array of frequency rows, each an array over time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import hash_key, unit


def oriented(p: Column, f: Column, t: Column) -> Column:
    """p with one row per frequency: transposed if it has one per time instead."""
    turned = F.transform(F.sequence(F.lit(1), F.size(f)), lambda i: F.transform(p, lambda r: F.element_at(r, i)))
    flipped = (F.size(p) == F.size(t)) & (F.size(F.element_at(p, 1)) == F.size(f)) & (F.size(p) != F.size(f))
    return F.when(flipped, turned).otherwise(p)


def power_to_db(p: Column, top: Column) -> Column:
    """10 log10 of abs power over the matrix maximum, from -100; all -100 where the maximum is 0."""
    return F.when(top > 0, 10 * F.log10(F.greatest(F.abs(p) / top, F.lit(1e-10)))).otherwise(F.lit(-100.0))


def matrix_db(p: Column) -> Column:
    top = F.array_max(F.transform(p, lambda r: F.array_max(F.transform(r, F.abs))))
    return F.transform(p, lambda r: F.transform(r, lambda x: power_to_db(x, top)))


def db_to_unit(x: Column, low: float = -80.0, high: float = 0.0) -> Column:
    return (F.greatest(F.lit(low), F.least(F.lit(high), x)) - low) / (high - low)


def fit_rows(p: Column, rows: int) -> Column:
    """Centre-cropped to so many rows, or padded with the last one."""
    n = F.size(p)
    crop = F.slice(p, F.floor((n - rows) / 2).cast("int") + 1, F.lit(rows))
    return F.when(n >= rows, crop).otherwise(F.concat(p, F.array_repeat(F.element_at(p, -1), rows - n)))


def crop_start(length: Column, crop: int, positive: Column) -> Column:
    """First frame of a crop: the middle frame at half the crop, rounded half to even, for positives; the same with
    crop // 2 for negatives; within the matrix."""
    middle = F.floor(length / 2)
    start = F.when(positive, middle - F.rint(F.lit(0.5 * crop))).otherwise(middle - crop // 2)
    return F.greatest(F.lit(0), F.least(start, length - crop)).cast("int")


def jittered_start(length: Column, crop: int, key: Column, positive: Column, bias: float = 0.25, tries: int = 10) -> Column:
    """First frame of a crop that varies with ``key``: 0 where the matrix is no longer than the crop.

    For positives the middle frame lies at a fraction of the crop that is normal around 0.5 with deviation bias / 2,
    truncated to [0, 1]: the first of so many draws inside it, else 0.5. Negatives start anywhere, all starts alike.
    Draws are made from md5 of the key and their number.
    """
    draw = lambda *name: unit(hash_key("jitter", key, *name))
    sigma = max(1e-3, bias) * 0.5

    def fraction(i: Column) -> Column:
        gauss = F.sqrt(-2 * F.log(1 - draw(i, F.lit("r")))) * F.cos(2 * math.pi * draw(i, F.lit("a")))
        return 0.5 + sigma * gauss

    inside = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), fraction), lambda f: f.between(0.0, 1.0))
    at = F.coalesce(F.get(inside, F.lit(0)), F.lit(0.5))
    start = F.when(positive, F.rint(F.floor(length / 2) - at * max(1, crop - 1))).otherwise(F.floor(draw(F.lit("n")) * (length - crop + 1)))
    return F.when(length <= crop, 0).otherwise(F.greatest(F.lit(0), F.least(start, length - crop))).cast("int")


def fit_row(r: Column, start: Column, crop: int) -> Column:
    """Frames from start, padded with the last one to crop."""
    cut = F.slice(r, start + 1, F.lit(crop))
    return F.concat(cut, F.array_repeat(F.element_at(cut, -1), F.greatest(F.lit(0), crop - F.size(cut))))


def centre_crop(p: Column, t: Column, frames: Column, size: int) -> Column:
    """The middle ``size`` rows and frames of a matrix, none padded, each row an array of (t_idx, value), t_idx from 0.

    The spectrogram has so many ``frames``; t tells, in order, which of them the matrix holds.
    """
    start = crop_start(frames, size, F.lit(False))
    rows = F.slice(p, F.greatest(F.lit(0), F.floor((F.size(p) - size) / 2).cast("int")) + 1, F.lit(size))
    placed = lambda r: F.transform(r, lambda x, j: F.struct((F.get(t, j) - start).cast("int").alias("t_idx"), x.alias("value")))
    return F.transform(rows, lambda r: F.filter(placed(r), lambda c: c["t_idx"].between(0, size - 1)))


def chunk(p: Column, start: Column, size: int, zero: bool) -> Column:
    """Square of size rows and frames from start; short edges padded with the last value, or with zeros."""
    n = F.size(p)
    rows = F.slice(p, F.greatest(F.lit(0), F.floor((n - size) / 2).cast("int")) + 1, F.lit(size))

    def row(r: Column) -> Column:
        cut = F.slice(r, start + 1, F.lit(size))
        pad = F.lit(0.0) if zero else F.element_at(cut, -1)
        return F.concat(cut, F.array_repeat(pad, F.greatest(F.lit(0), size - F.size(cut))))

    rows = F.transform(rows, row)
    last = F.array_repeat(F.lit(0.0), F.lit(size)) if zero else F.element_at(rows, -1)
    return F.concat(rows, F.array_repeat(last, F.greatest(F.lit(0), size - F.size(rows))))


def offset_from_centre(start: Column, crop: int, length: Column) -> tuple[Column, Column]:
    """Frames from the matrix centre to the crop centre, and that over max(1, length // 2), absolute."""
    off = start + crop // 2 - F.floor(length / 2)
    return off.cast("int"), F.abs(off) / F.greatest(F.lit(1), F.floor(length / 2))


def stretch(x: Column, low: Column, high: Column) -> Column:
    """Contrast stretch of [low, high] to [0, 1], clipped; unchanged where high is not above low."""
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))).otherwise(x)


def frame_spectrum(frame: Column, n: int) -> Column:
    """One-sided power of a Hann-windowed frame of n samples, by the DFT sum.

    n / 2 passes over n samples: an exact check of short frames; ``spectra.band_spectrum`` is for real ones.
    """
    wave = F.transform(frame, lambda x, i: x * (0.5 - 0.5 * F.cos(i * (2 * math.pi / n))))

    def bin_power(k: Column) -> Column:
        turn = lambda g: F.aggregate(F.transform(wave, lambda x, i: x * g(i * k * (2 * math.pi / n))), F.lit(0.0), lambda a, b: a + b)
        return F.pow(turn(F.cos), F.lit(2)) + F.pow(turn(F.sin), F.lit(2))

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), bin_power)


def frames(samples: Column, size: int, hop: int) -> Column:
    """Overlapping frames, as many as fit."""
    last = F.floor((F.size(samples) - size) / hop).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(samples, i * hop + 1, F.lit(size)))
