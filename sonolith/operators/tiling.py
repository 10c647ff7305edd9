"""Windows over long recordings, as integer or second offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even_starts(total: Column, size: Column) -> Column:
    """Starts of ceil(total / size) windows spread evenly from 0 to total - size, rounded half to even; [0] if short."""
    n = F.ceil(total / size).cast("int")
    step = (total - size) / (n - 1)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.rint(i * step).cast("int"))
    return F.when(total <= size, F.array(F.lit(0))).otherwise(many)


def sliding_starts(total: Column, size: Column, step: Column) -> Column:
    """Starts of ceil((total - size) / step) + 1 windows, spread evenly."""
    n = F.ceil((total - size) / step).cast("int") + 1
    even = (total - size) / (n - 1)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.rint(i * even).cast("int"))
    return F.when(total <= size, F.array(F.lit(0))).otherwise(many)


def segment_starts(duration: Column, context: Column, least_overlap: Column, most: int = 101) -> Column:
    """Starts in seconds of segments that overlap by least_overlap or, if that reaches the end, evenly by more."""
    n = F.ceil(duration / context)
    overlap = F.when(n > 1, F.greatest((n * context - duration) / (n - 1), least_overlap)).otherwise(least_overlap)
    step = context - overlap
    last = F.least(F.floor((duration + 0.001 - context) / step).cast("int"), F.lit(most - 1))
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: i * step)
    return F.when(duration <= context, F.array(F.lit(0.0))).otherwise(many)


def window_timing(clip_start: Column, t: Column, bins: Column, window_s: float, hop_s: float) -> tuple[Column, Column, Column]:
    """(start, end, absolute centre of the first frame) of a window whose first frame is centred at t seconds."""
    start = F.greatest(F.lit(0.0), t - window_s / 2)
    end = start + F.greatest(F.lit(0), bins - 1) * F.lit(hop_s) + F.lit(window_s)
    return start, end, F.timestamp_add("MICROSECOND", F.rint(t * 1e6).cast("long"), clip_start)


def covered(starts: Column, size: int, total: Column) -> Column:
    """How many of the bins 0 to total - 1 lie in at least one window of size bins; no bin is listed, whatever the total."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), F.least(total, s + size) - F.greatest(s, a["reach"], F.lit(0)))).alias("n"), F.greatest(a["reach"], F.least(total, s + size)).alias("reach")
    )
    zero = F.lit(0).cast("long")
    ordered = F.transform(F.array_sort(starts), lambda s: s.cast("long"))
    return F.when(total.isNotNull(), F.aggregate(ordered, F.struct(zero.alias("n"), zero.alias("reach")), step, lambda a: a["n"]))
