"""Slicing and stitching as stages that carry errors: the functions of ``intervals`` on rows, each fault with its reason."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .failures import safe_map


def _signal(row: dict, column: str) -> np.ndarray:
    if row[column] is None:
        raise ValueError(f"no {column}")
    x = np.array([np.nan if v is None else v for v in row[column]], np.float64)
    if not np.isfinite(x).all():
        raise ValueError(f"{column} with entries that aren't finite")
    return x


def _span(row: dict, start: str, end: str, fs: str) -> tuple[float, float, float]:
    if row[start] is None or row[end] is None or not row[fs] or row[fs] < 0:
        raise ValueError("a window without start, end or rate")
    if row[end] <= row[start]:
        raise ValueError("an empty window")
    return row[start], row[end], row[fs]


def sliced(df: DataFrame, samples: str = "samples", start: str = "start_s", end: str = "end_s", fs: str = "fs") -> DataFrame:
    """df with ``samples`` cut from int(start * fs) to int(end * fs) and ``error``; a window beyond the recording's end is one."""

    def one(row: dict) -> dict:
        x = _signal(row, samples)
        a, b, rate = _span(row, start, end, fs)
        if a < 0 or int(b * rate) > len(x):
            raise ValueError("a window outside its recording")
        return {samples: x[int(a * rate) : int(b * rate)]}

    return safe_map(df, one, f"{samples} array<double>", [c for c in df.columns if c not in (samples, "error")])


def stitched_windows(df: DataFrame, previous: str = "previous", main: str = "samples", following: str = "following", start: str = "start_s", end: str = "end_s", fs: str = "fs") -> DataFrame:
    """df with ``samples`` of [start, end) relative to main, reaching into its neighbours, as intervals.window_samples() gives
    them, and ``error``. Neighbours that are null are zeros; a bad one that a window reaches is an error, others aren't read.
    """

    def one(row: dict) -> dict:
        x = _signal(row, main)
        a, b, rate = _span(row, start, end, fs)
        frames = lambda seconds: int(seconds * rate)
        parts, length = [], len(x) / rate
        if not len(x):
            raise ValueError(f"no {main}")
        if a < 0:
            if row[previous] is None:
                parts.append(np.zeros(frames(-a)))
            else:
                p = _signal(row, previous)
                parts.append(p[max(0, min(frames(max(0.0, len(p) / rate + a)), len(p) - 1)) :])
        at = max(0, min(frames(max(0.0, a)), len(x) - 1))
        parts.append(x[at : max(at, min(frames(min(length, b)), len(x)))])
        if b > length:
            after = frames(b - length)
            parts.append(np.zeros(after) if row[following] is None else _signal(row, following)[:after])
        whole, n = np.concatenate(parts), frames(b - a)
        return {main: np.concatenate([whole[:n], np.zeros(max(0, n - len(whole)))])}

    return safe_map(df, one, f"{main} array<double>", [c for c in df.columns if c not in (previous, main, following, "error")])
