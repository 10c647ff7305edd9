"""Filters and projections over calls, scores, spectra and nested items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_incomplete(df: DataFrame, essential: list[str]) -> DataFrame:
    return df.na.drop(subset=essential)


def select_calls(calls: DataFrame, device: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Calls of a device, from start to end, all optional and inclusive."""
    if device is not None:
        calls = calls.filter(F.col("device_code") == device)
    if start is not None:
        calls = calls.filter(F.col("call_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        calls = calls.filter(F.col("call_ts") <= F.lit(end).cast("timestamp_ntz"))
    return calls


def duration_band(calls: DataFrame, least: float = 1.0, most: float = 30.0) -> DataFrame:
    return calls.withColumn("duration", F.col("end_s") - F.col("begin_s")).filter(F.col("duration").between(least, most))


def by_score(df: DataFrame, threshold: float, above: bool = True, score: str = "confidence") -> DataFrame:
    return df.filter(F.col(score) >= threshold if above else F.col(score) < threshold)


def by_class_score(items: DataFrame, hierarchy: str, threshold: float, above: bool = True) -> DataFrame:
    """Items any of whose outputs for the class qualifies; a missing score counts as 0."""

    def hit(o: Column) -> Column:
        s = F.coalesce(o["score"], F.lit(0.0))
        return (o["class_hierarchy"] == hierarchy) & (s >= threshold if above else s < threshold)

    return items.filter(F.exists("model_outputs", hit))


def unreviewed(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("expert_label").isNull())


def unverified(items: DataFrame) -> DataFrame:
    return items.filter(F.coalesce(F.array_size("verifications"), F.lit(0)) == 0)


def band_cells(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Cells within the band, both ends included; may be none."""
    return cells.filter(F.col("f_idx").between(low, high))


def band_rows(f: Column, p: Column, low: float, high: float) -> Column:
    """Matrix rows in the band, or all of them where none is in it."""
    pairs = F.filter(F.arrays_zip(f.alias("f"), p.alias("p")), lambda x: x["f"].between(low, high))
    return F.when(F.size(pairs) == 0, p).otherwise(F.transform(pairs, lambda x: x["p"]))


def trim_frames(cells: DataFrame, start: float, end: float) -> DataFrame:
    """Frames from start to end with the time axis from zero."""
    return cells.filter(F.col("t_idx").between(start, end)).withColumn("t_idx", F.col("t_idx") - start)


def aliased(df: DataFrame, aliases: list[str], name: str) -> Column:
    """The first of the aliases that df has, in any case; resolved from the schema, never per row."""
    for exact in (True, False):
        for a in aliases:
            for c in df.columns:
                if c == a if exact else c.lower() == a.lower():
                    return F.col(c).alias(name)
    raise ValueError(f"none of {aliases} in {df.columns}")


#: Names of spectrogram columns, of power and of decibels.
POWER_ALIASES = ["P", "Sxx", "PSD", "psd", "power_spectrogram"]
DB_ALIASES = ["PdB_norm", "power_db_norm", "PdB", "P_db"]
OTHER_ALIASES = ["spectrogram", "PdB_norm", "power_db_norm", "PdB", "P_db", "P", "PSD", "psd", "Sxx", "S", "spec", "power_spectrogram"]


def spectrum(df: DataFrame) -> list[Column]:
    """(spectrum, spec_kind): a power column if df has one, whatever decibel columns it has, else any other as db."""
    for aliases, kind in ((POWER_ALIASES, "power"), (DB_ALIASES, "db"), (OTHER_ALIASES, "db")):
        try:
            return [aliased(df, aliases, "spectrum"), F.lit(kind).alias("spec_kind")]
        except ValueError:
            continue
    raise ValueError(f"no spectrogram column in {df.columns}")
