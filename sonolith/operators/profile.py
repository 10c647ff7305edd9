"""Profiles and consistency checks of datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tiling import even_starts


def dataset_report(spectra: DataFrame, calls: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: calls, spectrograms by kind (negative where the id contains _neg_), failures, clips, devices, dates."""
    a = calls.agg(F.count("*").alias("calls"), F.count_distinct("clip_id").alias("clips"), F.count_distinct("device_code").alias("devices"), F.min("call_ts").alias("first"), F.max("call_ts").alias("last"))
    negative = F.contains("spec_id", F.lit("_neg_"))
    b = spectra.agg(F.count("*").alias("spectrograms"), F.count_if(~negative).alias("positives"), F.count_if(negative).alias("negatives"))
    return a.crossJoin(b).crossJoin(failed.agg(F.count("*").alias("failed")))  # one row each


def field_profile(df: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    """Per field: type, non-null values, least and greatest size, from one pass."""
    types = dict(df.dtypes)
    one = df.agg(*[f(x).alias(f"{n}_{k}") for n, x in sizes.items() for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(types[n]).alias("type"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_lo").cast("long").alias("least"), F.col(f"{n}_hi").cast("long").alias("greatest")) for n in sizes])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def per_hydrophone(packed: DataFrame) -> DataFrame:
    return packed.groupBy(S.hydrophone(F.col("source")).alias("hydrophone")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hydrophone")


def coverage(times: DataFrame, at: str) -> DataFrame:
    """Earliest and latest time, whole days between, distinct times; rows without a time are left out."""
    t = times.filter(F.col(at).isNotNull()).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(at).alias("n"), F.count_distinct(at).alias("distinct_times"))
    return t.withColumn("days", F.floor(F.expr("timestampdiff(SECOND, first, last)") / 86400))


def combination_counts(packed: DataFrame) -> DataFrame:
    """Counts of label combinations, whatever their order."""
    return packed.groupBy(F.array_join(F.array_sort(F.split("label_string", ";")), ";").alias("labels")).agg(F.count("*").alias("n"))


def label_counts(packed: DataFrame) -> DataFrame:
    """Samples per single label with their percentage of all samples."""
    total = packed.agg(F.count("*").alias("total"))
    per = packed.select(F.explode(F.split("label_string", ";")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(total)).select("label", "n", (100 * F.col("n") / F.col("total")).alias("percent"))  # total is one row


def normal_share(packed: DataFrame) -> DataFrame:
    """Samples per hydrophone, how many are normal (label normal or empty), and the percentage."""
    normal = F.col("label_string").isin("normal", "")
    g = packed.groupBy(S.hydrophone(F.col("source")).alias("hydrophone")).agg(F.count("*").alias("total"), F.count_if(normal).alias("normal"))
    return g.withColumn("anomalous", F.col("total") - F.col("normal")).withColumn("percent", 100 * F.col("normal") / F.col("total"))


def consistency(chunks: DataFrame, crop: int, window_s: float, overlap: float, tolerance: float = 1e-3) -> DataFrame:
    """Per source of a window catalogue: faults of shape, frequency bins, time bounds, timing and starts.

    chunks has source, total (frames), freq (rows of the original), rows, cols, start (frame), t_start, t_end (seconds).
    Timing is held against start * hop + offset, where hop and offset are upper medians of what the source's own windows
    say, the nominal hop and 0 without any. start_faults are starts missing or not expected. A source's windows, as many
    as its recording has room for, meet once; the rest is array functions.
    """
    nominal = window_s * (1.0 - overlap)
    fields = ("total", "start", "freq", "rows", "cols", "t_start", "t_end")
    g = chunks.groupBy("source").agg(F.max("total").alias("total"), F.collect_list(F.struct(*fields)).alias("w"))
    bins = lambda x: F.least(F.lit(crop), x["total"] - x["start"])
    timed = lambda x: x["t_start"].isNotNull() & x["t_end"].isNotNull()
    count = lambda test: F.size(F.filter("w", test)).cast("long")

    def upper(value: Callable[[Column], Column]) -> Column:
        held = F.array_sort(F.filter(F.transform("w", value), lambda v: v.isNotNull()))
        return F.get(held, F.floor(F.size(held) / 2).cast("int"))

    def own_hop(x: Column) -> Column:
        hop = (x["t_end"] - x["t_start"] - window_s) / (bins(x) - 1)
        return F.when(timed(x) & (bins(x) > 1) & (hop > 0), hop)

    g = g.withColumn("hop", F.coalesce(upper(own_hop), F.lit(nominal)))
    own_offset = lambda x: F.when(x["t_start"].isNotNull() & (x["start"] != 0), x["t_start"] - x["start"] * F.col("hop"))
    g = g.withColumn("offset", F.coalesce(upper(own_offset), F.lit(0.0)))
    begin = lambda x: F.greatest(F.lit(0.0), x["start"] * F.col("hop") + F.col("offset"))
    end = lambda x: begin(x) + (bins(x) - 1) * F.col("hop") + window_s
    off = lambda field, want: count(lambda x: timed(x) & (F.abs(x[field] - want(x)) > tolerance))
    starts, expected = F.array_distinct(F.filter("w.start", lambda v: v.isNotNull())), even_starts(F.col("total"), F.lit(crop))
    return g.select(
        "source", F.size("w").cast("long").alias("windows"), count(lambda x: (x["rows"] != crop) | (x["cols"] != crop)).alias("shape_faults"),
        count(lambda x: x["freq"] != crop).alias("freq_faults"),
        count(lambda x: timed(x) & (x["t_end"] > window_s + (x["total"] - 1) * nominal + tolerance)).alias("bound_faults"),
        (off("t_start", begin) + off("t_end", end)).alias("timing_faults"),
        (F.size(F.array_except(expected, starts)) + F.size(F.array_except(starts, expected))).alias("start_faults"),
    )


def consistency_totals(faults: DataFrame) -> DataFrame:
    """One row: sources, windows, faults of each kind, and sources whose starts aren't those expected."""
    sums = [F.sum(c).alias(c) for c in ("windows", "shape_faults", "freq_faults", "bound_faults", "timing_faults")]
    return faults.agg(F.count("*").alias("sources"), *sums, F.count_if(F.col("start_faults") > 0).alias("sources_off"))


def upper_median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Element n // 2 of the sorted values, from 0: never interpolated.

    It is the lower median of the descending order, so counts per value are pre-aggregated and no list is collected.
    """
    return df.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").alias(name))


def shift_warning(clip_lengths: DataFrame, by: list[str], value: str, context: float, least: float = 2.0) -> DataFrame:
    """Whether the upper median length is at least so many training contexts."""
    m = upper_median(clip_lengths, by, value, "median")
    return m.select(*by, (F.col("median") / context).alias("ratio"), (F.col("median") / context >= least).alias("shifted"))


def calls_per_clip(calls: DataFrame) -> DataFrame:
    """Per clip: number of calls and their intervals in order."""
    return calls.groupBy("clip_id").agg(F.count("*").alias("calls"), F.array_sort(F.collect_list(F.struct("begin_s", "end_s"))).alias("intervals"))


def sources_per_class(entries: DataFrame) -> DataFrame:
    return entries.groupBy("label").agg(F.count_distinct("src_id").alias("sources"), F.count("*").alias("entries"))


def resolution(f: Column, t: Column) -> list[Column]:
    """Hz per bin, ms per bin and the text of both sizes, from the axes."""
    hz = (F.element_at(f, -1) - F.element_at(f, 1)) / F.greatest(F.lit(1), F.size(f) - 1)
    ms = 1000 * (F.element_at(t, -1) - F.element_at(t, 1)) / F.greatest(F.lit(1), F.size(t) - 1)
    return [hz.alias("hz_per_bin"), ms.alias("ms_per_bin"), F.format_string("%d x %d", F.size(f), F.size(t)).alias("size")]


def parameter_drift(params: DataFrame, one: str, other: str) -> DataFrame:
    """Parameters that both runs have and that differ. params: run, param, value."""
    a = params.filter((F.col("run") == one) & F.col("value").isNotNull()).select("param", F.col("value").alias("a"))
    b = params.filter((F.col("run") == other) & F.col("value").isNotNull()).select("param", F.col("value").alias("b"))
    return a.join(b, "param").filter("a <> b")


def failures(results: DataFrame, key: str = "call_id") -> DataFrame:
    """Rows of a stage that kept an error instead of a result (as load_clips does): the key, clip_id, reason."""
    return results.filter(F.col("error").isNotNull()).select(*dict.fromkeys([key, "clip_id"]), F.col("error").alias("reason"))
