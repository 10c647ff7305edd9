"""Interval algebra over calls and windows, and joins by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import earlier_max, hash_key, running_count, top_per_group, unit


#: Seconds of a key that are scanned together; a key of any length is scanned bucket by bucket.
SEGMENT_S = 3600.0


def merged_intervals(calls: DataFrame, margin: float, length: Column | float, key: str = "clip_id", segment_s: float = SEGMENT_S) -> DataFrame:
    """Islands of calls, widened by margin and clamped to [0, length]; touching ones merge. (key, island, start, end)"""
    length = F.lit(length) if isinstance(length, float | int) else length
    s = calls.select(key, F.greatest(F.lit(0.0), F.col("begin_s") - margin).alias("s"), F.least(length, F.col("end_s") + margin).alias("e"))
    s = s.withColumn("_bucket", F.floor(F.col("s") / segment_s))
    s = earlier_max(s, [key], "_bucket", ["s", "e"], "e", "_reach")
    s = running_count(s, [key], "_bucket", ["s", "e"], F.col("s") > F.coalesce("_reach", F.lit(-1.0)), "island")
    return s.groupBy(key, "island").agg(F.min("s").alias("start"), F.max("e").alias("end"))


def free_gaps(clips: DataFrame, calls: DataFrame, margin: float, key: str = "clip_id", segment_s: float = SEGMENT_S) -> DataFrame:
    """Call-free gaps in [0, length_s], of positive length: (key, gap, start, end). A clip without calls is one gap."""
    islands = merged_intervals(calls.join(clips.select(key, "length_s"), key), margin, F.col("length_s"), key, segment_s)
    tail = clips.select(key, F.col("length_s").alias("start"), F.col("length_s").alias("end"))
    marks = materialize(islands.select(key, "start", "end").unionByName(tail).withColumn("_bucket", F.floor(F.col("start") / segment_s)), "marks")
    # islands don't overlap, so the end of the one before is the largest before
    gaps = earlier_max(marks, [key], "_bucket", ["start", "end"], "end", "_s").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    gaps = running_count(gaps, [key], "_bucket", ["start", "end"], F.col("start") > F.col("_s"), "_n").filter(F.col("start") > F.col("_s"))
    return gaps.select(key, F.col("_n").cast("int").alias("gap"), F.col("_s").alias("start"), F.col("start").alias("end"))


def negative_windows(clips: DataFrame, calls: DataFrame, context: float = 40.0, margin: float = 2.0, per_call: int = 1, seed: str = "neg", tries: int = 5) -> DataFrame:
    """Up to k = calls * per_call call-free windows of context seconds per clip, any two overlapping by 20 % at most.

    tries * k draws are made: each picks a gap of context seconds at least, by its length, and a start anywhere in it, and
    is kept unless it overlaps one kept before by more. Draws are made from md5 of the clip and their number. A clip's gaps and
    windows are one row, of no more than its length has room for. (clip_id, n, start, end), n by start
    """
    wide = free_gaps(clips, calls, margin).filter(F.col("end") - F.col("start") >= context)
    upto = Window.partitionBy("clip_id").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.withColumn("upto", F.sum(F.col("end") - F.col("start")).over(upto))
    gaps = wide.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("upto", "start", "end"))).alias("gaps"))
    wanted = calls.groupBy("clip_id").agg((F.count("*") * per_call).alias("k"))
    draw = lambda i, name: unit(hash_key(seed, F.col("clip_id"), i, F.lit(name)))

    def placed(i: Column) -> Column:
        total = F.element_at("gaps", -1)["upto"]
        gap = F.coalesce(F.get(F.filter("gaps", lambda g: g["upto"] > draw(i, "gap") * total), F.lit(0)), F.element_at("gaps", -1))
        return gap["start"] + draw(i, "start") * (gap["end"] - context - gap["start"])

    def kept(held: Column, i: Column) -> Column:
        free = lambda s: ~F.exists(held, lambda x: context - F.abs(x - s) > 0.2 * context)
        one = F.filter(F.array(placed(i)), free)
        return F.when(F.size(held) < F.col("k"), F.concat(held, one)).otherwise(held)

    attempts = F.sequence(F.lit(1).cast("long"), F.col("k") * tries)
    starts = gaps.join(wanted, "clip_id").select("clip_id", F.array_sort(F.aggregate(attempts, F.array().cast("array<double>"), kept)).alias("s"))
    w = starts.select("clip_id", F.posexplode("s").alias("n", "start"))
    return w.select("clip_id", (F.col("n") + 1).alias("n"), "start", (F.col("start") + context).alias("end"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, before_s: int, after_s: int) -> DataFrame:
    """Pairs of equal key with left_at - before_s <= right_at <= left_at + after_s.

    Both sides get time buckets as wide as the span; a left row looks into the buckets that its span meets, so the join
    is an equi-join with a residual condition, not a nested loop.
    """
    width = max(1, before_s + after_s)
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    bucket = lambda m: F.floor(m / (width * 1_000_000))
    low, high = bucket(micros(left_at) - before_s * 1_000_000), bucket(micros(left_at) + after_s * 1_000_000)
    a = left.withColumn("_bucket", F.explode(F.sequence(low, high)))
    b = right.withColumn("_bucket", bucket(micros(right_at)))
    gap = F.expr(f"timestampdiff(MICROSECOND, {left_at}, {right_at})")
    return a.join(b, [key, "_bucket"]).filter(gap.between(-before_s * 1_000_000, after_s * 1_000_000)).drop("_bucket")


def arithmetic_neighbours(clips: DataFrame, seconds: int) -> DataFrame:
    """clips with the clip of the same device that starts so many seconds earlier and later, if there is one."""
    shift = lambda s, name: clips.select("device_code", F.expr(f"timestampadd(SECOND, {s}, clip_start)").alias("clip_start"), F.col("clip_id").alias(name))
    return clips.join(shift(seconds, "previous"), ["device_code", "clip_start"], "left").join(shift(-seconds, "next"), ["device_code", "clip_start"], "left")


def first_within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, before_s: int, after_s: int, order: list[str], n: int) -> DataFrame:
    """Of the pairs of interval_join(), those of the first n right rows of each left row, by right_at and then by ``order``.

    Pairs aren't made and dropped, of which there are as many as rows crowd in a span: rows of both sides are one order, in
    buckets as wide as the span, in which a left row, placed where its span begins, takes the n right rows that come next. A bucket
    also has the first n of the next one, which is all that a span can reach.
    """
    width = max(1, before_s + after_s) * 1_000_000
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    by, names = [key, "_bucket"], [c for c in right.columns if c != key]
    r = right.select(key, micros(right_at).alias("_at"), F.struct(*names).alias("_r")).filter(F.col(key).isNotNull() & F.col("_at").isNotNull())
    r = r.withColumn("_bucket", F.floor(F.col("_at") / width))
    ties = [F.col(f"_r.{c}") for c in order]
    ahead = top_per_group(r, by, ["_at", *ties], n).withColumn("_bucket", F.col("_bucket") - 1)
    # from the last to the first, as windows that grow from the front are cheap
    back = Window.partitionBy(*by).orderBy(F.desc("_at"), *[x.desc() for x in ties])
    following = F.collect_list(F.struct("_at", "_r")).over(back.rowsBetween(1 - n, 0))
    r = r.unionByName(ahead).select(*by, "_at", F.lit(1).alias("_kind"), *[x.alias(f"_o{i}") for i, x in enumerate(ties)], following.alias("_next"))
    a = left.select(key, (micros(left_at) - before_s * 1_000_000).alias("_at"), F.struct(*[c for c in left.columns if c != key]).alias("_l"), F.lit(0).alias("_kind"))
    a = a.filter(F.col(key).isNotNull() & F.col("_at").isNotNull()).withColumn("_bucket", F.floor(F.col("_at") / width))
    both = r.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.desc("_at"), F.desc("_kind"), *[F.desc(f"_o{i}") for i in range(len(order))])
    held = both.withColumn("_found", F.last("_next", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_kind = 0")
    pairs = held.select(key, "_l", "_at", F.explode("_found").alias("_f")).filter(F.col("_f._at") <= F.col("_at") + (before_s + after_s) * 1_000_000)
    return pairs.select(key, "_l.*", "_f._r.*")


def nearest_within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, tolerance_s: int, order: list[str], by: list[str]) -> DataFrame:
    """For each left row the first right row, by ``order``, within the tolerance."""
    if order[0] == right_at:
        pairs = first_within(left, right, key, left_at, right_at, tolerance_s, tolerance_s, order[1:], 1)
    else:
        pairs = interval_join(left, right, key, left_at, right_at, tolerance_s, tolerance_s)
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def assets_per_call(calls: DataFrame, assets: DataFrame, window_s: int = 900, per_call: int = 2) -> DataFrame:
    """(call_id, asset, place): the first per_call spectrogram assets within the window of each call, by time and name."""
    named = assets.filter(F.lower("asset").contains("spect"))
    named = named.select("device_code", "asset_ts", "asset")
    pairs = first_within(calls.select("call_id", "device_code", "call_ts"), named, "device_code", "call_ts", "asset_ts", window_s, window_s, ["asset"], per_call)
    w = Window.partitionBy("call_id").orderBy("asset_ts", "asset")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_call).select("call_id", "asset", "place")


def assets_of_calls(calls: DataFrame, assets: DataFrame, window_s: int = 900, per_call: int = 2) -> DataFrame:
    """At most per_call spectrogram assets within the window of each call, each asset once overall, for its first call."""
    return assets_per_call(calls, assets, window_s, per_call).groupBy("asset").agg(F.min("call_id").alias("call_id"))


def clips_around(clips: DataFrame, by: str = "device_code", order: str = "clip_start") -> DataFrame:
    """clips with ``previous`` and ``next``: the clips of the device before and after in time, however far, null at its ends."""
    w = Window.partitionBy(by).orderBy(order, "clip_id")
    return clips.withColumn("previous", F.lag("clip_id").over(w)).withColumn("next", F.lead("clip_id").over(w))


def labelled_windows(calls: DataFrame, negatives: DataFrame) -> DataFrame:
    """(clip_id, start, end, label): windows of calls with label 1 and call-free ones with label 0, none merged."""
    positive = calls.select("clip_id", F.col("begin_s").alias("start"), F.col("end_s").alias("end"), F.lit(1).alias("label"))
    return positive.unionByName(negatives.select("clip_id", "start", "end", F.lit(0).alias("label")))


def stitched(signals: DataFrame, pad: int, by: str = "device_code", order: str = "t", samples: str = "samples", fs: str = "fs") -> DataFrame:
    """``stitched``: the last pad samples of the row before, the row's, and the first pad of the next, in sort order.

    A neighbour of another sample rate is left out, as is a missing one. Only edges pass through the window.
    """
    w = Window.partitionBy(by).orderBy(order)
    edges = signals.withColumn("_tail", F.expr(f"slice({samples}, -least({pad}, size({samples})), {pad})")).withColumn("_head", F.slice(samples, 1, pad))
    empty = F.expr(f"slice({samples}, 1, 0)")
    before = F.when(F.lag(fs).over(w) == F.col(fs), F.lag("_tail").over(w)).otherwise(empty)
    after = F.when(F.lead(fs).over(w) == F.col(fs), F.lead("_head").over(w)).otherwise(empty)
    return edges.withColumn("stitched", F.concat(before, F.col(samples), after)).drop("_tail", "_head")


def sample_slice(samples: Column, start: Column, end: Column, fs: Column) -> Column:
    """Samples from int(start * fs) to int(end * fs), clamped to the recording."""
    a = F.greatest(F.lit(0), F.floor(start * fs).cast("int"))
    b = F.least(F.size(samples), F.floor(end * fs).cast("int"))
    return F.slice(samples, a + 1, F.greatest(F.lit(0), b - a))


def window_samples(previous: Column, main: Column, following: Column, start: Column, end: Column, fs: Column) -> Column:
    """Samples of [start, end) relative to main, reaching into its neighbours; zeros where there is none.

    Offsets are cut towards zero to whole samples, each part by itself, and the whole is trimmed or padded with zeros to
    int((end - start) * fs). Neighbours are null or of the same rate.
    """
    frames = lambda seconds: (seconds * fs).cast("int")
    zero = lambda k: F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), k))
    none, size = F.array().cast("array<double>"), F.size(main)
    length = size / fs
    held = F.size(previous)
    at = F.least(frames(F.greatest(F.lit(0.0), held / fs - F.abs(start))), held - 1)
    left = F.when(previous.isNull(), zero(frames(F.abs(start)))).otherwise(F.slice(previous, F.greatest(F.lit(0), at) + 1, F.greatest(F.lit(0), held - at)))
    a = F.greatest(F.lit(0), F.least(frames(F.greatest(F.lit(0.0), start)), size - 1))
    body = F.slice(main, a + 1, F.greatest(F.lit(0), F.least(frames(F.least(length, end)) - a, size - a)))
    after = frames(end - length)
    right = F.when(following.isNull(), zero(after)).otherwise(F.slice(following, F.lit(1), F.greatest(F.lit(0), F.least(after, F.size(following)))))
    whole = F.concat(F.when(start < 0, left).otherwise(none), body, F.when(end > length, right).otherwise(none))
    n = frames(end - start)
    return F.slice(F.concat(whole, zero(n - F.size(whole))), F.lit(1), F.greatest(F.lit(0), n))


def _bucketed(df: DataFrame, start: str, end: str, width_s: float) -> DataFrame:
    """A row for every time bucket that the interval meets."""
    bucket = lambda c: F.floor(F.col(c) / width_s)
    return df.withColumn("_bucket", F.explode(F.sequence(bucket(start), F.greatest(bucket(start), bucket(end)))))


def uncovered(windows: DataFrame, calls: DataFrame, margin: float, segment_s: float = SEGMENT_S) -> DataFrame:
    """Windows (clip_id, start, end) that no call, widened by margin, overlaps; those with a null among the three too.

    Calls by their start and windows by their end are one order, in which a window is free if no call before it ends later
    than it starts: one shuffle, in segments.
    """
    known = F.col("clip_id").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    c = calls.select("clip_id", (F.col("begin_s") - margin).alias("_at"), (F.col("end_s") + margin).alias("_reach"), F.lit(1).alias("_kind"))
    w = windows.filter(known).withColumn("_at", F.col("end")).withColumn("_reach", F.lit(None).cast("double")).withColumn("_kind", F.lit(0))
    both = w.unionByName(c, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / segment_s))
    both = earlier_max(both, ["clip_id"], "_bucket", ["_at", "_kind"], "_reach", "_most")  # a call that starts where a window ends is after it
    free = both.filter((F.col("_kind") == 0) & (F.col("_most").isNull() | (F.col("_most") <= F.col("start"))))
    return free.select(*windows.columns).unionByName(windows.filter(~known))


def overlapping_pairs(windows: DataFrame, key: str, row: str, start: str, end: str, least_s: float, width_s: float = 60.0) -> DataFrame:
    """Pairs of rows of one key that overlap by over least_s seconds: (key, a, b, overlap_s).

    Rows meet in time buckets; a pair counts in the bucket in which its overlap begins.
    """
    w = _bucketed(windows.select(key, row, F.col(start).alias("s"), F.col(end).alias("e")), "s", "e", width_s)
    a = w.select(key, "_bucket", F.col(row).alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = w.select(key, "_bucket", F.col(row).alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    begins = F.greatest("s1", "s2")
    pairs = a.join(b, [key, "_bucket"]).filter((F.col("a") < F.col("b")) & (F.col("_bucket") == F.floor(begins / width_s)))
    return pairs.select(key, "a", "b", (F.least("e1", "e2") - begins).alias("overlap_s")).filter(F.col("overlap_s") > least_s)


def gaps_to_next(windows: DataFrame, key: str, start: str) -> DataFrame:
    return windows.withColumn("gap", F.lead(start).over(Window.partitionBy(key).orderBy(start)) - F.col(start))


def gap_clusters(entries: DataFrame, gap: float, segment_s: float = SEGMENT_S) -> DataFrame:
    """entries with ``cluster`` per source: a new one starts where the centre is gap or more after the one before.

    Entries without a centre are clusters of their own, numbered below zero.
    """
    e = entries.withColumn("centre", (F.col("begin_s") + F.col("end_s")) / 2)
    none = F.col("centre").isNull()
    # entries without a centre come last, spread over many buckets
    apart = F.lit(1 << 60) + F.pmod(F.xxhash64("spec_id"), F.lit(4096))
    e = e.withColumn("_bucket", F.when(none, apart).otherwise(F.floor(F.col("centre") / segment_s)))
    order = [F.asc_nulls_last("centre"), "spec_id"]
    e = earlier_max(e, ["src_id"], "_bucket", order, "centre", "_before")
    e = materialize(running_count(e, ["src_id"], "_bucket", order, ~none & ~F.coalesce(F.col("centre") - F.col("_before") < gap, F.lit(False)), "cluster"), "counted")
    e = running_count(e, ["src_id"], "_bucket", order, none, "_none")
    return e.withColumn("cluster", F.when(none, -F.col("_none")).otherwise(F.col("cluster"))).select(*entries.columns, "centre", "cluster")
