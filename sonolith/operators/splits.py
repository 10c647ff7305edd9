"""Reproducible samples and train, validation and test splits, ordered by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .intervals import gap_clusters
from .ranking import global_rank, hash_key, prefix_counts, top_per_group, unit

RATIOS = (0.7, 0.15)


def _by_rank(rank: Column, n: Column, ratios: tuple[float, float]) -> Column:
    train, val = F.floor(n * ratios[0]), F.floor(n * ratios[1])
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def stratum_firsts(calls: DataFrame, each: int, strata: list[str], row: str = "call_id", seed: str = "sample") -> DataFrame:
    """The first rows of each stratum in hash order, so many at most."""
    return top_per_group(calls.withColumn("_h", hash_key(seed, F.col(row))), strata, ["_h"], each).drop("_h")


def not_sampled(calls: DataFrame, sampled: DataFrame, row: str = "call_id") -> DataFrame:
    """Rows of calls whose id isn't in the sample."""
    return calls.join(sampled.select(row), row, "left_anti").select(*calls.columns)


def sample_rounds(calls: DataFrame, n: int, strata: list[str], row: str = "call_id", seed: str = "sample") -> DataFrame:
    """n rows with ``round``: 0 for the max(1, n // strata) of each stratum in hash order, 1 for those of the rest that
    fill up, in hash order."""
    each = max(1, n // max(1, calls.select(*strata).distinct().count()))
    first = stratum_firsts(calls, each, strata, row, seed)
    extra = not_sampled(calls, first, row).orderBy(hash_key(seed, F.col(row))).limit(n)
    both = first.withColumn("round", F.lit(0)).unionByName(extra.withColumn("round", F.lit(1)))
    return both.orderBy("round", hash_key(seed, F.col(row))).limit(n)


def stratified_sample(calls: DataFrame, n: int, strata: list[str], row: str = "call_id", seed: str = "sample") -> DataFrame:
    """n rows: max(1, n // strata) of each stratum in hash order, then the first of the rest in hash order."""
    return sample_rounds(calls, n, strata, row, seed).drop("round")


def class_ranks(entries: DataFrame, seed: str = "split") -> DataFrame:
    """entries with ``rank``, from 1 in hash order within their label, and ``size``, the rows of the label."""
    ranked = global_rank(entries.withColumn("_h", hash_key(seed, F.col("spec_id"))), ["label"], "_h").drop("_h")
    return ranked.join(entries.groupBy("label").agg(F.count("*").alias("size")), "label")


def ratio_split(entries: DataFrame, ratios: tuple[float, float] = RATIOS, seed: str = "split") -> DataFrame:
    """Per label the first int(n * train) rows by hash, then int(n * val), the rest test."""
    ranked = class_ranks(entries, seed)
    return ranked.withColumn("split", _by_rank(F.col("rank"), F.col("size"), ratios)).drop("size", "rank")


def source_split(entries: DataFrame, ratios: tuple[float, float] = RATIOS, seed: str = "source") -> DataFrame:
    """Whole sources in hash order; entries inherit the split of their source."""
    sources = entries.select("src_id").distinct().withColumn("_all", F.lit(1)).withColumn("_h", hash_key(seed, F.col("src_id")))
    ranked = global_rank(sources, ["_all"], "_h")
    size = ranked.groupBy("_all").agg(F.count("*").alias("_size"))
    assigned = ranked.join(size, "_all").select("src_id", _by_rank(F.col("rank"), F.col("_size"), ratios).alias("split"))
    return entries.join(assigned, "src_id")


def time_split(entries: DataFrame, gap: float, ratios: tuple[float, float] = RATIOS, seed: str = "time") -> DataFrame:
    """Clusters of entries closer than gap go to one split each, so no two splits of a source come closer.

    Clusters of each kind (one label, the other, both) are laid in hash order, and cut where their rows reach the ratios: a
    split is within a cluster of its ratio in every kind, unless it would be empty. Where a kind has under three clusters all are
    dealt together. Of three clusters or more each split gets one at least, of two train and val. Running sums take two levels, buckets of
    the hash and clusters inside.
    """
    e = materialize(gap_clusters(entries, gap), "clustered")
    c = e.groupBy("src_id", "cluster").agg(F.count("*").alias("size"), (F.min("label") + F.max("label")).alias("_kind"))
    c = materialize(c.withColumn("_h", hash_key(seed, F.col("src_id"), F.col("cluster"))).withColumn("_bucket", F.substring("_h", 1, 3)), "clusters")
    if (c.groupBy("_kind").count().agg(F.min("count")).first()[0] or 0) < 3:
        c = c.withColumn("_kind", F.lit(0))
    before = prefix_counts(c, ["_kind"], "_bucket", {"rows": F.col("size"), "clusters": F.lit(1)}).select("_kind", "_bucket", "rows_before", "clusters_before")
    w = Window.partitionBy("_kind", "_bucket").orderBy("_h", "src_id", "cluster").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_rows", F.sum("size").over(w) - F.col("size")).withColumn("_place", F.count("*").over(w)).join(F.broadcast(before), ["_kind", "_bucket"])
    c = c.select("src_id", "cluster", "_kind", "size", (F.col("_rows") + F.col("rows_before")).alias("_before"), (F.col("_place") + F.col("clusters_before")).alias("_r"))
    c = materialize(c, "laid-clusters")
    whole = c.groupBy("_kind").agg(F.sum("size").alias("_n"), F.count("*").alias("_c"))
    train = c.join(F.broadcast(whole), "_kind").filter(F.col("_before") < ratios[0] * F.col("_n")).groupBy("_kind").agg(F.count("*").alias("_t"))
    whole = whole.join(train, "_kind", "left").withColumn("_t", F.least(F.coalesce("_t", F.lit(0)), F.greatest(F.lit(1), F.col("_c") - 2)))
    c = c.join(F.broadcast(whole), "_kind")  # one row per kind
    last = F.when(F.col("_c") > 2, "test").otherwise("val")
    middle = (F.col("_r") == F.col("_t") + 1) | (F.col("_before") < (ratios[0] + ratios[1]) * F.col("_n"))
    split = F.when(F.col("_r") <= F.col("_t"), "train").when(F.col("_r") == F.col("_c"), last).when(middle, "val").otherwise("test")
    return e.join(c.select("src_id", "cluster", split.alias("split")), ["src_id", "cluster"]).select(*e.columns, "split")


def split_counts(entries: DataFrame) -> DataFrame:
    one = F.col("label") == 1
    return entries.groupBy("split").agg(F.count_if(one).alias("pos"), F.count_if(~one).alias("neg"), F.count("*").alias("total"))


def leaked_sources(entries: DataFrame) -> DataFrame:
    """Per pair of splits the number of sources in both."""
    s = entries.select("src_id", "split").distinct()
    a, b = s.withColumnRenamed("split", "a"), s.withColumnRenamed("split", "b")
    return a.join(b, "src_id").filter("a < b").groupBy("a", "b").agg(F.count_distinct("src_id").alias("sources"))


def gap_violations(entries: DataFrame, gap: float) -> DataFrame:
    """Pairs of one source in different splits whose centres are closer than gap.

    Centres fall in buckets as wide as the gap, so a pair lies in one bucket or in two that touch. No pair is closer than
    a gap of 0.
    """
    width = gap if gap > 0 else 1.0
    c = entries.select("src_id", "spec_id", "split", ((F.col("begin_s") + F.col("end_s")) / 2).alias("c")).filter("c IS NOT NULL")
    bucket = F.floor(F.col("c") / width)
    a = c.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = c.select("src_id", F.col("spec_id").alias("other"), F.col("split").alias("split2"), F.col("c").alias("c2"), bucket.alias("_bucket"))
    close = (F.col("spec_id") < F.col("other")) & (F.col("split") != F.col("split2")) & (F.abs(F.col("c") - F.col("c2")) < gap)
    return a.join(b, ["src_id", "_bucket"]).filter(close).select("src_id", "spec_id", "other")


def balanced_draws(entries: DataFrame, draws: int | None = None, seed: str = "draw") -> DataFrame:
    """Draws with replacement in which every class has equal mass: (draw, label, spec_id); by default twice the largest
    class."""
    ranked = global_rank(entries.withColumn("_h", hash_key(seed, F.col("spec_id"))), ["label"], "_h")
    sizes = entries.groupBy("label").agg(F.count("*").alias("size"))
    known = sorted((r["label"], r["size"]) for r in sizes.collect())  # one row per class
    draws = draws if draws is not None else 2 * max((n for _, n in known), default=0)
    u, v = unit(hash_key(seed + "c", F.col("draw"))), unit(hash_key(seed + "r", F.col("draw")))
    d = entries.sparkSession.range(draws).select(F.col("id").alias("draw"))
    which = F.floor(u * len(known)).cast("int")
    label, size = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (c, n) in enumerate(known):
        label, size = F.when(which == i, c).otherwise(label), F.when(which == i, n).otherwise(size)
    d = d.select("draw", label.alias("label"), (F.floor(v * size) + 1).alias("rank"))
    return d.join(ranked.select("label", "rank", "spec_id"), ["label", "rank"]).select("draw", "label", "spec_id")
