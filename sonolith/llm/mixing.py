"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source that should appear r times is taken floor(r) times whole. For the rest, documents are ranked by random odds
divided by inclusion odds, and a sample of fixed size in words is the head of that order. Inclusion odds are those of the
source's rest, lower for documents longer than its mean and up to twice as high for shorter ones, so that one long
document weighs less in what is repeated. The rank value decides a document by itself, so a few numbers per source say
which documents are in and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Rank values fall in so many buckets; only the bucket in which a sample ends is sorted.
BUCKETS = 4096
#: The table of sources is broadcast up to this many rows (few_sources); beyond, only that of hot ones.
BROADCAST_SOURCES = 20_000
WEIGHTS = (5, 2, 1)
MOST = 3


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """52 bits of md5(seed|id|md5 of the text) as a number from 0 to below 1; nulls count as empty."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rank_value(u: Column, p: Column, mean: Column, size: Column) -> Column:
    """Pareto rank odds(u) / inclusion odds, mapped in order onto 0 to 1.

    Inclusion odds are odds(p) for a document of the mean size, times 2 * mean / (mean + size) for any.
    """
    q = (u / (1 - u)) / ((p / (1 - p)) * (2 * mean / (mean + size)))
    return q / (1 + q)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source (key, source_size, n_docs): its target, copies = floor(target / size) and p, the rest of that ratio.

    Weights repeat over the sources in order. What a source's ceiling of ``most`` times its size leaves over goes to
    the others by weight. With sources sorted by ceiling over weight, the capped ones come first, so prefix sums give
    the common level at once. One row per source is sorted in one task.
    """
    order = Window.orderBy("key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight)
    ratio = F.lit(float(most)) * F.col("source_size") / F.col("w")
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    t = t.withColumn("ratio", ratio).withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(everything)["level"]
    t = t.withColumn("target", F.least(F.coalesce(first, F.lit(0.0)) * F.col("w"), F.lit(float(most)) * F.col("source_size")))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("copies", F.floor(times).cast("int")).withColumn("p", times - F.floor(times))
    gap = F.when(F.col("p") > 0, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.col("source_size") / F.col("n_docs")
    return t.select("key", "source_size", "n_docs", mean.alias("mean"), "target", "copies", "p", gap.alias("gap"))


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """rows with what is known of their source: by broadcast, or where sources are many, that of hot ones alone."""
    if few:
        return rows.join(F.broadcast(sources), "key")
    total = sources.agg(F.sum("n_docs")).first()[0] or 0
    return C.join_groups(rows, sources, "key", "n_docs", total).filter("n_docs IS NOT NULL")


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", rounds: int = 2, few_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """One row per source: key, source_size, n_docs, mean, target, copies, p, and ``heads``.

    A document is sampled if a head (low, high, most) has low < rank value <= high and its size is at most ``most``. The
    first head is the longest that the target holds; the second starts behind it and fills what is left with documents
    that fit, so that a long document at the end of the first doesn't leave the target far.
    """
    rows = docs.select(source_key(F.col(source)).alias("key"), n_words(F.col(text)).alias("size"), uniform(F.col(doc_id), F.col(text), seed).alias("u"))
    rows = C.materialize(rows, "sizes")
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goals = C.materialize(targets(sizes, weights, most), "targets")
    few = goals.count() <= few_sources
    ranked = _with_sources(rows, goals.filter("p > 0").select("key", "n_docs", "p", "mean"), few)
    ranked = ranked.withColumn("v", rank_value(F.col("u"), F.col("p"), F.col("mean"), F.col("size"))).select("key", "size", "v")
    state = goals.select("key", "n_docs", "gap", F.lit(-1.0).alias("low"), F.array().cast("array<struct<low:double,high:double,most:double>>").alias("heads"))
    for _ in range(rounds):
        open_ = _with_sources(ranked, state.select("key", "n_docs", "gap", "low"), few)
        open_ = open_.filter("v > low AND size <= gap").withColumn("bucket", F.least(F.floor(F.col("v") * BUCKETS), F.lit(BUCKETS - 1)))
        per = open_.groupBy("key", "bucket").agg(F.sum("size").alias("n"), F.max("gap").alias("gap"))
        per = per.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")))
        end = per.filter("upto > gap").groupBy("key").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("base"))).alias("e"))
        end = end.select("key", "e.bucket", "e.base")
        last = open_.join(F.broadcast(end) if few else end, ["key", "bucket"])
        last = last.withColumn("upto", F.col("base") + F.sum("size").over(Window.partitionBy("key").orderBy("v")))
        within = F.col("upto") <= F.col("gap")
        last = last.groupBy("key").agg(F.max(F.when(within, F.col("v"))).alias("v"), F.max(F.when(within, F.col("upto"))).alias("used"), F.max("bucket").alias("bucket"), F.max("base").alias("base"))
        # no row of the last bucket fits: the head ends with the bucket before
        last = last.select("key", F.coalesce("v", F.col("bucket") / F.lit(float(BUCKETS))).alias("high"), F.coalesce("used", "base").alias("used"))
        everything = per.groupBy("key").agg(F.max("upto").alias("all"))
        state = state.join(everything, "key", "left").join(last, "key", "left")
        high = F.coalesce("high", F.when(F.col("all").isNotNull(), F.lit(2.0)), F.col("low"))
        used = F.coalesce("used", "all", F.lit(0))
        head = F.struct(F.col("low"), high.alias("high"), F.col("gap").cast("double").alias("most"))
        state = state.select("key", "n_docs", (F.col("gap") - used).alias("gap"), high.alias("low"), F.concat("heads", F.array(head)).alias("heads"))
        state = C.materialize(state, "heads")
    return goals.drop("gap").join(state.select("key", "heads"), "key")


def taken_copies(size: Column, u: Column) -> Column:
    """Copies of a document, from the columns of its source's plan."""
    v = rank_value(u, F.col("p"), F.col("mean"), size)
    sampled = F.exists("heads", lambda h: (v > h["low"]) & (v <= h["high"]) & (size <= h["most"]))
    return F.col("copies") + F.when((F.col("p") > 0) & sampled, 1).otherwise(0)


def _planned(docs: DataFrame, text: str, source: str, doc_id: str, seed: str, few_sources: int = BROADCAST_SOURCES, **options) -> DataFrame:
    p = plan(docs, text, source, doc_id, seed=seed, few_sources=few_sources, **options)
    few = p.count() <= few_sources
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = rows.withColumn("key", source_key(F.col("row")[source])).withColumn("size", n_words(F.col("row")[text]))
    rows = _with_sources(rows, p, few)
    return rows.withColumn("times", taken_copies(F.col("size"), uniform(F.col("row")[doc_id], F.col("row")[text], seed)))


def report(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix", **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    Null texts have size 0; null sources are one source, the last; documents without words are taken or left at no
    cost. Rows equal in doc_id, text and source share their fate; others don't, whatever their ids. An empty table gives an empty result.
    """
    rows = _planned(docs, text, source, doc_id, seed, **options)
    return rows.select(F.col("row")[doc_id].alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix", **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of docs."""
    rows = _planned(docs, text, source, doc_id, seed, **options).filter("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
