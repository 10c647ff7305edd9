"""Ranks, prefix sums and hash-ordered samples without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_key, unit
from ..session import materialize

__all__ = ["earlier_max", "global_rank", "hash_key", "numbered", "prefix_counts", "running_count", "sorted_places", "top_per_group", "unit"]


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def prefix_counts(df: DataFrame, by: list[str], bucket: str, values: dict[str, Column]) -> DataFrame:
    """Per group and bucket: sums of values over the buckets before it (``name_before``) and in it (``name_here``).

    One row per group and bucket is left before the window, so callers bound the buckets.
    """
    per = df.groupBy(*by, bucket).agg(*[F.sum(v).alias(f"{n}_here") for n, v in values.items()])
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select("*", *[F.coalesce(F.sum(f"{n}_here").over(w), F.lit(0)).alias(f"{n}_before") for n in values])


def global_rank(df: DataFrame, by: list[str], key: str, name: str = "rank", digits: int = 3) -> DataFrame:
    """Rank from 1 by a hash key within groups, however large: rank in the bucket of its first hex digits, plus the
    number of rows in the buckets before. Groups have at most 16**digits buckets."""
    rows = df.withColumn("_bucket", F.substring(key, 1, digits))
    before = prefix_counts(rows, by, "_bucket", {"n": F.lit(1)}).select(*by, "_bucket", "n_before")
    w = Window.partitionBy(*by, "_bucket").orderBy(key)
    ranked = rows.withColumn("_in", F.row_number().over(w)).join(before, [*by, "_bucket"])
    return ranked.withColumn(name, F.col("_in") + F.col("n_before")).drop("_bucket", "_in", "n_before")


def sorted_places(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in a global sort.

    The sort deals rows to partitions in order; a row's place is its place there plus the rows of the partitions before.
    """
    rows = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    rows = materialize(rows, "sorted")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))  # one row per partition
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(sizes, "_part").withColumn(name, F.col("_in") + F.col("_before") + 1).drop("_part", "_in", "_before")


def numbered(df: DataFrame, by: str, order: list, form: str, name: str) -> DataFrame:
    """df with ids of a form such as %s_neg_%d: the source and the row's number in it, from 0."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumn(name, F.format_string(form, F.col(by), n))


def earlier_max(df: DataFrame, by: list[str], bucket: str, order: list, value: str, name: str) -> DataFrame:
    """df with the largest value of all rows of the group that come before, by bucket and then by order; null at its start.

    A scan in segments: inside a bucket rows run, between buckets one number does, so no task sorts a whole group.
    """
    inside = F.max(value).over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    per = df.groupBy(*by, bucket).agg(F.max(value).alias("_most"))
    carry = F.max("_most").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    carried = per.select(*by, bucket, carry.alias("_carry"))
    out = df.withColumn("_inside", inside).join(carried, [*by, bucket])
    # written, as scans follow one another and each reads its rows twice
    return materialize(out.withColumn(name, F.greatest("_inside", "_carry")).drop("_inside", "_carry"), "scanned")


def running_count(df: DataFrame, by: list[str], bucket: str, order: list, counted: Column, name: str) -> DataFrame:
    """df with the number of counted rows of the group up to and with this one, by bucket and then by order, in segments too."""
    rows = df.withColumn("_one", F.when(counted, 1).otherwise(0))
    before = prefix_counts(rows, by, bucket, {"c": F.col("_one")}).select(*by, bucket, "c_before")
    inside = F.sum("_one").over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, inside).join(before, [*by, bucket]).withColumn(name, F.col(name) + F.col("c_before")).drop("_one", "c_before")
