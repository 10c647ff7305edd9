"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, scratch

__all__ = ["discard", "in_frame", "join_groups", "materialize", "pieces", "scratch", "table", "text_or_empty"]

#: ASCII white space; every contract splits words on it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: With an allowed group share of 1/HOT_GROUPS of all rows at least, no more than this many groups are hot.
HOT_GROUPS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_frame(name: str, df: DataFrame) -> str:
    """``name``, or the first of ``name_1``, ``name_2``... that no column of df has (in any case)."""
    taken, out, i = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        i += 1
        out = f"{name}_{i}"
    return out


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of rows to one row per key, safe when one key holds a large share of the rows.

    Groups with over total/HOT_GROUPS rows number under HOT_GROUPS whatever the input, so they are broadcast. Rows
    that found theirs there get a spread key that nothing matches; the rest join by shuffle. Null keys match nothing.
    """
    cols = [c for c in groups.columns if c != key]
    limit = max(total // HOT_GROUPS, 1)
    hot = groups.filter(F.col(count) > limit).select(F.col(key), F.struct(*cols).alias("_hot"))
    cold = groups.filter(F.col(count) <= limit)
    cold = cold.select(F.lit(True).alias("_f"), F.col(key).alias("_k"), F.struct(*cols).alias("_cold"))
    spread = F.monotonically_increasing_id().cast("string").cast(dict(rows.dtypes)[key])
    out = rows.join(F.broadcast(hot), key, "left").withColumn("_f", F.col("_hot").isNull())
    out = out.withColumn("_k", F.when(F.col("_f"), F.col(key)).otherwise(spread)).join(cold, ["_f", "_k"], "left")
    both = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*rows.columns, *[both[c].alias(c) for c in cols])


def pieces(batches: Iterable, rows: int = 256, size: int = 4 << 20) -> Iterator:
    """Arrow batches cut by rows, and halved while over ``size`` bytes, so that a task holds few texts at a time."""
    for batch in batches:
        waiting = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            part = waiting.pop()
            if part.nbytes <= size or part.num_rows == 1:
                yield part
            else:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
