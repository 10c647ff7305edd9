"""Reviewable scores: labels, verification rounds, summaries and the joined record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def with_metadata(scores: DataFrame, catalogue: DataFrame, key: str = "file_id", order: list[str] | None = None) -> DataFrame:
    """Scores with the catalogue row of their id, else of the id before its last _win; ``meta`` is null if neither is.

    Of catalogue rows with one id the last by ``order`` counts (by all their columns where none is given).
    """
    cols = [c for c in catalogue.columns if c != key]
    last = catalogue.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*(order or cols))).alias("_m"))
    exact = last.select(F.col(key).alias("_exact"), F.col("_m").alias("_m1"))
    base = last.select(F.col(key).alias("_base"), F.col("_m").alias("_m2"))
    j = scores.withColumn("_b", S.base_id(F.col(key)))
    j = j.join(exact, j[key] == F.col("_exact"), "left").join(base, F.col("_b") == F.col("_base"), "left")
    return j.withColumn("meta", F.coalesce("_m1", "_m2")).drop("_exact", "_base", "_m1", "_m2", "_b")


def upsert_labels(predictions: DataFrame, updates: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions with the latest update per id, updates of unknown ids). updates: file_id, label, reviewer, at.

    An update sets label, reviewer and time together; predictions without one keep all three. Of predictions with one id
    the first by ``order`` takes it (by all their columns where none is given), the others stay as they are.
    """
    latest = updates.groupBy("file_id").agg(F.max_by(F.struct("label", "reviewer", "at"), F.struct("at", "label")).alias("_u"))
    w = Window.partitionBy("file_id").orderBy(*(order or [c for c in predictions.columns if c != "file_id"]))
    out = predictions.withColumn("_n", F.row_number().over(w)).join(latest, "file_id", "left")
    takes = F.col("_u").isNotNull() & (F.col("_n") == 1)
    for column, field in (("expert_label", "label"), ("expert_reviewer", "reviewer"), ("review_timestamp", "at")):
        out = out.withColumn(column, F.when(takes, F.col("_u")[field]).otherwise(F.col(column)))
    return out.drop("_u", "_n"), updates.join(predictions, "file_id", "left_anti")


def number_rounds(verifications: DataFrame, existing: Column, item: str = "item_id", at: str = "verified_at") -> DataFrame:
    """``verification_round``: place among the item's new verifications plus the rounds that it had."""
    w = Window.partitionBy(item).orderBy(at, *[c for c in verifications.columns if c not in (item, at)])
    return verifications.withColumn("verification_round", F.row_number().over(w) + existing)


def append_verifications(items: DataFrame, verifications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with the new rounds after those that they had, verifications of unknown ids).

    verifications has item_id and columns named as the fields of an item's entries; fields that it lacks become null, and
    verification_round is counted on. Items without new rounds stay as they are.
    """
    entries = items.schema["verifications"].dataType.elementType
    known = verifications.join(items.select("item_id"), "item_id", "left_semi")
    had = items.select("item_id", F.coalesce(F.array_size("verifications"), F.lit(0)).alias("_had"))
    w = Window.partitionBy("item_id").orderBy("verified_at", "verified_by")
    new = known.join(had, "item_id").withColumn("verification_round", F.row_number().over(w) + F.col("_had"))
    fields = [(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.fields]
    order = F.array_sort(F.collect_list(F.struct(F.col("verification_round").alias("_n"), F.struct(*fields).alias("_entry"))))
    added = new.groupBy("item_id").agg(order.alias("_added"))
    out = items.join(added, "item_id", "left")
    more = F.concat(F.coalesce("verifications", F.array().cast(items.schema["verifications"].dataType)), F.transform("_added", lambda x: x["_entry"]))
    out = out.withColumn("verifications", F.when(F.col("_added").isNull(), F.col("verifications")).otherwise(more)).drop("_added")
    return out.select(*items.columns), verifications.join(items.select("item_id"), "item_id", "left_anti")


def summary_v1(predictions: DataFrame) -> DataFrame:
    r = F.col("expert_label").isNotNull()
    return predictions.agg(F.count("*").alias("total"), F.count_if(r).alias("reviewed"), F.count_if(~r).alias("unreviewed"), F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max"))


def summary_v2(items: DataFrame) -> DataFrame:
    """Item counts, and statistics over the class outputs of all items."""
    n = F.coalesce(F.array_size("verifications"), F.lit(0))
    counts = items.agg(F.count("*").alias("items"), F.count_if(n > 0).alias("verified"), F.sum(n).alias("rounds"))
    s = items.select(F.explode("model_outputs").alias("o")).select("o.score").agg(F.count("score").alias("scores"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))
    return counts.crossJoin(s)  # one row each


def threshold_preview(predictions: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Count and percent of scores at or above each threshold, from one pass."""
    one = predictions.agg(F.count("*").alias("n"), *[F.count_if(F.col("confidence") >= x).alias(f"c{i}") for i, x in enumerate(thresholds)])
    pairs = F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"c{i}").alias("count")) for i, x in enumerate(thresholds)])
    return one.select("n", F.explode(pairs).alias("p")).select("p.threshold", "p.count", (100 * F.col("p.count") / F.greatest("n", F.lit(1))).alias("percent"))


def linear_scores(df: DataFrame, features: str, weights: list[float], bias: float) -> Column:
    """Positive-class probability of a linear model, as one native expression."""
    w = F.array(*map(F.lit, weights))
    dot = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return S.positive_probability(F.lit(0.0), dot + bias)


def plugin_scores(df: DataFrame, features: str, load: Callable[[], Callable[[pd.Series], pd.Series]], name: str = "score") -> DataFrame:
    """df with the score of a plug-in: ``load`` runs once per task and returns a function of Arrow batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for batch in batches:
            yield scorer(batch)

    return df.withColumn(name, score(features))


def assembled(scores: DataFrame, catalogue: DataFrame, hierarchy: str) -> DataFrame:
    """v2 items: id, paths, duration and one class output; a matched catalogue row wins even where it is null."""
    j = with_metadata(scores, catalogue)
    matched = F.col("meta").isNotNull()
    return j.select(
        F.col("file_id").alias("item_id"),
        S.default_path(matched, F.col("meta.mat_path"), "spectrograms", F.col("file_id"), "mat").alias("mat_path"),
        S.default_path(matched, F.col("meta.audio_path"), "audio", F.col("file_id"), "wav").alias("audio_path"),
        S.score_duration(F.lit(None).cast("double"), F.col("meta.window_time_start"), F.col("meta.window_time_end")).alias("duration_sec"),
        F.array(F.struct(F.lit(hierarchy).alias("class_hierarchy"), F.col("score"))).alias("model_outputs"),
    )
