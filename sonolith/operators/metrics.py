"""Rank and threshold metrics of scored samples, per model.

Samples are grouped by score first; cumulative counts then take two levels, over score buckets that hold about equally
many distinct scores and inside each, so no window holds a whole model, however its scores crowd. Tables of one row per
model are broadcast, as a shuffle by model would bring a model's samples together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import prefix_counts, top_per_group

BUCKETS = 256


def with_outcome(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = F.col("score") >= threshold
    return scored.withColumn("outcome", F.when(hit, F.when(F.col("y_true") == 1, "tp").otherwise("fp")).otherwise(F.when(F.col("y_true") == 1, "fn").otherwise("tn")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    o = with_outcome(scored, threshold)
    return o.groupBy("model").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "tn", "fp", "fn")])


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, tn, fp, fn; 0 where undefined."""
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    c = counts.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def curve(scored: DataFrame) -> DataFrame:
    """Per model and distinct score: pos and neg there, tp and fp at or above it, totals p and n."""
    g = scored.groupBy("model", "score").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    g = materialize(g, "scores")  # read four times below
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    edges = g.groupBy("model").agg(F.percentile_approx("score", shares, F.lit(20 * BUCKETS)).alias("_edges"))
    g = g.join(F.broadcast(edges), "model").withColumn("_bucket", F.size(F.filter("_edges", lambda x: x > F.col("score")))).drop("_edges")
    before = prefix_counts(g, ["model"], "_bucket", {"pos": F.col("pos"), "neg": F.col("neg")}).select("model", "_bucket", "pos_before", "neg_before")
    w = Window.partitionBy("model", "_bucket").orderBy(F.desc("score"))
    totals = g.groupBy("model").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    c = g.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w)).join(before, ["model", "_bucket"]).join(F.broadcast(totals), "model")
    return c.withColumn("tp", F.col("tp") + F.col("pos_before")).withColumn("fp", F.col("fp") + F.col("neg_before")).drop("_bucket", "pos_before", "neg_before")


def auc(scored: DataFrame, single_class: float | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; single_class where a model has one class only."""
    c = curve(scored)
    above = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2))
    a = c.groupBy("model").agg((above / (F.max("p") * F.max("n"))).alias("auc"), F.max("p").alias("_p"), F.max("n").alias("_n"))
    return a.select("model", F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("auc")).otherwise(F.lit(single_class).cast("double")).alias("auc"))


def roc_points(scored: DataFrame) -> DataFrame:
    return curve(scored).select("model", "score", ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr"))


def pr_points(scored: DataFrame) -> DataFrame:
    return curve(scored).select("model", "score", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("p")).alias("recall"))


def threshold_counts(scored: DataFrame, steps: int = 100) -> DataFrame:
    """tp and fp at score >= i / steps for i from 0 to steps, per model: each score goes to its highest grid index, then
    counts are summed from the top over the grid."""
    one = F.lit(1 / steps)
    k = F.floor(F.col("score") * steps)
    k = F.when((k + 1) * one <= F.col("score"), k + 1).when(k * one > F.col("score"), k - 1).otherwise(k)
    at = scored.withColumn("i", F.least(k, F.lit(steps)).cast("int"))
    per = at.groupBy("model", "i").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    grid = at.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    full = grid.join(per, ["model", "i"], "left").na.fill(0, ["pos", "neg"])
    w = Window.partitionBy("model").orderBy(F.desc("i"))
    totals = scored.groupBy("model").agg(F.count_if(F.col("y_true") == 1).alias("p"))
    c = full.select("model", "i", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp")).join(totals, "model")
    return c.select("model", "i", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"))


def accuracy_by_offset(scored: DataFrame, bins: int = 10, threshold: float = 0.5) -> DataFrame:
    """Accuracy in half-open bins of dist_frac over [0, 1); bins without samples have none, 1.0 and NaN are left out."""
    d = F.col("dist_frac")
    edge = [i * 0.1 if bins == 10 else i / bins for i in range(bins + 1)]
    which = F.lit(None).cast("int")
    for i in range(bins):
        which = F.when((d >= edge[i]) & (d < edge[i + 1]), i).otherwise(which)
    right = (F.col("score") >= threshold) == (F.col("y_true") == 1)
    per = scored.withColumn("bin", which).groupBy("model", "bin").agg(F.count("*").alias("n"), F.count_if(right).alias("right"))
    grid = scored.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(per, ["model", "bin"], "left").select("model", "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("right") / F.col("n")).alias("accuracy"))


def class_weights(df: DataFrame, label: str = "y_true", classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Per class: count, loss weight total / count over the mean of these, sampler weight 1 / count."""
    known = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} int")
    c = known.join(df.groupBy(label).agg(F.count("*").alias("count")), label, "left").na.fill(0, ["count"])
    w = Window.partitionBy()
    raw = F.sum("count").over(w) / F.greatest("count", F.lit(1))
    c = c.withColumn("raw", raw)
    return c.select(label, "count", (F.col("raw") / F.avg("raw").over(w)).alias("weight"), (1 / F.greatest("count", F.lit(1))).alias("sampler_weight"))


def weighted_loss(scored: DataFrame, weights: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Class-weighted cross entropy per model; weights has one row per class."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("score")))
    nll = -F.log(F.when(F.col("y_true") == 1, p).otherwise(1 - p))
    rows = scored.join(F.broadcast(weights.select("y_true", "weight")), "y_true")
    return rows.groupBy("model").agg((F.sum(F.col("weight") * nll) / F.sum("weight")).alias("loss"))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """Per run the epoch with the greatest metric, the earliest of equals."""
    return epochs.groupBy("run").agg(F.max(F.struct("metric", (-F.col("epoch")).alias("e"))).alias("b")).select("run", (-F.col("b.e")).alias("epoch"), "b.metric")


def evaluated(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scored with outcome, auc, f1, precision, recall and accuracy of its model.

    The few rows of models go to the samples: by a shuffle all samples of a model would be one task's.
    """
    return with_outcome(scored, threshold).join(F.broadcast(comparison(scored, threshold)), "model")


def comparison(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AUC, F1, precision, recall and accuracy per model."""
    return auc(scored).join(rates(confusion(scored, threshold)), "model").select("model", "auc", "f1", "precision", "recall", "accuracy")


def examples(scored: DataFrame, n: int, threshold: float = 0.5) -> DataFrame:
    """At most n samples per outcome and model, by name."""
    return top_per_group(with_outcome(scored, threshold), ["model", "outcome"], ["sample_id"], n)
