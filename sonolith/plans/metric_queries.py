"""Queries on scored samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .views import query

_CONF = """c AS (SELECT model, count(*) FILTER (WHERE score >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (WHERE score < 0.5 AND y_true = 0) AS tn,
  count(*) FILTER (WHERE score >= 0.5 AND y_true = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND y_true = 1) AS fn FROM scored GROUP BY model)"""
_RATES = """r AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""
_CURVE = """g AS (SELECT model, score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM scored GROUP BY ALL),
k AS (SELECT *, (sum(pos) OVER o)::BIGINT AS tp, (sum(neg) OVER o)::BIGINT AS fp, (sum(pos) OVER m)::BIGINT AS p, (sum(neg) OVER m)::BIGINT AS n FROM g WINDOW o AS (PARTITION BY model ORDER BY score DESC), m AS (PARTITION BY model))"""
_AUC = "a AS (SELECT model, sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)) AS auc FROM k GROUP BY model)"


@query("agg_10_confusion", "scored", f"WITH {_CONF} SELECT * FROM c")
def _(t):
    return M.confusion(t.scored)


@query("agg_11_rates", "scored", f"WITH {_CONF}, {_RATES} SELECT model, accuracy, precision, recall, f1 FROM f")
def _(t):
    return M.rates(M.confusion(t.scored)).select("model", "accuracy", "precision", "recall", "f1")


@query("agg_12_auc", "scored", f"WITH {_CURVE}, {_AUC} SELECT * FROM a")
def _(t):
    return M.auc(t.scored)


@query("agg_13_roc_points", "scored", f"WITH {_CURVE} SELECT model, score, fp / n AS fpr, tp / p AS tpr FROM k")
def _(t):
    return M.roc_points(t.scored)


@query("agg_14_pr_points", "scored", f"WITH {_CURVE} SELECT model, score, tp / (tp + fp) AS precision, tp / p AS recall FROM k")
def _(t):
    return M.pr_points(t.scored)


@query("win_8_cumulative_counts", "scored", f"WITH {_CURVE} SELECT model, score, tp, fp FROM k")
def _(t):
    return M.curve(t.scored).select("model", "score", "tp", "fp")


_GRID = """s AS (SELECT model, score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM scored GROUP BY ALL),
h AS (SELECT model, i::INT AS i, coalesce(sum(pos) FILTER (WHERE score >= i * 0.01::DOUBLE), 0)::BIGINT AS tp, coalesce(sum(neg) FILTER (WHERE score >= i * 0.01::DOUBLE), 0)::BIGINT AS fp,
  sum(pos)::BIGINT AS p FROM s, (SELECT unnest(range(101)) AS i) GROUP BY model, i)"""


@query("join_9_score_grid", "scored", f"WITH {_GRID} SELECT model, i, tp, fp, p - tp AS fn FROM h")
def _(t):
    return M.threshold_counts(t.scored)


@query("agg_15_threshold_rates", "scored", f"WITH {_GRID} SELECT model, i, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS recall FROM h")
def _(t):
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return M.threshold_counts(t.scored).select("model", "i", M.ratio(tp, tp + fp).alias("precision"), M.ratio(tp, tp + fn).alias("recall"))


@query("agg_16_accuracy_by_offset", "scored", """SELECT m.model, b.i::INT AS bin, count(s.model) AS n, CASE WHEN count(s.model) > 0 THEN count(*) FILTER (WHERE (s.score >= 0.5) = (s.y_true = 1)) / count(s.model) END AS accuracy
FROM (SELECT DISTINCT model FROM scored) m CROSS JOIN (SELECT unnest(range(10)) AS i) b
LEFT JOIN scored s ON s.model = m.model AND s.dist_frac >= b.i * 0.1::DOUBLE AND s.dist_frac < (b.i + 1) * 0.1::DOUBLE GROUP BY ALL""")
def _(t):
    return M.accuracy_by_offset(t.scored)


_WEIGHTS = """n AS (SELECT y AS y_true, count(s.y_true) AS count FROM (SELECT unnest([0, 1]) AS y) LEFT JOIN scored s ON s.y_true = y GROUP BY y),
w AS (SELECT y_true, count, raw / avg(raw) OVER () AS weight, 1 / greatest(count, 1) AS sampler_weight FROM (SELECT *, sum(count) OVER () / greatest(count, 1) AS raw FROM n))"""


@query("agg_21_class_weights", "scored", f"WITH {_WEIGHTS} SELECT y_true, count, round(weight, 9) AS weight, sampler_weight FROM w")
def _(t):
    return M.class_weights(t.scored).withColumn("weight", F.round("weight", 9))


@query("agg_22_weighted_loss", "scored", f"""WITH {_WEIGHTS} SELECT model, round(sum(weight * -ln(CASE WHEN y_true = 1 THEN p ELSE 1 - p END)) / sum(weight), 6) AS loss
FROM (SELECT model, y_true, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score)) AS p FROM scored) JOIN w USING (y_true) GROUP BY model""")
def _(t):
    return M.weighted_loss(t.scored, M.class_weights(t.scored)).withColumn("loss", F.round("loss", 6))


@query("agg_23_best_epoch", "", """SELECT run, epoch, metric FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS n
FROM (SELECT o_orderpriority AS run, month(o_orderdate)::INT AS epoch, count(*) // 10 AS metric FROM orders GROUP BY ALL)) WHERE n = 1""")
def _(t):
    e = t["orders"].groupBy(F.col("o_orderpriority").alias("run"), F.month("o_orderdate").alias("epoch")).agg(F.expr("count(*) div 10").alias("metric"))
    return M.best_epoch(e)


@query("agg_30_comparison", "scored", f"""WITH {_CONF}, {_RATES}, {_CURVE}, {_AUC} SELECT model, round(auc, 4) AS auc, round(f1, 4) AS f1, round(precision, 4) AS precision, round(recall, 4) AS recall, round(accuracy, 4) AS accuracy
FROM a JOIN f USING (model)""")
def _(t):
    c = M.comparison(t.scored)
    return c.select("model", *[F.round(x, 4).alias(x) for x in c.columns[1:]])


@query("ml_4_evaluate_models", "scored", f"""WITH {_CONF}, {_RATES}, {_CURVE}, {_AUC} SELECT model, sample_id, CASE WHEN score >= 0.5 THEN CASE WHEN y_true = 1 THEN 'tp' ELSE 'fp' END ELSE
CASE WHEN y_true = 1 THEN 'fn' ELSE 'tn' END END AS outcome, auc, f1 FROM scored JOIN a USING (model) JOIN f USING (model)""")
def _(t):
    return M.evaluated(t.scored).select("model", "sample_id", "outcome", "auc", "f1")


@query("win_5_examples_per_outcome", "scored", """SELECT model, sample_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY model, outcome ORDER BY sample_id) AS n
  FROM (SELECT *, CASE WHEN score >= 0.5 THEN CASE WHEN y_true = 1 THEN 'tp' ELSE 'fp' END ELSE CASE WHEN y_true = 1 THEN 'fn' ELSE 'tn' END END AS outcome FROM scored)) WHERE n <= 50""")
def _(t):
    return M.examples(t.scored, 50).select("model", "sample_id", "outcome")


@query("arr_18_positive_probability", "scored", "SELECT model, sample_id, round(1 / (1 + exp(score - dist_frac)), 9) AS probability FROM scored")
def _(t):
    from ..functions.scalars import positive_probability

    return t.scored.select("model", "sample_id", F.round(positive_probability(F.col("score"), F.col("dist_frac")), 9).alias("probability"))
