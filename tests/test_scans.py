"""Scans in segments, draws, splits, training by epochs and times, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import arrays as A
from sonolith.functions import scalars as S
from sonolith.operators import intervals, learning, review, splits
from sonolith.operators.profile import consistency


def one_key(spark, n=600, seed=1):
    r = random.Random(seed)
    calls = [("k", b, b + r.expovariate(1 / 20)) for b in (r.uniform(0, 20_000) for _ in range(n))]
    calls += [("k", 100.0, 9000.0), ("k", 9000.0, 9000.0), ("k2", 5.0, 6.0)]
    return calls, spark.createDataFrame(calls, "clip_id string, begin_s double, end_s double")


def plain_islands(calls, margin, length):
    spans = sorted((max(0.0, b - margin), min(length, e + margin)) for b, e in calls)
    out = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("segment", [1.0, 137.0, 3600.0, 1e9])
def test_one_key_for_all_rows_is_scanned_in_segments(spark, segment):
    calls, df = one_key(spark)
    want = plain_islands([c[1:] for c in calls if c[0] == "k"], 2.0, 20_000.0)
    got = intervals.merged_intervals(df, 2.0, 20_000.0, segment_s=segment).filter("clip_id = 'k'").orderBy("island").collect()
    assert [(r.island, r.start, r.end) for r in got] == [(i + 1, *w) for i, w in enumerate(want)]
    clips = spark.createDataFrame([("k", 20_000.0), ("k2", 10.0), ("k3", 7.0)], "clip_id string, length_s double")
    gaps, at = [], 0.0
    for s, e in [*want, (20_000.0, 20_000.0)]:
        if s > at:
            gaps.append((at, s))
        at = max(at, e)
    found = intervals.free_gaps(clips, df, 2.0, segment_s=segment).orderBy("clip_id", "gap").collect()
    assert [(r.gap, r.start, r.end) for r in found if r.clip_id == "k"] == [(i + 1, *g) for i, g in enumerate(gaps)]
    assert [(r.clip_id, r.start, r.end) for r in found if r.clip_id != "k"] == [("k2", 0.0, 3.0), ("k2", 8.0, 10.0), ("k3", 0.0, 7.0)]


@pytest.mark.parametrize("segment", [7.0, 3600.0])
def test_clusters_in_segments(spark, segment):
    r = random.Random(3)
    rows = [(i, "s", *((b, b + 2.0) if i % 9 else (None, 1.0))) for i, b in enumerate(r.uniform(0, 4000) for _ in range(300))]
    df = spark.createDataFrame(rows, "spec_id int, src_id string, begin_s double, end_s double")
    got = {x.spec_id: x.cluster for x in intervals.gap_clusters(df, 15.0, segment).collect()}
    centres = sorted((b + e) / 2 for _, _, b, e in rows if b is not None)
    number, at, n = {}, None, 0
    for c in centres:
        n += at is None or c - at >= 15.0
        number[c], at = n, c
    assert all(got[i] == number[(b + e) / 2] for i, _, b, e in rows if b is not None)
    none = [got[i] for i, _, b, _ in rows if b is None]
    assert len(set(none)) == len(none) and max(none) < 0


@pytest.mark.parametrize("segment", [11.0, 3600.0])
def test_uncovered_equals_every_pair(spark, segment):
    r = random.Random(4)
    _, calls = one_key(spark, 60)
    windows = [(r.choice(["k", "k2", "k3"]), s, s + r.choice([0.0, 5.0, 40.0])) for s in (r.uniform(0, 20_000) for _ in range(300))]
    windows += [("k2", 0.0, 4.0), ("k2", 7.0, 9.0), ("k2", 7.0, 9.0), (None, 0.0, 1.0), ("k", None, 3.0), ("k", 3.0, 4.0)]
    df = spark.createDataFrame(windows, "clip_id string, start double, end double").withColumn("n", F.lit(1))
    own = [tuple(c) for c in calls.collect()]
    want = [w for w in windows if None in w or not any(c[0] == w[0] and c[1] - 1 < w[2] and c[2] + 1 > w[1] for c in own)]
    got = intervals.uncovered(df, calls, 1.0, segment)
    assert got.columns == df.columns and sorted(map(str, (tuple(x)[:3] for x in got.collect()))) == sorted(map(str, want))


def test_negative_starts_lie_anywhere(spark):
    clips = spark.createDataFrame([(f"c{i}", 3600.0) for i in range(60)], "clip_id string, length_s double")
    calls = spark.createDataFrame([(f"c{i}", 60.0 * j, 60.0 * j + 3) for i in range(60) for j in range(0, 50, 10)], "clip_id string, begin_s double, end_s double")
    rows = intervals.negative_windows(clips, calls, per_call=2).collect()
    by = {}
    for w in rows:
        by.setdefault(w.clip_id, []).append(w.start)
    assert len(rows) > 0.95 * 600 and all(len(v) <= 10 for v in by.values())
    assert all(abs(a - b) >= 32 - 1e-9 for v in by.values() for i, a in enumerate(v) for b in v[:i])
    assert len({round(w.start % 32, 3) for w in rows}) > 0.9 * len(rows)
    late = sum(w.start > 3000 for w in rows) / len(rows)  # gaps are drawn by length; the last one is longer
    assert 0.1 < late < 0.25


def test_jitter_is_truncated_not_clamped(spark):
    n, length, crop = 20_000, 400, 96
    starts = [r.s for r in spark.range(n).select(A.jittered_start(F.lit(length), crop, F.col("id"), F.lit(True), bias=1.0).alias("s")).collect()]
    count = np.bincount(starts, minlength=401)
    low, high = min(starts), max(starts)
    assert (low, high) == (105, 200) and count[low] < 2 * count[low + 2] and count[high] < 2 * count[high - 2]
    inside = math.erf(1 / math.sqrt(2))  # a normal of deviation 0.5 around 0.5, within [0, 1]
    want = math.erf(0.5 / math.sqrt(2)) / inside
    assert abs(np.mean([abs(152.5 - s) < 24 for s in starts]) - want) < 0.02
    assert spark.range(1).select(A.jittered_start(F.lit(96), 96, F.col("id"), F.lit(True)).alias("s")).first()["s"] == 0
    flat = np.bincount([r.s for r in spark.range(n).select(A.jittered_start(F.lit(105), crop, F.col("id"), F.lit(False)).alias("s")).collect()])
    assert len(flat) == 10 and flat.min() > 0.8 * n / 10


@pytest.mark.parametrize("sources", [1, 2, 3, 40])
def test_time_splits_keep_their_ratios(spark, sources):
    at, source = F.col("id") / sources, F.concat(F.lit("s"), F.col("id") % sources)
    df = spark.range(4000).select(F.col("id").alias("spec_id"), source.alias("src_id"), at.alias("begin_s"), at.alias("end_s"), (F.col("id") % 2).cast("int").alias("label"))
    got = splits.time_split(df, 60.0)
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    largest = 4000 / sources if sources != 3 else 4000 * 0.7 - 4000 // 3  # of three clusters each split gets one
    assert sum(n.values()) == 4000 and len(n) == min(3, sources)
    assert all(abs(n.get(s, 0) - 4000 * q) <= largest for s, q in (("train", 0.7), ("val", 0.15), ("test", 0.15)))
    assert splits.gap_violations(got, 60.0).count() == 0 and splits.gap_violations(got, 0.0).count() == 0


def test_classes_are_split_by_themselves(spark):
    df = spark.range(6000).select(F.col("id").alias("spec_id"), F.lit("s").alias("src_id"), (F.col("id") * 100.0).alias("begin_s"), (F.col("id") * 100.0).alias("end_s"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    rows = {r.split: r for r in splits.split_counts(splits.time_split(df, 60.0)).collect()}
    assert abs(rows["train"].pos - 420) <= 1 and abs(rows["val"].pos - 90) <= 1 and abs(rows["test"].neg - 810) <= 1


def test_repeated_ids(spark):
    scores = spark.createDataFrame([("a_win1",), ("b",)], "file_id string")
    catalogue = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 5), ("b", "z", 4)], "file_id string, path string, at int")
    got = {r.file_id: r.path for r in review.with_metadata(scores, catalogue, order=["at"]).select("file_id", "meta.path").collect()}
    assert got == {"a_win1": "y", "b": None}
    p = spark.createDataFrame([("a", 1, None, None, None), ("a", 2, None, None, None)], "file_id string, at int, expert_label string, expert_reviewer string, review_timestamp string")
    u = spark.createDataFrame([("a", "l", "r", "t")], "file_id string, label string, reviewer string, at string")
    assert sorted((r.at, r.expert_label) for r in review.upsert_labels(p, u, ["at"])[0].collect()) == [(1, "l"), (2, None)]


def test_epochs_equal_numpy(spark, tmp_path):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.5] + 0.3 * r.normal(size=400) > 0.4).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y int").repartition(5)
    train, rest = df.filter("id < 300"), df.filter("id >= 300")
    model, history = learning.fit_epochs(train, rest, "x", "y", "id", epochs=4, steps=3, rate=0.8)
    weights, all_weights = np.zeros(4), []
    for epoch in range(4):
        draws = sorted((d.draw, d.spec_id) for d in splits.balanced_draws(train.select(F.col("id").alias("spec_id"), F.col("y").alias("label")), None, f"epoch{epoch}").collect())
        for step in range(3):
            at = np.array([i for d, i in draws if d % 3 == step])
            z = np.hstack([x[at], np.ones((len(at), 1))])
            weights = weights - 0.8 * (1 / (1 + np.exp(-z @ weights)) - y[at]) @ z / len(at)
        all_weights.append(weights)
    rows = sorted(history.collect(), key=lambda h: h.epoch)
    p = [1 / (1 + np.exp(-(x[300:] @ w[:3] + w[3]))) for w in all_weights]
    aucs = [np.mean([(a > b) + 0.5 * (a == b) for a in q[y[300:] == 1] for b in q[y[300:] == 0]]) for q in p]
    assert np.allclose([h.metric for h in rows], aucs) and model.epoch == int(np.argmax(aucs)) and np.allclose(model.weights, all_weights[model.epoch])
    folder = f"file://{tmp_path}/model"
    learning.save_linear(spark, model, folder)
    assert learning.load_linear(spark, folder) == model
    bad = spark.createDataFrame([("[1.0]", 0, 0.5, "sha256-0")], "weights string, epoch int, metric double, fingerprint string")
    bad.write.json(f"file://{tmp_path}/bad")
    with pytest.raises(ValueError, match="fingerprint"):
        learning.load_linear(spark, f"file://{tmp_path}/bad")


def test_times_do_not_depend_on_the_session(spark):
    df = spark.createDataFrame([("D_20240310T023000.000Z.wav", "2024-03-10T02:30:00Z"), ("D_20240230T000000Z.wav", "x")], "name string, iso string")
    cols = [S.name_timestamp(F.col("name")).cast("string").alias("a"), S.positional_timestamp(F.col("name")).cast("string").alias("b"), S.iso_timestamp(F.col("iso")).cast("string").alias("c")]
    want = [("2024-03-10 02:30:00",) * 3, (None,) * 3]
    try:
        for zone in ("UTC", "America/Los_Angeles"):  # where that hour isn't
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [tuple(r) for r in df.select(*cols).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_consistency_of_a_short_catalogue(spark):
    rows = [("s", 200, 96, 96, 96, 0, 0.0, 10.5), ("s", 200, 96, 96, 96, 52, 5.2, 15.7), ("s", 200, 96, 96, 95, 104, None, None), ("t", 50, 96, 96, 96, 0, None, None)]
    df = spark.createDataFrame(rows, "source string, total int, freq int, rows int, cols int, start int, t_start double, t_end double")
    got = {r.source: r for r in consistency(df, 96, 1.0, 0.9).collect()}
    assert (got["s"].windows, got["s"].shape_faults, got["s"].timing_faults, got["s"].start_faults, got["t"].start_faults) == (3, 1, 0, 0, 0)
