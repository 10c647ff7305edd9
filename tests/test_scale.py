"""What must not grow faster than the input: documents, tasks, pairs, shuffled rows; and results on tables of odd sizes."""

from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from sonolith import plans
from sonolith.functions import arrays as A
from sonolith.operators import metrics
from sonolith.operators.failures import safe_batches, safe_map
from sonolith.operators.intervals import assets_per_call, first_within
from sonolith.operators.tiling import covered
from sonolith.plans import profile_queries
from sonolith.sources.catalogues import load_clips, window_catalogue
from sonolith.sources.recordings import load_blocks

from .test_recordings import put


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_of_a_catalogue_are_bounded_and_parsed_once(spark):
    p = spark.range(90_000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_id"), F.lit("2024-01-02T00:00:00").alias("audio_timestamp"))
    folder = profile_queries._catalogue(SimpleNamespace(spark=spark, predictions=p), F.lit("d"), F.lit(True))
    documents = spark.read.json(folder.replace("/*", "/new")).select(F.size("chunks").alias("n"))
    assert documents.agg(F.sum("n"), F.max("n") < 25_000).first()[:] == (90_000, True)
    windows = window_catalogue(spark, folder, lines=True)
    assert plan(windows).count("FileScan text") == 1 and plan(windows).count("try_parse_json") <= 1
    assert windows.agg(F.count("*"), F.count_distinct("file_id"), F.max("spectra_from")).first()[:] == (90_000, 90_000, "default")


def test_short_recordings_share_tasks(spark, tmp_path):
    """A task per file or two would be most of the work."""
    for i in range(600):
        put(tmp_path / f"{i}.wav", 64, [i / 1000, 0.5, -0.5], width=2)
    for split in (1 << 23, 64 << 20):
        blocks = load_blocks(spark, f"file://{tmp_path}", block=2, halo=1, split_bytes=split)
        assert 4 <= blocks.rdd.getNumPartitions() <= 12
        assert blocks.agg(F.count("*"), F.count_distinct("clip_id"), F.sum(F.size("samples"))).first()[:] == (1200, 600, 2400)


def test_clips_share_tasks_and_each_stage_is_run_once(spark, tmp_path):
    for i in range(1200):
        put(tmp_path / f"0_{i}.wav", 64, [0.5, -0.5], width=2)
    clips = load_clips(spark, f"file://{tmp_path}")
    assert clips.rdd.getNumPartitions() <= 16 and clips.agg(F.count_distinct("clip_id"), F.sum("n_samples")).first()[:] == (1200, 2400)
    report = plans.QUERIES["agg_20_stage_failures"](spark, "/root/testdata/sf0.001")
    assert plan(report).count("MapInArrow") <= 1 and "Join" not in plan(report)


def test_a_stage_batches_by_bytes_and_a_bad_row_costs_no_other(spark):
    seen = spark.sparkContext.accumulator(0)

    def one(row):
        seen.add(1)
        if row["id"] % 3 == 0:
            raise ValueError("third")
        return {"n": len(row["x"])}

    df = spark.range(0, 300, 1, 1).withColumn("x", F.array_repeat(F.lit(1.0), 100))
    got = safe_map(df, one, "n int", batch_bytes=10_000).collect()
    assert [(r.n, r.error) for r in got] == [(None, "third") if i % 3 == 0 else (100, None) for i in range(300)]
    assert seen.value == 300
    sizes = safe_batches(df, lambda rows: [{"n": len(rows)} for _ in rows], "n int", batch_bytes=10_000).agg(F.max("n")).first()[0]
    assert 5 <= sizes <= 12


def test_centre_crop_of_spectrograms_that_lack_frames(spark):
    for held in ([*range(6)], [*range(20)], [*range(50)], [3, 9, 9, 40, 41, 44]):
        p = [[100.0 * f + x for x in held] for f in range(64)]
        s = spark.createDataFrame([(1, p, [float(x) for x in held])], "spec_id int, p array<array<double>>, t array<double>")
        rows = s.select(A.centre_crop(F.col("p"), F.col("t"), F.lit(50), 32).alias("m")).first().m
        got = sorted((f, c.t_idx, c.value) for f, r in enumerate(rows) for c in r)
        assert got == sorted((f - 16, x - 9, 100.0 * f + x) for f in range(16, 48) for x in held if 9 <= x <= 40)


def test_matrices_are_made_once(spark):
    """A filter by the size of what is exploded would make the matrices again for every element."""
    for name in ("arr_7_orientation", "arr_10_fit_rows", "arr_13_centre_crop", "arr_15_square_chunks"):
        assert "Filter (size(" not in plan(plans.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_first_within_equals_all_pairs_sorted(spark):
    r = np.random.default_rng(5)
    at = lambda k: datetime(2024, 1, 1) + timedelta(seconds=int(k))
    left = [(i, int(r.integers(3)), at(r.integers(3000))) for i in range(200)] + [(900, None, at(5)), (901, 1, None)]
    right = [(f"a{r.integers(20)}", int(r.integers(3)), at(r.integers(3000))) for _ in range(150)] + [("b", 1, None), ("c", None, at(6))]
    calls = spark.createDataFrame(left, "call int, k int, ts timestamp_ntz")
    assets = spark.createDataFrame(right, "asset string, k int, at timestamp_ntz")
    for before, after, n in ((100, 100, 2), (0, 50, 1), (300, 0, 3), (0, 0, 2)):
        got = sorted((x.call, x.at, x.asset) for x in first_within(calls, assets, "k", "ts", "at", before, after, ["asset"], n).collect())
        want = []
        for call, k, ts in left:
            near = [(a, name) for name, key, a in right if None not in (k, ts, key, a) and k == key and -before <= (a - ts).total_seconds() <= after]
            want += [(call, *x) for x in sorted(near)[:n]]
        assert got == sorted(want)


def test_assets_of_crowded_calls_make_no_pairs(spark):
    """20,000 calls and 20,000 assets of one minute: 400 million pairs."""
    moment = F.expr("timestampadd(MILLISECOND, cast(id % 60000 as int), timestamp_ntz'2024-01-01 00:00:00')")
    calls = spark.range(20_000).select(F.col("id").alias("call_id"), F.lit("d").alias("device_code"), moment.alias("call_ts"))
    assets = spark.range(20_000).select(F.concat(F.lit("Spect"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("asset"), F.lit("d").alias("device_code"), moment.alias("asset_ts"))
    per = assets_per_call(calls, assets)
    assert "Join" not in plan(per)
    assert sorted(map(tuple, per.groupBy("asset", "place").count().collect())) == [("Spect00000", 1, 20_000), ("Spect00001", 2, 20_000)]


def test_coverage_lists_no_bins(spark):
    cases = [([0, 4, 9], 5, 14), ([9, 0], 5, 20), ([0], 5, 3), ([], 5, 3), ([2, 2, 3], 4, 10)]
    for starts, size, total in cases:
        row = spark.range(1).select(covered(F.lit(starts).cast("array<int>"), size, F.lit(total)).alias("n")).first()
        assert row.n == len({b for s in starts for b in range(s, min(total, s + size))})
    text = plan(plans.QUERIES["set_7_coverage"](spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in text and "Generate" not in text


def test_samples_are_not_shuffled_by_model(spark):
    scored = spark.range(1000).select((F.col("id") % 2).cast("string").alias("model"), F.col("id").cast("string").alias("sample_id"), (F.col("id") % 3 == 0).cast("int").alias("y_true"), (F.col("id") % 11 / 11).alias("score"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = plan(metrics.evaluated(scored)).split("+- ")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any(x.startswith("BroadcastHashJoin") for x in joins[:4])
