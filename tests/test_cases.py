"""Literal cases and contracts."""

import math
import wave

import pytest
from pyspark.sql import functions as F

from sonolith.functions import arrays as A
from sonolith.functions import scalars as S
from sonolith.operators import filters, intervals, review, splits, tiling
from sonolith.operators.ranking import global_rank
from sonolith.plans.views import Tables
from sonolith.sources import sinks
from sonolith.sources.records import Record
from sonolith.sources.catalogues import load_annotations, load_clips


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("total", "size", "starts"),
    [(300, 100, [0, 100, 200]), (300, 96, [0, 68, 136, 204]), (50, 100, [0]), (100, 100, [0]), (96, 96, [0])],
)
def test_even_starts(spark, total, size, starts):
    assert one(spark, tiling.even_starts(F.lit(total), F.lit(size))) == starts


def test_even_starts_cover_a_clip(spark):
    starts = one(spark, tiling.even_starts(F.lit(2996), F.lit(96)))
    assert len(starts) == 32 and starts[-1] + 96 == 2996
    assert all(b - a <= 96 for a, b in zip(starts, starts[1:], strict=False))


def test_segments_stay_under_their_limit(spark):
    assert len(one(spark, tiling.segment_starts(F.lit(1e6), F.lit(40.0), F.lit(39.0)))) == 101


@pytest.mark.parametrize(("before", "after", "n"), [(True, True, 304), (False, True, 302), (True, False, 302)])
def test_stitching(spark, before, after, n):
    rows = [("d", 0, [0.0] * 300, 1), ("d", 1, [1.0] * 300, 1), ("d", 2, [2.0] * 300, 1)]
    rows = [r for r in rows if (before or r[1] > 0) and (after or r[1] < 2)]
    df = spark.createDataFrame(rows, "device_code string, t int, samples array<double>, fs int")
    got = intervals.stitched(df, 2).filter("t = 1").first()["stitched"]
    assert len(got) == n
    assert got[:2] == ([0.0, 0.0] if before else [1.0, 1.0]) and got[-2:] == ([2.0, 2.0] if after else [1.0, 1.0])


def test_stitching_needs_equal_rates(spark):
    df = spark.createDataFrame([("d", 0, [0.0] * 4, 1), ("d", 1, [1.0] * 4, 2)], "device_code string, t int, samples array<double>, fs int")
    assert [len(r["stitched"]) for r in intervals.stitched(df, 2).collect()] == [4, 4]


def test_window_samples_pad_missing_neighbours(spark):
    none = F.lit(None).cast("array<double>")
    main = F.array(*[F.lit(float(i)) for i in range(4)])
    assert one(spark, intervals.window_samples(none, main, none, F.lit(-2.0), F.lit(6.0), F.lit(1))) == [0, 0, 0, 1, 2, 3, 0, 0]
    far = intervals.window_samples(none, main, none, F.lit(1.0), F.lit(3.0), F.lit(1))
    assert one(spark, far) == [1, 2]


def test_window_samples_cut_each_part_towards_zero(spark):
    none = F.lit(None).cast("array<double>")
    main = F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4)])
    cut = lambda p, f, a, b: one(spark, intervals.window_samples(p, main, f, F.lit(a), F.lit(b), F.lit(1)))
    assert cut(none, none, -1.5, 2.5) == [0, 1, 2, 0]
    assert cut(main, none, -1.5, 2.5) == [3, 4, 1, 2]
    assert cut(none, main, 2.5, 5.5) == [3, 4, 1] and cut(none, none, 2.5, 5.5) == [3, 4, 0]


def test_an_upsert_keeps_what_it_does_not_touch(spark):
    p = spark.createDataFrame([("a", "x", "ann", "t1"), ("b", "y", "bob", "t2")], "file_id string, expert_label string, expert_reviewer string, review_timestamp string")
    u = spark.createDataFrame([("a", "z", "cy", "t3"), ("a", "w", "di", "t4"), ("q", "w", "di", "t4")], "file_id string, label string, reviewer string, at string")
    out, unknown = review.upsert_labels(p, u)
    assert sorted(map(tuple, out.collect())) == [("a", "w", "di", "t4"), ("b", "y", "bob", "t2")] and unknown.count() == 1


def test_new_rounds_come_after_old_ones(spark):
    entry = "struct<verified_at string, verified_by string, label string, notes string, verification_round int>"
    items = spark.createDataFrame([("a", 1, [("t0", "ann", "x", "old", 1)]), ("b", 2, None), ("c", 3, None)], f"item_id string, n int, verifications array<{entry}>")
    new = spark.createDataFrame([("a", "t2", "bob", "y"), ("a", "t1", "cy", "z"), ("b", "t1", "cy", "z"), ("q", "t1", "cy", "z")], "item_id string, verified_at string, verified_by string, label string")
    out, unknown = review.append_verifications(items, new)
    rows = {r.item_id: r for r in out.collect()}
    assert out.columns == items.columns and unknown.count() == 1 and rows["c"].verifications is None
    assert [(v.verified_at, v.label, v.notes, v.verification_round) for v in rows["a"].verifications] == [("t0", "x", "old", 1), ("t1", "z", None, 2), ("t2", "y", None, 3)]
    assert [v.verification_round for v in rows["b"].verifications] == [1]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_clips_of_every_width_and_junk(spark, tmp_path, width):
    top = 1 << (8 * width - 1)
    values = [0, 1, -1, top - 1, -top, 77]
    with wave.open(str(tmp_path / "a.WAV"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(8)
        w.writeframes(b"".join((v + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) * 2 for v in values))
    (tmp_path / "b.wav").write_bytes((tmp_path / "a.WAV").read_bytes()[:20])
    (tmp_path / "c.txt").write_text("no recording")
    got = {r.clip_id: r for r in load_clips(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a.WAV", "b.wav"} and got["a.WAV"].samples == [v / top for v in values] and got["a.WAV"].error is None
    assert got["b.wav"].error and got["b.wav"].samples is None


def test_power_names_win_over_decibels(spark):
    df = spark.createDataFrame([(1, 2, 3)], "PdB int, sxx int, spec int")
    assert tuple(df.select(*filters.spectrum(df)).first()) == (2, "power")
    assert tuple(df.drop("sxx").select(*filters.spectrum(df.drop("sxx"))).first()) == (1, "db")
    with pytest.raises(ValueError):
        filters.spectrum(df.select(F.lit(1).alias("x")))


def test_a_document_can_be_written_from_itself(spark, tmp_path):
    folder = f"file://{tmp_path}/doc"
    sinks.write_items(spark.range(5), folder, "1", "then", "then", key="id")
    sinks.write_items(sinks.read_items(spark, folder).filter("id > 1"), folder, "1", "now", "now", key="id")
    header = Record(spark, folder).header().first()
    assert sinks.read_items(spark, folder).count() == 3 and (header.created_at, header.updated_at) == ("then", "now")


def test_fingerprints_tell_columns_apart(spark):
    mark = lambda *x: one(spark, S.fingerprint(*[F.lit(v).cast("string") for v in x]))
    assert len({mark("a|b", "c"), mark("a", "b|c"), mark("a", None), mark(None, "a"), mark("a", "")}) == 5


def test_curves_take_crowded_scores(spark):
    from sonolith.operators.metrics import curve

    df = spark.range(4000).select(F.lit("m").alias("model"), (F.col("id") % 7 == 0).cast("int").alias("y_true"), F.when(F.col("id") < 3900, F.col("id") * 1e-9).otherwise(F.col("id") / 4000.0).alias("score"))
    rows = sorted(curve(df).collect(), key=lambda r: -r.score)
    seen = [sum(r.pos for r in rows[: i + 1]) for i in range(len(rows))]
    assert [r.tp for r in rows] == seen and rows[-1].fp == rows[-1].n


def test_baseline_finds_a_linear_class(spark):
    from sonolith.operators.learning import fit_baseline, predict

    rows = [(i, [(i * 37 % 101) / 101, (i * 53 % 97) / 97, (i * 11 % 89) / 89]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x array<double>").withColumn("y", (F.col("x")[0] + F.col("x")[1] > 1.2).cast("int"))
    model, tried = fit_baseline(df.filter("id % 2 = 0"), df.filter("id % 4 = 1"), "x", "y")
    found = [r.metric for r in tried.collect()]
    assert len(found) == 3 and max(found) > 0.98
    right = predict(model, df.filter("id % 4 = 3"), "x", "y").filter("(score >= 0.5) = (y_true = 1)").count()
    assert right > 0.9 * 150


def test_shared_folder_is_qualified(spark):
    from sonolith.session import discard, materialize, shared_folder

    assert shared_folder(spark).startswith("file:///")
    df = materialize(spark.range(3), "x")
    assert df.count() == 3
    discard(df)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df._scratch)


def test_band_keeps_both_ends(spark):
    f = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i.cast("double"))
    p = F.transform(f, lambda x: F.array(x, x))
    assert len(one(spark, filters.band_rows(f, p, 10.0, 50.0))) == 41
    assert len(one(spark, filters.band_rows(f, p, 900.0, 950.0))) == 101


def test_chunks_are_square(spark):
    p = F.array_repeat(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: i.cast("double")), 100)
    for start in (0, 104, 190):
        c = one(spark, A.chunk(p, F.lit(start), 96, zero=False))
        assert len(c) == 96 and {len(r) for r in c} == {96}
        assert c[0][-1] == min(199, start + 95)


@pytest.mark.parametrize("name", ["ICLISTENHF1353_20180705T050128.948Z_104.8s_105.3s_40Hz_custom.mat", "ICLISTENHF1353_20180705T050128.948Z,104.8s,105.3s,_40Hz_custom.mat"])
def test_spectrogram_names(spark, name):
    got = spark.range(1).select(*S.spectrogram_name(F.lit(name))).first()
    assert tuple(got) == ("ICLISTENHF1353_20180705T050128.948Z", 104.8, 105.3)


def test_power_of_silence(spark):
    assert one(spark, A.matrix_db(F.array(F.array(F.lit(0.0), F.lit(0.0))))) == [[-100.0, -100.0]]
    assert one(spark, A.matrix_db(F.array(F.array(F.lit(1.0), F.lit(0.1)))))[0][1] == pytest.approx(-10)


def test_clock_text(spark):
    for text, want in (("1:30.5", 90.5), ("1:00:01", 3601.0), ("7.25", 7.25), ("x:y", None), ("", None)):
        assert one(spark, S.clock_seconds(F.lit(text))) == want


def test_global_rank_equals_a_plain_sort(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    rows = global_rank(df, ["g"], "h").collect()
    for g in (0, 1):
        ordered = sorted((r["h"], r["rank"]) for r in rows if r["g"] == g)
        assert [r for _, r in ordered] == list(range(1, 2501))


def test_split_contracts(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert splits.leaked_sources(splits.source_split(t.entries)).count() == 0
    assert splits.gap_violations(splits.time_split(t.entries, 60.0), 60.0).count() == 0


def test_negative_windows_contract(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    w = intervals.negative_windows(t.clips, t.calls).cache()
    assert intervals.uncovered(w, t.calls, 2.0 - 1e-9).count() == w.count()
    assert intervals.overlapping_pairs(w, "clip_id", "n", "start", "end", 8.0 + 1e-9).count() == 0
    assert w.filter("start < 0 OR end > 3600").count() == 0


def test_annotations_skip_bad_files(spark, tmp_path):
    (tmp_path / "a_20Hz.csv").write_text(" Date (UTC),Begin Time (s) x,END time (s),Clip ID\n2024-01-01 00:00:00,1:30,95,D1_x.wav\n")
    (tmp_path / "b.csv").write_text("nothing\n1\n")
    got = load_annotations(spark, [f"file://{tmp_path}/{n}" for n in ("a_20Hz.csv", "b.csv", "missing.csv")]).collect()
    assert [(r["device_code"], r["begin_s"], r["end_s"], r["call_type"]) for r in got] == [("D1", 90.0, 95.0, "20Hz")]
    with pytest.raises(ValueError, match="no usable"):
        load_annotations(spark, [f"file://{tmp_path}/b.csv"])


def test_single_class_auc(spark):
    from sonolith.operators.metrics import auc

    df = spark.createDataFrame([("m", 1, 0.5), ("m", 1, 0.7)], "model string, y_true int, score double")
    assert auc(df).first()["auc"] is None and auc(df, 0.5).first()["auc"] == 0.5
    tied = spark.createDataFrame([("m", 1, 0.5), ("m", 0, 0.5)], "model string, y_true int, score double")
    assert math.isclose(auc(tied).first()["auc"], 0.5)
