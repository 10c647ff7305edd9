"""Recordings in blocks, band spectra and stages that carry errors."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.operators import intervals, spectra, stages
from sonolith.operators.failures import failure_report, safe_batches, safe_map
from sonolith.sources.catalogues import load_clips
from sonolith.sources.recordings import load_blocks


def put(path, rate, x, channels=1, width=2):
    top = (1 << (8 * width - 1)) - 1
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"".join((int(v * top) + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) * channels for v in x))


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    r = np.random.default_rng(1)
    put(tmp_path / "long.wav", 100, r.uniform(-1, 1, 5000), 2, 3)
    put(tmp_path / "empty.WAV", 50, [])
    (tmp_path / "junk.wav").write_bytes(b"junk" * 500)
    (tmp_path / "short.wav").write_bytes((tmp_path / "long.wav").read_bytes()[:20])
    folder = f"file://{tmp_path}"
    whole = {c.clip_id: c for c in load_clips(spark, folder).collect()}
    for split, block, halo in ((1000, 170, 30), (313, 1, 0), (1 << 20, 10_000, 5), (64, 5000, 0)):
        blocks = load_blocks(spark, folder, block, halo, split)
        assert block > 170 or blocks.rdd.getNumPartitions() > 20
        rows = sorted(blocks.collect(), key=lambda b: (b.clip_id, b.start or 0))
        long = [b for b in rows if b.clip_id == "long.wav"]
        assert [s for b in long for s in b.samples[:block]] == whole["long.wav"].samples
        assert [b.start for b in long] == list(range(0, 5000, block)) and all(b.n_samples == 5000 and b.fs == 100 for b in long)
        assert all(len(b.samples) == min(block + halo, 5000 - b.start) for b in long)
        assert [(b.clip_id, b.error is None, b.samples) for b in rows if b.clip_id != "long.wav"] == [("empty.WAV", True, []), ("junk.wav", False, None), ("short.wav", False, None)]
    heads = load_blocks(spark, folder, 10_000, columns=["clip_id", "n_samples"]).filter("n_samples IS NOT NULL")
    assert sorted(map(tuple, heads.collect())) == [("empty.WAV", 0), ("long.wav", 5000)]


def test_headers_of_other_shapes(spark, tmp_path):
    data = np.arange(-5, 5, dtype="<i2").tobytes()
    form = struct.pack("<HHIIHH", 1, 1, 10, 20, 2, 16)
    chunk = lambda name, body, size=None: name + struct.pack("<I", len(body) if size is None else size) + body + b"\0" * (len(body) % 2)
    (tmp_path / "rf64.wav").write_bytes(b"RF64" + b"\xff" * 4 + b"WAVE" + chunk(b"ds64", struct.pack("<QQQI", 0, len(data), 0, 0)) + chunk(b"odd ", b"abc") + chunk(b"fmt ", form) + chunk(b"data", data, 0xFFFFFFFF) + b"tail")
    (tmp_path / "open.wav").write_bytes(b"RIFF" + b"\0" * 4 + b"WAVE" + chunk(b"fmt ", form) + chunk(b"data", data, 0xFFFFFFFF))
    wide = struct.pack("<HHIIHHHHIH14s", 0xFFFE, 1, 10, 20, 2, 16, 22, 16, 4, 1, b"\0" * 14)
    (tmp_path / "wide.wav").write_bytes(b"RIFF" + b"\0" * 4 + b"WAVE" + chunk(b"fmt ", wide) + chunk(b"data", data))
    (tmp_path / "float.wav").write_bytes(b"RIFF" + b"\0" * 4 + b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 3, 1, 10, 40, 4, 32)) + chunk(b"data", data))
    got = {b.clip_id: b for b in load_blocks(spark, f"file://{tmp_path}", 100).collect()}
    want = (np.arange(-5, 5) / 32768).tolist()
    assert all(got[n].samples == want for n in ("rf64.wav", "open.wav", "wide.wav")) and "not PCM" in got["float.wav"].error


def reference(x, size, hop, low, high):
    n = 1 + (len(x) - size) // hop
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.array([np.abs(np.fft.rfft(x[i * hop : i * hop + size] * window)) ** 2 for i in range(n)])
    return 10 * np.log10(np.maximum(power / power.max(), 1e-10))[:, low:high].T


@pytest.mark.parametrize(("size", "hop", "block"), [(100, 10, 130), (100, 30, 77), (64, 64, 64), (10, 25, 40)])
def test_blocks_equal_the_whole_signal(spark, tmp_path, size, hop, block):
    put(tmp_path / "a.wav", 100, np.random.default_rng(2).uniform(-1, 1, 1003))
    folder = f"file://{tmp_path}"
    x = np.array(load_clips(spark, folder).first()["samples"])
    low, high = spectra.band_bins(size, 100, 10.0, 30.0)
    s = spectra.band_spectrum(load_blocks(spark, folder, block, size, 256), size, hop, block, band_hz=(10.0, 30.0))
    m = spectra.spectrum_matrix(s).first()
    assert m.first_bin == low and np.allclose(m.matrix, reference(x, size, hop, low, high), atol=1e-9)


def test_bands():
    assert spectra.band_bins(64_000, 64_000, 5, 100) == (5, 101) and spectra.band_bins(16, 64, 900, 950) == (0, 9)


def test_real_rates_need_little_memory(spark, tmp_path):
    """Ten seconds at 64 kHz with one-second frames: only the band leaves the tasks."""
    x = np.random.default_rng(3).integers(-(2**15), 2**15, 640_000, dtype="<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(64_000)
        w.writeframes(x.tobytes())
    blocks = load_blocks(spark, f"file://{tmp_path}", 128_000, 64_000)
    m = spectra.spectrum_matrix(spectra.band_spectrum(blocks, 64_000, 6400, 128_000, band_hz=(5, 100))).first()
    assert (len(m.matrix), len(m.matrix[0])) == (96, 91)
    assert np.allclose(np.array(m.matrix), reference(x / 32768, 64_000, 6400, 5, 101), atol=1e-9)


def test_signal_blocks_cover_every_frame(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(50)]), (2, [1.0] * 3)], "id int, samples array<double>")
    rows = spectra.signal_blocks(df, 8, 3, frames=4).orderBy("start").collect()
    assert [(r.id, r.start, len(r.samples)) for r in rows] == [(1, 0, 17), (1, 12, 17), (1, 24, 17), (1, 36, 14)]


def test_bad_rows_become_errors(spark):
    def halve(rows):
        return [{"half": 10 // r["x"], "word": "w"} for r in rows]

    df = spark.createDataFrame([(i, i % 4, "old" if i == 7 else None) for i in range(12)], "id int, x int, error string").repartition(2)
    got = {r.id: (r.half, r.error) for r in safe_batches(df, halve, "half int, word string", batch_rows=5).collect()}
    assert got[7] == (None, "old") and got[0] == (None, "integer division or modulo by zero") and got[2] == (5, None) and len(got) == 12
    typed = {r.id: r.error for r in safe_map(df.drop("error"), lambda r: {"half": "no" if r["id"] == 3 else 1}, "half int").collect()}
    assert typed[3] and typed[4] is None
    short = safe_batches(df.drop("error"), lambda rows: halve(rows)[1:] if len(rows) > 1 else [{"half": 1}], "half int").collect()
    assert all(r.half == 1 and r.error is None for r in short)


def test_slices_and_stitching_tell_their_faults(spark):
    rows = [(1, [0.0, 1.0, 2.0, 3.0], 1.0, 3.0), (2, None, 0.0, 1.0), (3, [float("nan"), 1.0], 0.0, 1.0), (4, [1.0], 0.0, 9.0), (5, [1.0], 1.0, 1.0), (6, [1.0, None], 0.0, 1.0), (7, [1.0], None, 1.0)]
    df = spark.createDataFrame(rows, "id int, samples array<double>, start_s double, end_s double").withColumn("fs", F.lit(1))
    got = {r.id: (r.samples, r.error) for r in stages.sliced(df).collect()}
    assert got[1] == ([1.0, 2.0], None) and [got[i][1] for i in (2, 4, 5, 7)] == ["no samples", "a window outside its recording", "an empty window", "a window without start, end or rate"]
    assert "finite" in got[3][1] and "finite" in got[6][1] and got[3][0] is None
    r = np.random.default_rng(4)
    windows = [(i, r.uniform(size=5).tolist() if i % 3 else None, r.uniform(size=6).tolist(), r.uniform(size=4).tolist() if i % 2 else None, float(r.uniform(-4, 5)), float(r.uniform(5, 12))) for i in range(60)]
    df = spark.createDataFrame(windows, "id int, previous array<double>, samples array<double>, following array<double>, start_s double, end_s double").withColumn("fs", F.lit(2))
    native = intervals.window_samples(F.col("previous"), F.col("samples"), F.col("following"), F.col("start_s"), F.col("end_s"), F.col("fs"))
    want = {r.id: r.w for r in df.select("id", native.alias("w")).collect()}
    assert {r.id: r.samples for r in stages.stitched_windows(df).collect()} == want
    bad = df.withColumn("previous", F.array(F.lit(float("inf"))))
    faults = {r.id: r.error for r in stages.stitched_windows(bad).collect()}
    assert all((faults[i] is not None) == (s < 0) for i, _, _, _, s, _ in windows)


def test_a_fault_is_told_where_it_arose(spark):
    a = spark.createDataFrame([(1, "c", "bad"), (2, "c", None)], "id int, clip string, error string")
    b = spark.createDataFrame([(1, "c", "bad"), (2, "c", "worse")], "id int, clip string, error string")
    assert sorted(map(tuple, failure_report({"read": a, "cut": b}, "id", "clip").collect())) == [("cut", "2", "c", "worse"), ("read", "1", "c", "bad")]
