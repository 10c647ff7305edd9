"""Records with a commit log, annotation scans and window documents."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from sonolith.session import clear_scratch, materialize, scratch, scratch_scope
from sonolith.sources.catalogues import annotation_faults, catalogue_faults, load_annotations, window_catalogue
from sonolith.sources.records import Conflict, Record


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, n int")


def content(record, number=None):
    return sorted((r.item_id, r.n) for r in record.read(number).collect())


def test_saves_rewrite_only_what_they_touch(spark, tmp_path):
    r = Record(spark, f"file://{tmp_path}/r")
    assert r.commit() is None
    assert r.replace(items(spark, [(f"i{i}", i) for i in range(40)]), "2", "then", "then") == 1
    before = r.commit()["buckets"]
    assert r.upsert(items(spark, [("i3", -3), ("new", 7)]), "2", "x", "now") == 2
    after = r.commit()["buckets"]
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2
    want = sorted([(f"i{i}", -3 if i == 3 else i) for i in range(40)] + [("new", 7)])
    assert content(r) == want and content(r, 1) == sorted((f"i{i}", i) for i in range(40))
    assert r.header().first().asDict() == {"number": 2, "version": "2", "created_at": "then", "updated_at": "now"}
    assert r.vacuum(keep=1) == [] and content(r) == want
    r.replace(r.read().filter("n < 5"), "2", "x", "later")
    assert len(r.vacuum(keep=1)) == 2 and content(r) == [w for w in want if w[1] < 5]


def test_two_writers_at_once(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    Record(spark, folder).replace(items(spark, [(f"i{i}", 0) for i in range(30)]), "2", "t", "t")
    errors = []

    def write(k):
        try:
            Record(spark, folder).upsert(items(spark, [(f"i{i}", k) for i in range(k, 30, 3)]), "2", "t", f"w{k}")
        except Exception as e:  # pragma: no cover
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and Record(spark, folder).commit()["number"] == 4
    assert content(Record(spark, folder)) == sorted((f"i{i}", i % 3) for i in range(30))


def test_a_taken_number_is_refused(spark, tmp_path):
    r = Record(spark, f"file://{tmp_path}/r")
    r.replace(items(spark, [("a", 1)]), "2", "t", "t")
    with pytest.raises(Conflict):
        r.put(r.commit())
    with pytest.raises(Conflict):
        r.replace(items(spark, [("a", 2)]), "2", "t", "t", after=7)
    assert content(r) == [("a", 1)]


@pytest.mark.parametrize("step", ["write", "put"])
def test_a_crash_leaves_the_record(spark, tmp_path, monkeypatch, step):
    r = Record(spark, f"file://{tmp_path}/r")
    r.replace(items(spark, [("a", 1)]), "2", "t", "t")
    if step == "write":
        monkeypatch.setattr(r, "put", lambda c: (_ for _ in ()).throw(OSError("crash")))
    else:
        create = r._fs.create
        monkeypatch.setattr(Record, "put", lambda self, c: (create(self._path(f"{self.folder}/commits/_half"), True).close(), (_ for _ in ()).throw(OSError("crash"))))
    with pytest.raises(OSError, match="crash"):
        r.upsert(items(spark, [("a", 2)]), "2", "t", "t")
    monkeypatch.undo()
    again = Record(spark, f"file://{tmp_path}/r")
    assert content(again) == [("a", 1)]
    again.upsert(items(spark, [("a", 3), (None, 4)]), "2", "t", "t")
    assert again.read().count() == 2


def test_many_annotation_files_are_one_scan(spark, tmp_path):
    for i in range(40):
        names = ["Clip ID", "Begin Time (s)", "note", "END time (s)", " Date (UTC) x"]
        row = [f"D{i}_x.wav", "1:30", f'"a, ""{i}"" b"', "95.5", "2024-01-01 00:00:00"]
        turn = i % 5
        names, row = names[turn:] + names[:turn], row[turn:] + row[:turn]
        text = ("﻿" if i % 7 == 0 else "") + ",".join(names) + "\n" + ",".join(row) + "\n\n" + (",".join(row[:2]) + "\n" if i % 2 else "")
        (tmp_path / f"f{i}_20Hz.csv").write_text(text)
    (tmp_path / "bad.csv").write_text("Clip ID,other\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    paths = [f"file://{tmp_path}/f{i}_20Hz.csv" for i in range(40)] + [f"file://{tmp_path}/{n}.csv" for n in ("bad", "empty", "missing")]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    few = load_annotations(spark, paths[:1])
    spark.sparkContext.setJobGroup("many", "many")
    df = load_annotations(spark, paths)
    # the last look for a first row takes a job or two
    assert len(tracker.getJobIdsForGroup("many")) <= len(tracker.getJobIdsForGroup("few")) + 2 and few.count() == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = df.filter("begin_s IS NOT NULL AND end_s IS NOT NULL").collect()
    assert len(rows) >= 40 and {(r.begin_s, r.end_s, r.call_type) for r in rows} == {(90.0, 95.5, "20Hz")} and {r.device_code for r in rows} == {f"D{i}" for i in range(40)}
    faults = {r.source_file.rsplit("/", 1)[-1]: r.fault for r in annotation_faults(spark, paths).collect()}
    assert faults == {"bad.csv": "missing columns: date (utc), begin time (s), end time (s)", "empty.csv": "empty", "missing.csv": "not found"}


def test_documents_of_both_layouts_and_others(spark, tmp_path):
    chunks = [{"chunk_id": "a", "window_index": 1, "chunk_shape": [96, 96]}, {"chunk_id": ""}, {"chunk_id": "b"}, {"chunk_id": "a", "window_index": 2, "window_time_start": 3.5}]
    new = {"device_code": "D1", "start_date": "s", "processing_parameters": {"plotRes": 2}, "chunks": chunks}
    old = {"data_source": {"device_code": "D2", "sample_rate": 5}, "spectrogram_config": {"source": "own"}, "files": [{"file_id": "c", "segment_start_sec": 1, "segment_end_sec": 2}]}
    texts = {"a.json": new, "b.json": old, "c.json": {"chunks": []}, "d.json": [1]}
    for name, doc in texts.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    (tmp_path / "e.json").write_text("{broken")
    got = {r.file_id: r for r in window_catalogue(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].window_index, got["a"].start_s, got["a"].device_code, got["a"].date_from, got["a"].date_to, got["a"].layout) == (2, 3.5, "D1", "s", "", "chunks")
    assert (got["c"].start_s, got["c"].end_s, got["c"].device_code, got["c"].sample_rate, got["c"].spectra_from) == (1.0, 2.0, "D2", 5.0, "own")
    faults = {r.path.rsplit("/", 1)[-1]: r.fault for r in catalogue_faults(spark, f"file://{tmp_path}").collect()}
    assert faults == {"c.json": "unknown layout", "d.json": "unknown layout", "e.json": "no JSON"}


def test_scopes_delete_all_but_results(spark):
    with scratch_scope(spark) as keep:
        inner = materialize(spark.range(3), "x")
        with scratch_scope(spark) as keep2:
            gone = materialize(spark.range(4), "y")
            other = keep2(materialize(gone.select("id"), "z"))
        out = keep(materialize(inner.join(other, "id"), "out"))
    assert out.count() == 3
    for df in (inner, gone, other):
        with pytest.raises(Exception):  # noqa: B017
            spark.read.parquet(df._scratch)
    assert scratch(spark, "a") != scratch(spark, "a")
    clear_scratch(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(out._scratch).count()
    assert spark.range(1).filter(F.col("id") == 0).count() == 1
