"""Queries on dataset profiles, sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import failures as E
from ..operators import intervals as I
from ..operators import learning as L
from ..operators import profile as P
from ..operators import spectra as X
from ..operators import splits
from ..operators import stages as G
from ..operators.tiling import even_starts
from ..session import materialize, scratch
from ..sources import catalogues as C
from ..sources import recordings as B
from ..sources import sinks as K
from ..sources.records import Record
from .interval_queries import _RATIO
from .views import query

_HYDRO = "coalesce(nullif(regexp_extract(source, 'IC[A-Z0-9]+'), ''), nullif(regexp_extract(source, 'JASCOAMARHYDROPHONE[A-Z0-9]+'), ''), 'Unknown')"
_TS = "yyyy-MM-dd HH:mm:ss"


def _spectra(t):
    """Ids of spectra: those of views are numbered negatives."""
    return t.calls.select(F.concat("clip_id", F.when(F.col("call_type") == "view", "_neg_").otherwise("_"), F.col("call_id").cast("string")).alias("spec_id"))


def _failed(t):
    return P.failures(t.calls.withColumn("error", F.when(F.col("end_s") - F.col("begin_s") > 30, "longer than 30 s")))


_FAILED = "count(*) FILTER (WHERE end_s - begin_s > 30)"


_REPORT = """SELECT count(*) AS calls, count(DISTINCT clip_id) AS clips, count(DISTINCT device_code) AS devices,
strftime(min(call_ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(call_ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS spectrograms,
count(*) FILTER (WHERE call_type <> 'view') AS positives, count(*) FILTER (WHERE call_type = 'view') AS negatives, """ + _FAILED + " AS failed FROM calls"


def _dated(report):
    moment = lambda c: F.date_format(F.col(c).cast("timestamp_ntz"), _TS).alias(c)
    return report.select("calls", "clips", "devices", moment("first"), moment("last"), "spectrograms", "positives", "negatives", "failed")


@query("agg_2_dataset_report", "calls", _REPORT)
def _(t):
    return _dated(P.dataset_report(_spectra(t), t.calls, _failed(t)))


@query("agg_4_field_profile", "packed", """SELECT 'source' AS field, 'string' AS type, count(source) AS n, min(length(source)) AS least, max(length(source)) AS greatest FROM packed
UNION ALL SELECT 'n_chars', 'bigint', count(n_chars), min(n_chars), max(n_chars) FROM packed""")
def _(t):
    return P.field_profile(t.packed, {"source": F.length("source"), "n_chars": F.col("n_chars")})


@query("agg_5_per_hydrophone", "packed", f"SELECT {_HYDRO} AS hydrophone, count(*) AS n FROM packed GROUP BY 1")
def _(t):
    return P.per_hydrophone(t.packed)


@query("agg_6_coverage", "packed", r"""WITH s AS (SELECT try_strptime(nullif(regexp_extract(source, '\d{8}T\d{6}'), ''), '%Y%m%dT%H%M%S') AS x FROM packed)
SELECT strftime(min(x), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(x), '%Y-%m-%d %H:%M:%S') AS last, count(x) AS n, count(DISTINCT x) AS distinct_times, (date_diff('second', min(x), max(x)) // 86400)::BIGINT AS days FROM s""")
def _(t):
    c = P.coverage(t.packed.select(S.name_timestamp(F.col("source")).alias("x")), "x")
    return c.withColumn("first", F.date_format("first", _TS)).withColumn("last", F.date_format("last", _TS))


@query("agg_7_combination_counts", "packed", "SELECT array_to_string(list_sort(string_split(label_string, ';')), ';') AS labels, count(*) AS n FROM packed GROUP BY 1")
def _(t):
    return P.combination_counts(t.packed)


@query("agg_8_label_counts", "packed", "SELECT label, count(*) AS n, 100 * count(*) / (SELECT count(*) FROM packed) AS percent FROM (SELECT unnest(string_split(label_string, ';')) AS label FROM packed) GROUP BY label")
def _(t):
    return P.label_counts(t.packed)


@query("agg_9_normal_share", "packed", f"""SELECT hydrophone, total, normal, total - normal AS anomalous, 100 * normal / total AS percent FROM (
SELECT {_HYDRO} AS hydrophone, count(*) AS total, count(*) FILTER (WHERE label_string IN ('normal', '')) AS normal FROM packed GROUP BY 1)""")
def _(t):
    return P.normal_share(t.packed)


@query("agg_20_failures", "", "SELECT label::VARCHAR || '_' || vec_id::VARCHAR || '.wav' AS clip_id, 'file does not start with RIFF id' AS reason FROM embeddings WHERE vec_id % 10 = 0")
def _(t):
    """Every tenth recording is junk; reading them all keeps the reason and goes on."""
    return P.failures(C.load_clips(t.spark, _written_clips(t, junk=True)), "clip_id")


_CHUNKS = """k AS (SELECT doc_id AS source, n_chars % 2000 + 1 AS total FROM documents),
e AS (SELECT source, total, i, CASE WHEN total > 96 THEN round_even(i * ((total - 96) / (ceil(total / 96) - 1)), 0)::INT ELSE 0 END AS start FROM k, unnest(range(greatest(1, ceil(total / 96))::INT)) AS u(i))"""


def _chunks(t):
    """Window catalogue with faults: windows cut short, moved, of a wrong shape, mistimed or beyond the end."""
    total = (F.col("n_chars") % 2000 + 1).cast("int")
    c = t["documents"].select(F.col("doc_id").alias("source"), total.alias("total"), F.posexplode(even_starts(total, F.lit(96))).alias("i", "start"))
    t_start = F.col("start") * 0.1 + F.when(F.col("source") % 3 == 0, 0.5).otherwise(0.0)
    c = c.withColumn("t_start", t_start + F.when((F.col("source") % 11 == 0) & (F.col("i") == 1), 0.05).otherwise(0.0))
    c = c.withColumn("t_end", t_start + (F.least(F.lit(96), F.col("total") - F.col("start")) - 1) * 0.1 + 1.0 + F.when((F.col("source") % 13 == 0) & (F.col("i") == 2), 300.0).otherwise(0.0))
    c = c.withColumn("t_end", F.when(F.col("source") % 17 > 0, F.col("t_end")))
    c = c.withColumn("start", F.when((F.col("source") % 7 == 0) & (F.col("i") == 1), F.col("start") + 1).otherwise(F.col("start")))
    shape = [F.lit(96).alias("rows"), F.when(F.col("source") % 5 == 0, 95).otherwise(96).alias("cols"), F.when(F.col("source") % 19 == 0, 97).otherwise(96).alias("freq")]
    return c.select("*", *shape)


_FAULTS = f"""{_CHUNKS}, f AS (SELECT source, total, i, start, CASE WHEN source % 7 = 0 AND i = 1 THEN start + 1 ELSE start END AS seen, CASE WHEN source % 5 = 0 THEN 95 ELSE 96 END AS cols,
CASE WHEN source % 19 = 0 THEN 97 ELSE 96 END AS freq, start * 0.1::DOUBLE + CASE WHEN source % 3 = 0 THEN 0.5::DOUBLE ELSE 0 END AS t0 FROM e),
t AS (SELECT *, least(96, total - seen) AS bins, t0 + CASE WHEN source % 11 = 0 AND i = 1 THEN 0.05::DOUBLE ELSE 0 END AS ts,
CASE WHEN source % 17 > 0 THEN t0 + (least(96, total - start) - 1) * 0.1::DOUBLE + 1.0::DOUBLE + CASE WHEN source % 13 = 0 AND i = 2 THEN 300.0::DOUBLE ELSE 0 END END AS te FROM f),
h0 AS (SELECT source, list_sort(list((te - ts - 1.0::DOUBLE) / (bins - 1)) FILTER (WHERE te IS NOT NULL AND bins > 1 AND te - ts - 1 > 0)) AS l FROM t GROUP BY source),
h AS (SELECT source, coalesce(l[len(l) // 2 + 1], 1.0::DOUBLE * (1.0::DOUBLE - 0.9::DOUBLE)) AS hop FROM h0),
o0 AS (SELECT source, any_value(hop) AS hop, list_sort(list(ts - seen * hop) FILTER (WHERE seen <> 0)) AS l FROM t JOIN h USING (source) GROUP BY source),
o AS (SELECT source, hop, coalesce(l[len(l) // 2 + 1], 0) AS off FROM o0),
w AS (SELECT *, greatest(0, seen * hop + off) AS want FROM t JOIN o USING (source)),
r AS (SELECT source, count(*) AS windows, count(*) FILTER (WHERE cols <> 96) AS shape_faults, count(*) FILTER (WHERE freq <> 96) AS freq_faults,
count(*) FILTER (WHERE te > 1.0::DOUBLE + (total - 1) * (1.0::DOUBLE * (1.0::DOUBLE - 0.9::DOUBLE)) + 0.001::DOUBLE) AS bound_faults,
count(*) FILTER (WHERE te IS NOT NULL AND abs(ts - want) > 0.001::DOUBLE) + count(*) FILTER (WHERE abs(te - (want + (bins - 1) * hop + 1.0::DOUBLE)) > 0.001::DOUBLE) AS timing_faults,
(2 * count(*) FILTER (WHERE seen <> start))::INT AS start_faults FROM w GROUP BY source)"""


@query("agg_20_stage_failures", "", """WITH e AS (SELECT vec_id, label::VARCHAR || '_' || vec_id::VARCHAR || '.wav' AS clip_id, vec_id % 70 AS a, vec_id % 70 + vec_id % 30 AS b FROM embeddings),
f AS (SELECT vec_id, clip_id, CASE WHEN vec_id % 10 = 0 THEN 'read: file does not start with RIFF id' WHEN b = a THEN 'slice: an empty window' WHEN b > 64 THEN 'slice: a window outside its recording'
WHEN b - a < 16 THEN 'spectrum: fewer samples than a frame' END AS f FROM e)
SELECT split_part(f, ': ', 1) AS stage, vec_id::VARCHAR AS call_id, clip_id, split_part(f, ': ', 2) AS reason FROM f WHERE f IS NOT NULL""")
def _(t):
    """Junk is read, windows are cut and transformed; each fault is a row, told where it arose. What a stage made is written once, as
    the next stage and the report both read it."""
    c = C.load_clips(t.spark, _written_clips(t, junk=True)).withColumn("call_id", F.regexp_extract("clip_id", r"_(\d+)", 1).cast("long"))
    c = c.withColumn("start_s", F.col("call_id") % 70 / 64).withColumn("end_s", (F.col("call_id") % 70 + F.col("call_id") % 30) / 64)
    c = materialize(c, "read")
    s = materialize(G.sliced(c), "slices")
    p = X.band_power(s.withColumn("start", F.lit(0)), 16, 8, 1 << 20, key="call_id", keep=("clip_id",))
    return E.failure_report({"read": c, "slice": s, "spectrum": p}, "call_id", "clip_id")


@query("agg_24_catalogue_consistency", "", f"WITH {_FAULTS} SELECT * FROM r")
def _(t):
    return P.consistency(_chunks(t), 96, 1.0, 0.9)


@query("agg_24_catalogue_totals", "", f"""WITH {_FAULTS} SELECT count(*) AS sources, sum(windows)::BIGINT AS windows, sum(shape_faults)::BIGINT AS shape_faults, sum(freq_faults)::BIGINT AS freq_faults,
sum(bound_faults)::BIGINT AS bound_faults, sum(timing_faults)::BIGINT AS timing_faults, count(*) FILTER (WHERE start_faults > 0) AS sources_off FROM r""")
def _(t):
    return P.consistency_totals(P.consistency(_chunks(t), 96, 1.0, 0.9))


@query("agg_25_upper_median", "calls", "SELECT device_code, sorted[len(sorted) // 2 + 1] AS median FROM (SELECT device_code, list_sort(list(end_s - begin_s)) AS sorted FROM calls GROUP BY device_code)")
def _(t):
    return P.upper_median(t.calls.withColumn("d", F.col("end_s") - F.col("begin_s")), ["device_code"], "d", "median")


@query("agg_26_shift_warning", "calls", """SELECT device_code, m / 9.0::DOUBLE AS ratio, m / 9.0::DOUBLE >= 2 AS shifted FROM (SELECT device_code, sorted[len(sorted) // 2 + 1] AS m
FROM (SELECT device_code, list_sort(list(end_s - begin_s)) AS sorted FROM calls GROUP BY device_code))""")
def _(t):
    return P.shift_warning(t.calls.withColumn("d", F.col("end_s") - F.col("begin_s")), ["device_code"], "d", 9.0)


@query("agg_27_calls_per_clip", "calls", "SELECT clip_id, count(*) AS calls, min(begin_s) AS first, arg_max(end_s, (begin_s, end_s)) AS last_end FROM calls GROUP BY clip_id")
def _(t):
    c = P.calls_per_clip(t.calls)
    return c.select("clip_id", "calls", F.element_at("intervals", 1)["begin_s"].alias("first"), F.element_at("intervals", -1)["end_s"].alias("last_end"))


@query("agg_28_sources_per_class", "calls entries", "SELECT label, count(DISTINCT src_id) AS sources, count(*) AS entries FROM entries GROUP BY label")
def _(t):
    return P.sources_per_class(t.entries)


@query("agg_29_resolution", "cells", """WITH n AS (SELECT spec_id, count(DISTINCT t_idx) AS n, 0.05::DOUBLE * (1 + spec_id % 3) AS step FROM cells GROUP BY spec_id)
SELECT spec_id, 63.0::DOUBLE * (1 + spec_id % 7) / 63 AS hz_per_bin, 1000 * ((n - 1) * step) / greatest(1, n - 1) AS ms_per_bin, '64 x ' || n::VARCHAR AS size FROM n""")
def _(t):
    """Axes of several resolutions."""
    f = F.transform("f", lambda x: x * (1 + F.col("spec_id") % 7))
    at = F.transform("t", lambda x: x * (F.lit(0.05) * (1 + F.col("spec_id") % 3)))
    return t.spectra.select("spec_id", *P.resolution(f, at))


@query("join_13_parameter_drift", "", """WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'test' END AS run, p_type AS param, sum(p_size)::BIGINT AS value FROM part GROUP BY ALL)
SELECT a.param, a.value AS a, b.value AS b FROM p a JOIN p b USING (param) WHERE a.run = 'train' AND b.run = 'test' AND a.value <> b.value""")
def _(t):
    run = F.when(F.col("p_partkey") % 2 == 0, "train").otherwise("test")
    return P.parameter_drift(t["part"].groupBy(run.alias("run"), F.col("p_type").alias("param")).agg(F.sum("p_size").alias("value")), "train", "test")


@query("ml_3_baseline_fit")
def _(t):
    e = t["embeddings"].select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x0"), (F.col("label") < 3).cast("int").alias("y"))
    train, rest = e.filter("vec_id % 5 < 3"), e.filter("vec_id % 5 = 3")
    model, tried = L.fit_baseline(train, rest, "x0", "y")
    return L.predict(model, e.filter("vec_id % 5 = 4"), "x0", "y").withColumn("validation_auc", F.lit(max(r["metric"] for r in tried.collect())))


_EPOCHS = 3


def _epoch_sql():
    """Training written out: weights of each epoch from those before, by the rule itself."""
    unit = "('0x' || substr(md5('epoch{}{}|' || draw::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    sql = """WITH e AS MATERIALIZED (SELECT vec_id AS id, (label < 3)::INT AS y, vec_id % 5 AS part FROM embeddings),
x AS MATERIALIZED (SELECT vec_id AS id, i, CASE WHEN i < 8 THEN embedding[i + 1]::DOUBLE ELSE 1 END AS v FROM embeddings, (SELECT unnest(range(9)) AS i)),
n AS (SELECT y, count(*) AS n FROM e WHERE part < 3 GROUP BY y), cw AS (SELECT y, raw / avg(raw) OVER () AS weight FROM (SELECT y, (SELECT sum(n) FROM n) / n AS raw FROM n)),
w0 AS MATERIALIZED (SELECT i, 0.0::DOUBLE AS w FROM range(9) r(i))"""
    for k in range(_EPOCHS):
        sql += f""",
r{k} AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('epoch{k}|' || id::VARCHAR)) AS rank, count(*) OVER (PARTITION BY y) AS size FROM e WHERE part < 3),
z{k} AS (SELECT y, max(size) AS size, row_number() OVER (ORDER BY y) - 1 AS c, count(*) OVER () AS classes FROM r{k} GROUP BY y),
d{k} AS (SELECT draw, {unit.format(k, 'c')} AS u, {unit.format(k, 'r')} AS q FROM (SELECT unnest(range((SELECT 2 * max(size) FROM z{k}))) AS draw)),
s{k} AS MATERIALIZED (SELECT draw, id, r{k}.y FROM d{k} JOIN z{k} ON c = floor(u * classes) JOIN r{k} ON r{k}.y = z{k}.y AND rank = floor(q * z{k}.size) + 1),
p{k} AS MATERIALIZED (SELECT id, 1 / (1 + exp(-sum(v * w))) AS p FROM x JOIN w{k} USING (i) GROUP BY id),
w{k + 1} AS MATERIALIZED (SELECT i, any_value(w) - 0.5::DOUBLE * sum((p - y) * v) / count(*) AS w FROM s{k} JOIN p{k} USING (id) JOIN x USING (id) JOIN w{k} USING (i) GROUP BY i),
t{k} AS MATERIALIZED (SELECT id, y, part, 1 / (1 + exp(-sum(v * w))) AS p FROM x JOIN w{k + 1} USING (i) JOIN e USING (id) WHERE part > 2 GROUP BY ALL),
h{k} AS MATERIALIZED (SELECT {k} AS epoch, (SELECT sum(weight * -ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) / sum(weight) FROM t{k} JOIN cw USING (y) WHERE part = 3) AS loss,
  (SELECT avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM t{k} a, t{k} b WHERE a.part = 3 AND b.part = 3 AND a.y = 1 AND b.y = 0) AS metric)"""
    sql += ",\nh AS (" + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(_EPOCHS)) + ")"
    every = " UNION ALL ".join(f"SELECT {k} AS epoch, * FROM t{k}" for k in range(_EPOCHS))
    return sql + f", best AS (SELECT epoch FROM h ORDER BY metric DESC, epoch LIMIT 1), t AS ({every})\n"


def _epochs(t):
    e = t["embeddings"].select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("x"), (F.col("label") < 3).cast("int").alias("y"))
    model, history = L.fit_epochs(e.filter("vec_id % 5 < 3"), e.filter("vec_id % 5 = 3"), "x", "y", "vec_id", epochs=_EPOCHS)
    return e, model, history


@query("ml_3_epoch_history", "", _epoch_sql() + "SELECT epoch, round(loss, 6) AS loss, round(metric, 6) AS metric, epoch = (SELECT epoch FROM best) AS best FROM h")
def _(t):
    _, model, history = _epochs(t)
    return history.select("epoch", F.round("loss", 6).alias("loss"), F.round("metric", 6).alias("metric"), (F.col("epoch") == model.epoch).alias("best"))


@query("ml_3_epoch_scores", "", _epoch_sql() + "SELECT id AS vec_id, y AS y_true, round(p, 6) AS score FROM t WHERE part = 4 AND epoch = (SELECT epoch FROM best)")
def _(t):
    """Scores of what was held out, by the model of the best epoch, saved and loaded again."""
    e, model, _ = _epochs(t)
    folder = scratch(t.spark, "model")
    L.save_linear(t.spark, model, folder)
    scored = L.linear_scored(e.filter("vec_id % 5 = 4"), L.load_linear(t.spark, folder).weights, "x", "y", "epochs", keep=["vec_id"])
    return scored.select("vec_id", "y_true", F.round("score", 6).alias("score"))


def _written_calls(t):
    """Annotation CSVs by call type, with odd headers, columns in another order and quoted fields, and an unusable file."""
    folder, paths = scratch(t.spark, "annotations"), []
    for kind, name in (("view", "lib_20Hz"), ("purchase", "lib_40hz"), ("click", "plain")):
        c = t.calls.filter(F.col("call_type") == kind)
        quoted = F.concat(F.lit('a "b", '), F.col("call_id").cast("string"))
        c = c.select(F.date_format("call_ts", _TS).alias(" Date (UTC)"), F.col("begin_s").cast("string").alias("Begin Time (s)"), F.col("end_s").cast("string").alias("END TIME (s) "), F.col("clip_id").alias("Clip ID"), quoted.alias("note"))
        c = c.select(*reversed(c.columns)) if kind == "click" else c
        c.write.option("header", "true").option("escape", '"').csv(f"{folder}/{name}")
        paths.append(f"{folder}/{name}")
    t.calls.select("call_id").limit(3).write.option("header", "true").csv(f"{folder}/bad")
    return [*paths, f"{folder}/bad", f"{folder}/missing"]


@query("src_1_annotations", "calls", """SELECT CASE call_type WHEN 'view' THEN '20Hz' WHEN 'purchase' THEN '40Hz' ELSE 'other' END AS call_type, clip_id, device_code, begin_s, end_s, strftime(call_ts, '%Y-%m-%d %H:%M:%S') AS stamp
FROM calls WHERE call_type IN ('view', 'purchase', 'click')""")
def _(t):
    c = C.load_annotations(t.spark, _written_calls(t))
    return c.select("call_type", "clip_id", "device_code", "begin_s", "end_s", F.date_format("call_ts", _TS).alias("stamp"))


@query("src_1_annotation_faults", "calls", "SELECT * FROM (VALUES ('bad', 'missing columns: date (utc), begin time (s), end time (s), clip id'), ('missing', 'not found')) v(name, fault) WHERE (SELECT count(*) FROM calls) > 0")
def _(t):
    f = C.annotation_faults(t.spark, _written_calls(t))
    return f.select(F.element_at(F.split("source_file", "/"), -1).alias("name"), "fault").distinct()


def _written(frame, folder, name, content):
    """Write a file for each row in the shared folder, by tasks: the columns of its name and content."""

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for path, data in zip(batch[name], batch[content], strict=True):
                if (parent := f"{root}/{path}".rpartition("/")[0]) not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                with where.open_output_stream(f"{root}/{path}") as f:
                    f.write(bytes(data))
            yield pd.DataFrame({"n": [len(batch)]})

    frame.select(name, content).mapInPandas(write, "n int").agg(F.sum("n")).first()
    return folder


def _written_clips(t, junk=False):
    """A folder of WAV files of 8, 16, 24 and 32 bits a sample; with ``junk`` every tenth is no WAV file."""

    @F.pandas_udf("binary")
    def packed(width: pd.Series, samples: pd.Series) -> pd.Series:
        import io
        import wave

        import numpy as np

        def one(size, x):
            if not size:
                return b"junk" * 20
            top = (1 << (8 * size - 1)) - 1
            x = (np.clip(np.asarray(x, float), -1, 0.999) * top).astype("<i8") + (128 if size == 1 else 0)
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(size)
                w.setframerate(64)
                w.writeframes(x.view(np.uint8).reshape(-1, 8)[:, :size].tobytes())
            return buffer.getvalue()

        return pd.Series([one(w, x) for w, x in zip(width, samples, strict=True)])

    width = (F.col("vec_id") % 4 + 1).cast("int")
    width = F.when(F.col("vec_id") % 10 == 0, 0).otherwise(width) if junk else width
    name = F.concat(F.col("label").cast("string"), F.lit("_"), F.col("vec_id").cast("string"), F.lit(".wav"))
    e = t["embeddings"].repartition(4 * t.spark.sparkContext.defaultParallelism, "vec_id")  # a file a row is work for all cores
    e = e.select(name.alias("name"), packed(width, F.col("embedding")).alias("content"))
    return _written(e, scratch(t.spark, "clips"), "name", "content")


@query("src_2_clips", "", """WITH s AS (SELECT vec_id, label, vec_id % 4 + 1 AS width, i, greatest(-1, least(0.999::DOUBLE, embedding[i + 1]::DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(64)) AS i))
SELECT label::VARCHAR || '_' || vec_id::VARCHAR || '.wav' AS clip_id, 64 AS fs, 64::BIGINT AS n_samples, i::INT AS i,
       trunc(x * ((1::BIGINT << (8 * width - 1)) - 1)) / (1::BIGINT << (8 * width - 1)) AS x FROM s""")
def _(t):
    """Recordings of four sample widths that the tasks write in the shared folder, then read as clips, every sample."""
    c = C.load_clips(t.spark, _written_clips(t)).filter("error IS NULL")
    return c.select("clip_id", "fs", "n_samples", F.posexplode("samples").alias("i", "x"))


@query("src_2_blocks", "", """WITH s AS (SELECT vec_id, label, vec_id % 4 + 1 AS width, i, greatest(-1, least(0.999::DOUBLE, embedding[i + 1]::DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(64)) AS i)),
q AS (SELECT label::VARCHAR || '_' || vec_id::VARCHAR || '.wav' AS clip_id, i, trunc(x * ((1::BIGINT << (8 * width - 1)) - 1)) / (1::BIGINT << (8 * width - 1)) AS x FROM s)
SELECT clip_id, 64 AS fs, 64::BIGINT AS n_samples, start::BIGINT AS start, (i - start)::INT AS i, x FROM q, (SELECT unnest(range(0, 64, 20)) AS start) WHERE i >= start AND i < start + 24""")
def _(t):
    """The same recordings in blocks of 20 samples, each with 4 of the next, read by a data source."""
    b = B.load_blocks(t.spark, _written_clips(t), block=20, halo=4, split_bytes=1 << 23)
    return b.select("clip_id", "fs", "n_samples", "start", F.posexplode("samples").alias("i", "x"))


@query("arr_17_band_blocks", "", """WITH s AS (SELECT vec_id, label, vec_id % 4 + 1 AS width, i, greatest(-1, least(0.999::DOUBLE, embedding[i + 1]::DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(64)) AS i)),
q AS (SELECT label::VARCHAR || '_' || vec_id::VARCHAR || '.wav' AS clip_id, i, trunc(x * ((1::BIGINT << (8 * width - 1)) - 1)) / (1::BIGINT << (8 * width - 1)) AS x FROM s),
w AS (SELECT clip_id, fr, i - fr * 8 AS n, x * (0.5 - 0.5 * cos(2 * pi() * (i - fr * 8) / 16)) AS x FROM q, (SELECT unnest(range(7)) AS fr) WHERE i >= fr * 8 AND i < fr * 8 + 16),
p AS (SELECT clip_id, fr, k, pow(sum(x * cos(n * k * (2 * pi() / 16))), 2) + pow(sum(x * sin(n * k * (2 * pi() / 16))), 2) AS power FROM w, (SELECT unnest(range(9)) AS k) GROUP BY ALL),
m AS (SELECT clip_id, max(power) AS top FROM p GROUP BY clip_id)
SELECT clip_id, fr::INT AS frame, k::INT AS bin, round(greatest(power / top, 1e-5::DOUBLE), 5) AS relative FROM p JOIN m USING (clip_id) WHERE k BETWEEN 2 AND 5""")
def _(t):
    """Bins from 8 to 20 Hz of recordings at 64 Hz: blocks of 24 samples with a frame's halo, relative to the maximum of all bins."""
    blocks = B.load_blocks(t.spark, _written_clips(t), block=24, halo=16)
    m = X.spectrum_matrix(X.band_spectrum(blocks, 16, 8, 24, band_hz=(8.0, 20.0)))
    c = m.select("clip_id", "first_bin", F.posexplode_outer("matrix").alias("b", "row")).filter("b IS NOT NULL").select("clip_id", (F.col("first_bin") + F.col("b")).alias("bin"), F.posexplode("row").alias("frame", "db"))
    return c.select("clip_id", "frame", "bin", F.round(F.greatest(F.pow(F.lit(10.0), F.col("db") / 10), F.lit(1e-5)), 5).alias("relative"))


@query("src_3_labelled_index", "calls", r"""WITH n AS (SELECT replace(clip_id, '.wav', '') AS src, (call_type = 'purchase')::INT AS label, min(begin_s) AS b, max(end_s) AS e, count(*) AS k FROM calls GROUP BY ALL)
SELECT src || '_' || printf('%.1f', b) || 's_' || printf('%.1f', e) || CASE WHEN k % 2 = 0 THEN 's.mat' ELSE 's.MAT' END AS name, src, printf('%.1f', b)::DOUBLE AS start_s, printf('%.1f', e)::DOUBLE AS second_s, label FROM n""")
def _(t):
    """Two folders of spectra, one per clip and class, beside files that are none."""
    stem = F.replace("clip_id", F.lit(".wav"), F.lit(""))
    n = t.calls.groupBy(stem.alias("src"), (F.col("call_type") == "purchase").alias("positive")).agg(F.min("begin_s").alias("b"), F.max("end_s").alias("e"), F.count("*").alias("k"))
    name = F.concat(F.when(F.col("positive"), "positive/").otherwise("negative/"), F.format_string("%s_%.1fs_%.1fs", "src", "b", "e"))
    files = n.select(F.explode(F.array(F.concat(name, F.when(F.col("k") % 2 == 0, ".mat").otherwise(".MAT")), F.concat(name, F.lit(".png")))).alias("name"), F.lit(b"x").alias("content"))
    folder = _written(files, scratch(t.spark, "spectra"), "name", "content")
    return C.labelled_files(t.spark, f"{folder}/positive", f"{folder}/negative").select("name", "src", "start_s", "second_s", "label")


def _paths():
    return [F.concat(F.lit("m/"), "file_id").alias("mat_path"), F.concat(F.lit("a/"), "file_id").alias("audio_path")]


def _catalogue(t, day, which):
    """A folder of window documents of one day each, those of ``which`` days of the newer layout. A larger table makes more documents, of
    about 20,000 windows at most, not longer ones."""
    parts = t.predictions.count() // 20_000 + 1
    p = t.predictions.withColumn("day", day).withColumn("part", F.pmod(F.xxhash64("file_id"), F.lit(parts)))
    folder = scratch(t.spark, "windows")
    shape, number = F.array(F.lit(96), F.lit(96)), (F.length("file_id") % 5).cast("int")
    chunk = F.struct(
        F.col("file_id").alias("chunk_id"), *_paths(), F.lit(1.5).alias("window_time_start"), F.lit(11.5).alias("window_time_end"), F.col("audio_timestamp").alias("timestamp"),
        shape.alias("chunk_shape"), number.alias("window_index"), F.concat("file_id", F.lit(".wav")).alias("source_audio"),
    )
    new = p.filter(which).groupBy("day", "part").agg(F.collect_list(chunk).alias("chunks"))
    new.select("chunks", F.col("day").alias("device_code"), F.lit("2024-01-01").alias("start_date"), F.struct(F.lit(0.9).alias("overlap")).alias("processing_parameters")).write.json(f"{folder}/new")
    entry = F.struct(F.col("file_id"), *_paths(), F.lit(40.0).alias("segment_start_sec"), F.lit(80.0).alias("segment_end_sec"))
    old = p.filter(~which).groupBy("day", "part").agg(F.collect_list(entry).alias("files"))
    old.select("files", F.struct(F.col("day").alias("device_code"), F.lit(64000.0).alias("sample_rate")).alias("data_source"), F.struct(F.lit("download").alias("source")).alias("spectrogram_config")).write.json(f"{folder}/old")
    t.predictions.limit(3).select("file_id").write.json(f"{folder}/other")
    return f"{folder}/*"


_DAY = "audio_timestamp[9:10]"


@query("src_4_window_catalogue", "predictions", f"""SELECT file_id, 'm/' || file_id AS mat_path, 'a/' || file_id AS audio_path, 1.5::DOUBLE AS start_s, 11.5::DOUBLE AS end_s, 'd' || {_DAY} AS device_code, '2024-01-01' AS date_from,
audio_timestamp, 96 AS height, (length(file_id) % 5)::INT AS window_index, file_id || '.wav' AS source_audio, 'default' AS spectra_from FROM predictions""")
def _(t):
    w = C.window_catalogue(t.spark, _catalogue(t, F.concat(F.lit("d"), F.col("audio_timestamp").substr(9, 2)), F.lit(True)), lines=True)
    return w.select("file_id", "mat_path", "audio_path", "start_s", "end_s", "device_code", "date_from", "audio_timestamp", F.get("chunk_shape", F.lit(0)).alias("height"), "window_index", "source_audio", "spectra_from")


@query("src_4_legacy_catalogue", "predictions", f"""SELECT file_id, 'm/' || file_id AS mat_path, 'a/' || file_id AS audio_path, 40.0::DOUBLE AS start_s, 80.0::DOUBLE AS end_s,
'd' || {_DAY} AS device_code, 64000.0::DOUBLE AS sample_rate, 'download' AS spectra_from
FROM predictions""")
def _(t):
    w = C.window_catalogue(t.spark, _catalogue(t, F.concat(F.lit("d"), F.col("audio_timestamp").substr(9, 2)), F.lit(False)), lines=True)
    return w.select("file_id", "mat_path", "audio_path", "start_s", "end_s", "device_code", "sample_rate", "spectra_from")


@query("src_4_mixed_catalogue", "predictions", f"""SELECT file_id, CASE WHEN {_DAY}::INT % 2 = 0 THEN 'chunks' ELSE 'files' END AS layout, 'd' || {_DAY} AS device_code, CASE WHEN {_DAY}::INT % 2 = 0 THEN 1.5::DOUBLE ELSE 40 END AS start_s,
CASE WHEN {_DAY}::INT % 2 = 0 THEN (length(file_id) % 5)::INT END AS window_index, CASE WHEN {_DAY}::INT % 2 = 1 THEN 64000.0::DOUBLE END AS sample_rate FROM predictions""")
def _(t):
    """One folder that holds documents of both layouts."""
    which = F.col("audio_timestamp").substr(9, 2).cast("int") % 2 == 0
    w = C.window_catalogue(t.spark, _catalogue(t, F.concat(F.lit("d"), F.col("audio_timestamp").substr(9, 2)), which), lines=True)
    return w.select("file_id", "layout", "device_code", "start_s", "window_index", "sample_rate")


@query("src_4_catalogue_faults", "predictions", "SELECT 'unknown layout' AS fault, least(3, count(*)) AS documents FROM predictions")
def _(t):
    f = C.catalogue_faults(t.spark, _catalogue(t, F.lit("d"), F.lit(True)), lines=True)
    return f.groupBy("fault").agg(F.sum("documents").alias("documents"))


@query("src_5_documentation", "calls", _REPORT)
def _(t):
    folder = scratch(t.spark, "report")
    K.write_report(P.dataset_report(_spectra(t), t.calls, _failed(t)), folder)
    return _dated(C.documentation(t.spark, folder))


@query("src_6_packed_scan", "packed", "SELECT doc_id, source, label_string FROM packed")
def _(t):
    folder = scratch(t.spark, "packed")
    t.packed.write.parquet(folder)
    return t.spark.read.parquet(folder).select("doc_id", "source", "label_string")


@query("snk_1_items", "items", "SELECT item_id, score_a AS score, '2024-01-01' AS created_at, '2024-02-02' AS updated_at FROM items")
def _(t):
    folder = scratch(t.spark, "items")
    K.write_items(t.items.select("item_id", "model_outputs", "verifications"), folder, "2.0", "2024-01-01", "2024-01-01")
    K.write_items(K.read_items(t.spark, folder), folder, "2.0", "2024-02-02", "2024-02-02")  # from the document itself
    items = K.read_items(t.spark, folder).select("item_id", F.get("model_outputs", F.lit(0))["score"].alias("score"))
    return items.crossJoin(F.broadcast(Record(t.spark, folder).header().select("created_at", "updated_at")))  # one row


@query("snk_1_updated_items", "items", """SELECT item_id, CASE WHEN doc_id % 10 = 0 THEN -score_a ELSE score_a END AS score, 3 AS number FROM items WHERE doc_id % 7 > 0
UNION ALL SELECT item_id, CASE WHEN doc_id % 10 = 0 THEN -score_a ELSE 2 END, 3 FROM items WHERE doc_id % 7 = 0""")
def _(t):
    """A document, saved once, then with some items changed and some added."""
    folder = scratch(t.spark, "items")
    score = F.get("model_outputs", F.lit(0))["score"]
    i = t.items.select("item_id", score.alias("score"), "doc_id")
    K.write_items(i.filter("doc_id % 7 > 0").drop("doc_id"), folder, "2.0", "2024-01-01", "2024-01-01")
    K.update_items(i.filter("doc_id % 7 = 0").select("item_id", F.lit(2.0).alias("score")), folder, "2.0", "2024-01-01", "2024-02-02")
    K.update_items(i.filter("doc_id % 10 = 0").select("item_id", (-F.col("score")).alias("score")), folder, "2.0", "2024-01-01", "2024-03-03")
    return K.read_items(t.spark, folder).withColumn("number", F.lit(Record(t.spark, folder).commit()["number"]))


@query("snk_2_predictions", "predictions", "SELECT file_id, expert_label, confidence FROM predictions")
def _(t):
    folder = scratch(t.spark, "predictions")
    K.write_items(t.predictions, folder, "1.0", "2024-01-01", "2024-01-01", key="file_id")
    return K.read_items(t.spark, folder).select("file_id", "expert_label", "confidence")


@query("snk_3_splits", "calls entries", f"WITH {_RATIO} SELECT spec_id::VARCHAR AS path, label, split FROM sp")
def _(t):
    folder = scratch(t.spark, "splits")
    e = splits.ratio_split(t.entries).select(F.col("spec_id").cast("string").alias("path"), "label", "split")
    K.write_splits(e, folder)
    return t.spark.read.schema("path string, label int, split string").option("sep", "\t").csv(folder)


@query("snk_4_spectra_by_date", "calls", "SELECT device_code, strftime(call_ts, '%Y-%m-%d') AS date, count(*) AS n FROM calls GROUP BY ALL")
def _(t):
    folder = scratch(t.spark, "spectra")
    K.write_by_date(t.calls.select("call_id", "device_code", F.date_format("call_ts", "yyyy-MM-dd").alias("date")), folder)
    back = t.spark.read.schema("call_id long, date string, device_code string").parquet(folder)
    return back.groupBy("device_code", "date").agg(F.count("*").alias("n"))


@query("snk_5_window_audio", "", "SELECT vec_id, embedding[11]::DOUBLE AS first, least(20, 64 - 10)::INT AS n FROM embeddings")
def _(t):
    folder = scratch(t.spark, "audio")
    cut = I.sample_slice(F.transform("embedding", lambda x: x.cast("double")), F.lit(10 / 64), F.lit(30 / 64), F.lit(64))
    e = t["embeddings"].select("vec_id", cut.alias("samples"), F.lit("2024-01-01").alias("date"), F.concat(F.lit("D"), F.col("label").cast("string")).alias("device_code"))
    K.write_by_date(e, folder)
    return t.spark.read.parquet(folder).select("vec_id", F.element_at("samples", 1).alias("first"), F.size("samples").alias("n"))


@query("snk_6_report", "calls", _REPORT)
def _(t):
    folder = scratch(t.spark, "report")
    K.write_report(P.dataset_report(_spectra(t), t.calls, _failed(t)), folder)
    return _dated(t.spark.read.json(folder))


@query("snk_7_windows", "", "SELECT doc_id, 96 AS crop, count(*) AS windows FROM (SELECT doc_id, unnest(range(greatest(1, ceil((n_chars % 2000 + 1) / 96))::INT)) FROM documents) GROUP BY doc_id")
def _(t):
    folder = scratch(t.spark, "catalogue")
    K.write_windows(_chunks(t), folder, {"crop": 96, "win_dur_s": 1.0, "overlap": 0.9})
    back = t.spark.read.schema("source long, processing_parameters struct<crop int>").json(folder)
    return back.groupBy(F.col("source").alias("doc_id"), F.col("processing_parameters.crop").alias("crop")).agg(F.count("*").alias("windows"))
