"""Queries on names, times, filters, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as O
from .views import query

_TS = "yyyy-MM-dd HH:mm:ss"


@query("time_1_name_timestamp", "calls", "SELECT call_id, strftime(try_strptime(nullif(regexp_extract(clip_id, '\\d{8}T\\d{6}'), ''), '%Y%m%dT%H%M%S'), '%Y-%m-%d %H:%M:%S') AS start FROM calls")
def _(t):
    return t.calls.select("call_id", F.date_format(S.name_timestamp(F.col("clip_id")), _TS).alias("start"))


@query("time_2_positional_timestamp", "packed", "SELECT doc_id, strftime(try_strptime(substr(split_part(replace(split_part(source, '_', 2), 'Z', ''), '.', 1), 1, 15), '%Y%m%dT%H%M%S'), '%Y-%m-%d %H:%M:%S') AS start FROM packed")
def _(t):
    return t.packed.select("doc_id", F.date_format(S.positional_timestamp(F.col("source")), _TS).alias("start"))


@query("time_3_iso_timestamp", "predictions", "SELECT file_id, strftime(audio_timestamp::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS at, strftime(audio_timestamp::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS at_z FROM predictions")
def _(t):
    z = F.concat("audio_timestamp", F.lit("Z"))
    return t.predictions.select("file_id", *[F.date_format(S.iso_timestamp(c), _TS).alias(n) for c, n in ((F.col("audio_timestamp"), "at"), (z, "at_z"))])


@query("time_4_clock_seconds", "", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN m * 60 + s WHEN event_id % 4 = 1 THEN h * 3600 + m * 60 + s WHEN event_id % 4 = 2 THEN s END AS seconds
FROM (SELECT event_id, hour(ts)::DOUBLE AS h, minute(ts)::DOUBLE AS m, second(ts) + 0.5::DOUBLE AS s FROM events)""")
def _(t):
    two, three, one = F.format_string("%d:%d.5", F.minute("ts"), F.second("ts")), F.format_string("%d:%d:%d.5", F.hour("ts"), F.minute("ts"), F.second("ts")), F.format_string("%d.5", F.second("ts"))
    k = F.col("event_id") % 4
    text = F.when(k == 0, two).when(k == 1, three).when(k == 2, one).otherwise("bad text")
    return t["events"].select("event_id", S.clock_seconds(text).alias("seconds"))


@query("time_5_clip_offsets", "calls", """WITH c AS (SELECT call_id, begin_s AS b, end_s AS e, CASE WHEN call_id % 10 > 0 THEN minute(call_ts) * 60 + second(call_ts) - 7 END AS h FROM calls)
SELECT call_id, CASE WHEN h IS NULL THEN b WHEN b >= h AND b < h + 300 THEN b - h WHEN b > 3600 THEN b % 300 ELSE b END AS begin_s,
       CASE WHEN h IS NULL THEN e WHEN b >= h AND b < h + 300 THEN e - h WHEN b > 3600 THEN e % 300 ELSE e END AS end_s FROM c""")
def _(t):
    minute = F.when(F.col("call_id") % 10 > 0, F.minute("call_ts"))
    b, e = S.clip_offsets(F.col("begin_s"), F.col("end_s"), minute, F.second("call_ts") - 7)
    return t.calls.select("call_id", b.alias("begin_s"), e.alias("end_s"))


@query("time_6_window_timing", "calls", """SELECT call_id, w, greatest(0.0::DOUBLE, w * 9.6::DOUBLE - 0.5) AS start_s, greatest(0.0::DOUBLE, w * 9.6::DOUBLE - 0.5) + 95 * 0.1::DOUBLE + 1.0 AS end_s,
  strftime(clip_start + to_microseconds((w * 9600000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS centre FROM calls, (SELECT unnest(range(3))::INT AS w)""")
def _(t):
    from ..operators.tiling import window_timing

    rows = t.calls.select("call_id", "clip_start", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("w"))
    start, end, at = window_timing(F.col("clip_start"), F.col("w") * 9.6, F.lit(96), 1.0, 0.1)
    return rows.select("call_id", "w", start.alias("start_s"), end.alias("end_s"), F.date_format(at, _TS).alias("centre"))


_PATHS = "CASE event_id % 4 WHEN 0 THEN 'lib/Calls_20HZ.csv' WHEN 1 THEN '20hz/b_40Hz.csv' WHEN 2 THEN 'x/other.csv' END"


@query("str_1_library_class", "", f"""SELECT event_id, CASE WHEN p IS NULL THEN 'unknown' WHEN contains(f, '20hz') THEN '20Hz' WHEN contains(f, '40hz') THEN '40Hz' ELSE 'other' END AS library
FROM (SELECT event_id, p, lower(split_part(p, '/', -1)) AS f FROM (SELECT event_id, {_PATHS} AS p FROM events))""")
def _(t):
    return t["events"].select("event_id", S.library_class(F.expr(_PATHS)).alias("library"))


@query("str_2_device_code", "calls", "SELECT call_id, CASE WHEN call_id % 9 = 0 THEN 'UNKNOWN' ELSE split_part(clip_id, '_', 1) END AS device FROM calls")
def _(t):
    return t.calls.select("call_id", S.device_code(F.when(F.col("call_id") % 9 > 0, F.col("clip_id"))).alias("device"))


@query("str_3_safe_call_id", "calls", """SELECT call_id, replace(clip_id, '.wav', '') || '_' || printf('%.1f', b) || 's_' || printf('%.1f', b + 1.5::DOUBLE) || 's' AS safe_id
FROM (SELECT call_id, clip_id, floor(begin_s) + 0.3::DOUBLE AS b FROM calls)""")
def _(t):
    b = F.floor("begin_s") + F.lit(0.3)
    return t.calls.select("call_id", S.safe_call_id(F.col("clip_id"), b, b + F.lit(1.5)).alias("safe_id"))


@query("str_4_window_ids", "calls", """SELECT call_id, clip_id || '_w' || lpad((call_id % 40)::VARCHAR, 2, '0') AS w, clip_id || '_neg_' || (call_id % 40)::VARCHAR AS neg,
  clip_id || '_seg' || lpad((call_id % 40)::VARCHAR, 3, '0') AS seg, clip_id || '_win' || (call_id % 40)::VARCHAR AS win FROM calls""")
def _(t):
    forms = {"w": "%s_w%02d", "neg": "%s_neg_%d", "seg": "%s_seg%03d", "win": "%s_win%d"}
    return t.calls.select("call_id", *[F.format_string(f, "clip_id", F.col("call_id") % 40).alias(n) for n, f in forms.items()])


@query("str_5_base_id", "calls", "SELECT call_id, clip_id || CASE WHEN call_id % 3 = 0 THEN '_win1' ELSE '' END AS base FROM calls")
def _(t):
    tail = F.when(F.col("call_id") % 3 == 0, "_win1_win22").when(F.col("call_id") % 3 == 1, "_win7").otherwise("")
    return t.calls.select("call_id", S.base_id(F.concat("clip_id", tail)).alias("base"))


@query("str_6_spectrogram_name", "calls", r"""WITH n AS (SELECT call_id, CASE call_id % 3 WHEN 0 THEN stem || '_104.8s_' || (call_id % 50)::VARCHAR || '.5s_40Hz_custom.mat'
WHEN 1 THEN stem || ',104.8s,' || (call_id % 50)::VARCHAR || '.5s,_40Hz.mat' ELSE stem || '_plain.mat' END AS name
  FROM (SELECT call_id, replace(clip_id, '.wav', '') AS stem FROM calls))
SELECT call_id, CASE call_id % 3 WHEN 2 THEN replace(name, '.mat', '') ELSE regexp_extract(name, '^(.+?)[_,]([0-9.]+)s[_,]([0-9.]+)s', 1) END AS src,
  CASE WHEN call_id % 3 < 2 THEN 104.8::DOUBLE END AS start_s, CASE WHEN call_id % 3 < 2 THEN call_id % 50 + 0.5::DOUBLE END AS second_s FROM n""")
def _(t):
    stem, k, x = F.replace("clip_id", F.lit(".wav"), F.lit("")), F.col("call_id") % 3, (F.col("call_id") % 50).cast("string")
    name = F.when(k == 0, F.concat(stem, F.lit("_104.8s_"), x, F.lit(".5s_40Hz_custom.mat"))).when(k == 1, F.concat(stem, F.lit(",104.8s,"), x, F.lit(".5s,_40Hz.mat"))).otherwise(F.concat(stem, F.lit("_plain.mat")))
    src, start, second = S.spectrogram_name(name)
    return t.calls.select("call_id", src.alias("src"), start.alias("start_s"), second.alias("second_s"))


@query("str_7_hydrophone", "packed", "SELECT doc_id, coalesce(nullif(regexp_extract(source, 'IC[A-Z0-9]+'), ''), nullif(regexp_extract(source, 'JASCOAMARHYDROPHONE[A-Z0-9]+'), ''), 'Unknown') AS hydrophone FROM packed")
def _(t):
    return t.packed.select("doc_id", S.hydrophone(F.col("source")).alias("hydrophone"))


@query("str_8_millisecond_stamp", "packed", r"SELECT doc_id, coalesce(nullif(regexp_extract(source, '\d{8}T\d{6}\.\d{3}Z'), ''), 'Unknown') AS stamp FROM packed")
def _(t):
    return t.packed.select("doc_id", S.millisecond_stamp(F.col("source")).alias("stamp"))


@query("str_9_neighbour_names", "calls clips", """SELECT clip_id, device_code || '_' || strftime(clip_start - INTERVAL 300 SECOND, '%Y%m%dT%H%M%S.%g') || 'Z.wav' AS previous,
device_code || '_' || strftime(clip_start + INTERVAL 300 SECOND, '%Y%m%dT%H%M%S.%g') || 'Z.wav' AS next
FROM clips""")
def _(t):
    return t.clips.select("clip_id", S.neighbour_name(F.col("device_code"), F.col("clip_start"), -300).alias("previous"), S.neighbour_name(F.col("device_code"), F.col("clip_start"), 300).alias("next"))


@query("str_10_leading_int", "", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 96 ELSE (n_chars % 500)::INT END AS bins FROM documents")
def _(t):
    text = F.when(F.col("doc_id") % 3 == 0, "many bins").otherwise(F.concat((F.col("n_chars") % 500).cast("string"), F.lit(" bins")))
    return t["documents"].select("doc_id", S.leading_int(text, 96).alias("bins"))


@query("str_11_default_paths", "items", """SELECT item_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'given/' || item_id END ELSE 'spectrograms/' || item_id || '.mat' END AS mat_path,
  CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'audio/' || item_id || '.wav' END AS audio_path FROM items""")
def _(t):
    matched = F.col("doc_id") % 2 == 0
    given = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("given/"), "item_id"))
    return t.items.select("item_id", S.default_path(matched, given, "spectrograms", F.col("item_id"), "mat").alias("mat_path"), S.default_path(matched, F.lit(None).cast("string"), "audio", F.col("item_id"), "wav").alias("audio_path"))


@query("str_12_score_duration", "calls", "SELECT call_id, CASE WHEN call_id % 2 = 0 THEN 40.0::DOUBLE ELSE greatest(0.0::DOUBLE, end_s - (begin_s + 20)) END AS duration_s FROM calls")
def _(t):
    return t.calls.select("call_id", S.score_duration(F.when(F.col("call_id") % 2 == 0, 40.0), F.col("begin_s") + 20, F.col("end_s")).alias("duration_s"))


@query("str_13_range_and_provenance", "", """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN (n_chars % 90)::DOUBLE END AS low, CASE WHEN doc_id % 3 < 2 THEN 100.0::DOUBLE END AS high,
  CASE doc_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'download' WHEN 2 THEN 'plot' ELSE 'default' END AS origin FROM documents""")
def _(t):
    low = (F.col("n_chars") % 90).cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), low, F.lit(", 100]"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"min": '), low, F.lit(', "max": 100}')))
    k = F.col("doc_id") % 4
    meta = F.when(k == 0, '{"spectrogram_source": {"type": "x"}, "download": 1}').when(k == 1, '{"download": {"a": 1}}').when(k == 2, '{"plotRes": 3}').otherwise("{}")
    r = S.value_range(text)
    return t["documents"].select("doc_id", r["min"].alias("low"), r["max"].alias("high"), S.provenance(meta).alias("origin"))


@query("flt_1_drop_incomplete", "predictions", "SELECT file_id, confidence, expert_label FROM predictions WHERE expert_label IS NOT NULL")
def _(t):
    return O.drop_incomplete(t.predictions, ["confidence", "expert_label"]).select("file_id", "confidence", "expert_label")


@query("flt_2_select_calls", "calls", "SELECT call_id, clip_id FROM calls WHERE device_code = 'ICDEV1' AND call_ts >= TIMESTAMP '2024-01-05' AND call_ts <= TIMESTAMP '2024-01-20'")
def _(t):
    return O.select_calls(t.calls, "ICDEV1", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("call_id", "clip_id")


@query("flt_3_duration_band", "calls", "SELECT call_id, end_s - begin_s AS duration FROM calls WHERE end_s - begin_s BETWEEN 1.0 AND 30.0")
def _(t):
    return O.duration_band(t.calls).select("call_id", "duration")


@query("flt_4_by_score", "predictions", "SELECT file_id, confidence >= 0.7 AS above FROM predictions WHERE confidence >= 0.7::DOUBLE OR confidence < 0.2::DOUBLE")
def _(t):
    high, low = O.by_score(t.predictions, 0.7), O.by_score(t.predictions, 0.2, above=False)
    return high.select("file_id", F.lit(True).alias("above")).unionByName(low.select("file_id", F.lit(False).alias("above")))


@query("flt_5_by_class_score", "items", "SELECT item_id, 'above' AS side FROM items WHERE coalesce(score_b, 0) >= 0.5 UNION ALL SELECT item_id, 'below' FROM items WHERE coalesce(score_b, 0) < 0.5")
def _(t):
    return O.by_class_score(t.items, "Call > B", 0.5).select("item_id", F.lit("above").alias("side")).unionByName(O.by_class_score(t.items, "Call > B", 0.5, False).select("item_id", F.lit("below").alias("side")))


@query("flt_6_unreviewed", "predictions", "SELECT file_id FROM predictions WHERE expert_label IS NULL")
def _(t):
    return O.unreviewed(t.predictions).select("file_id")


@query("flt_7_unverified", "items", "SELECT item_id FROM items WHERE quality <> 1")
def _(t):
    return O.unverified(t.items).select("item_id")


@query("flt_8_band_cells", "cells", "SELECT spec_id, t_idx, f_idx, power FROM cells WHERE f_idx BETWEEN 5 AND 20")
def _(t):
    return O.band_cells(t.cells, 5, 20).select("spec_id", "t_idx", "f_idx", "power")


@query("flt_9_band_or_all", "cells", "SELECT spec_id, CASE WHEN spec_id % 2 = 0 THEN 11 ELSE 64 END::INT AS bins, count(*) AS cells FROM cells WHERE spec_id % 2 = 1 OR f_idx BETWEEN 10 AND 20 GROUP BY spec_id")
def _(t):
    low = F.when(F.col("spec_id") % 2 == 0, 10.0).otherwise(900.0)
    rows = O.band_rows(F.col("f"), F.col("p"), low, low + 10)
    return t.spectra.select("spec_id", F.size(rows).alias("bins"), F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + F.size(r)).alias("cells"))


@query("flt_10_trim_frames", "cells", "SELECT spec_id, t_idx - 10 AS t_idx, f_idx, power FROM cells WHERE t_idx BETWEEN 10 AND 19")
def _(t):
    return O.trim_frames(t.cells, 10, 19).select("spec_id", "t_idx", "f_idx", "power")


@query("flt_12_spectrogram_assets", "assets", "SELECT asset FROM assets WHERE contains(lower(asset), 'spect')")
def _(t):
    return t.assets.filter(F.lower("asset").contains("spect")).select("asset")


@query("flt_13_drop_null_keys", "predictions", """SELECT file_id, '{"file_id":"' || file_id || '"' || CASE WHEN expert_label IS NULL THEN '' ELSE ',"expert_label":"' || expert_label || '"' END || '}' AS record FROM predictions""")
def _(t):
    return t.predictions.select("file_id", F.to_json(F.struct("file_id", "expert_label")).alias("record"))


@query("flt_14_alias_resolution", "predictions", "SELECT file_id, confidence AS score FROM predictions")
def _(t):
    renamed = t.predictions.withColumnRenamed("confidence", "Confidence")
    return renamed.select("file_id", O.aliased(renamed, ["score", "CONFIDENCE", "p"], "score"))


@query("flt_14_spectrum_kind", "", """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'power' ELSE 'db' END AS spec_kind,
CASE WHEN vec_id % 3 = 0 THEN embedding[1] * 2 ELSE embedding[1] END::DOUBLE AS first FROM embeddings""")
def _(t):
    """Three layouts: power beside decibels, decibels in another case, and a name that says neither."""
    e = t["embeddings"].select("vec_id", "embedding")
    both = e.filter("vec_id % 3 = 0").select("vec_id", F.col("embedding").alias("PdB"), F.transform("embedding", lambda x: x * 2).alias("sxx"))
    parts = [both, e.filter("vec_id % 3 = 1").withColumnRenamed("embedding", "pdb_NORM"), e.filter("vec_id % 3 = 2").withColumnRenamed("embedding", "Spec")]
    one = [p.select("vec_id", *O.spectrum(p)) for p in parts]
    return one[0].unionByName(one[1]).unionByName(one[2]).select("vec_id", "spec_kind", F.get("spectrum", F.lit(0)).cast("double").alias("first"))


@query("ord_1_call_order", "calls", "SELECT call_id, row_number() OVER (ORDER BY call_ts, clip_id, begin_s, call_id) AS place FROM calls")
def _(t):
    from ..operators.ranking import sorted_places

    return sorted_places(t.calls.select("call_id", "call_ts", "clip_id", "begin_s"), ["call_ts", "clip_id", "begin_s", "call_id"]).select("call_id", "place")


@query("ord_2_first_rows", "calls", "SELECT call_id, clip_id FROM calls ORDER BY call_ts, clip_id, begin_s, call_id LIMIT 25")
def _(t):
    return t.calls.orderBy("call_ts", "clip_id", "begin_s", "call_id").limit(25).select("call_id", "clip_id")


@query("ord_3_first_per_class", "calls entries", "SELECT spec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY src_id, spec_id) AS n FROM entries) WHERE n <= 20")
def _(t):
    from ..operators.ranking import top_per_group

    return top_per_group(t.entries, ["label"], ["src_id", "spec_id"], 20).select("spec_id", "label")


@query("ord_4_top_combinations", "packed", "SELECT labels, count(*) AS n FROM (SELECT array_to_string(list_sort(string_split(label_string, ';')), ';') AS labels FROM packed) GROUP BY labels ORDER BY n DESC, labels LIMIT 10")
def _(t):
    labels = F.array_join(F.array_sort(F.split("label_string", ";")), ";")
    return t.packed.groupBy(labels.alias("labels")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "labels").limit(10)


@query("ord_6_examples_per_outcome", "scored", """SELECT model, sample_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY model, outcome ORDER BY sample_id) AS n
  FROM (SELECT *, CASE WHEN score >= 0.5 THEN CASE WHEN y_true = 1 THEN 'tp' ELSE 'fp' END ELSE CASE WHEN y_true = 1 THEN 'fn' ELSE 'tn' END END AS outcome FROM scored)) WHERE n <= 8""")
def _(t):
    from ..operators.metrics import with_outcome
    from ..operators.ranking import top_per_group

    return top_per_group(with_outcome(t.scored), ["model", "outcome"], ["sample_id"], 8).select("model", "sample_id", "outcome")


@query("set_1_union_by_name", "calls", "SELECT call_id, device_code, NULL::VARCHAR AS asset FROM calls WHERE call_type = 'view' UNION ALL SELECT call_id, NULL, clip_id FROM calls WHERE call_type = 'purchase'")
def _(t):
    a = t.calls.filter("call_type = 'view'").select("call_id", "device_code")
    b = t.calls.filter("call_type = 'purchase'").select("call_id", F.col("clip_id").alias("asset"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_4_shared_sources", "calls entries", "SELECT src_id FROM entries WHERE label = 1 INTERSECT SELECT src_id FROM entries WHERE label = 0")
def _(t):
    return t.entries.filter("label = 1").select("src_id").intersect(t.entries.filter("label = 0").select("src_id"))


@query("set_6_distinct_counts", "calls", "SELECT count(DISTINCT clip_id) AS clips, count(DISTINCT device_code) AS devices, count(DISTINCT call_ts) AS times FROM calls")
def _(t):
    return t.calls.agg(F.count_distinct("clip_id").alias("clips"), F.count_distinct("device_code").alias("devices"), F.count_distinct("call_ts").alias("times"))
