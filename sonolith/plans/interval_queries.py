"""Queries on intervals, neighbours, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as O
from ..operators import intervals as I
from ..operators import splits as P
from ..operators import tiling as T
from ..operators.ranking import numbered
from .views import query

_ISLANDS = """m AS (SELECT clip_id, greatest(0.0::DOUBLE, begin_s - 2) AS s, least(3600.0::DOUBLE, end_s + 2) AS e FROM calls),
n AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM m),
o AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n),
islands AS (SELECT clip_id, island::BIGINT AS island, min(s) AS s, max(e) AS e FROM o GROUP BY clip_id, island)"""
_GAPS = _ISLANDS + """, marks AS (SELECT clip_id, s, e FROM islands UNION ALL SELECT clip_id, length_s, length_s FROM clips),
g0 AS (SELECT clip_id, coalesce(lag(e) OVER (PARTITION BY clip_id ORDER BY s, e), 0) AS s, s AS e FROM marks),
gaps AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY s)::INT AS gap, s AS start, e AS "end" FROM g0 WHERE e > s)"""
_SPLIT = "CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END"
_RATIO = f"sp AS (SELECT *, {_SPLIT} AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('split|' || spec_id::VARCHAR)) AS r, count(*) OVER (PARTITION BY label) AS n FROM entries))"
_CLUSTER = """c0 AS (SELECT *, (begin_s + end_s) / 2 AS centre FROM entries),
c1 AS (SELECT *, CASE WHEN centre - lag(centre) OVER (PARTITION BY src_id ORDER BY centre, spec_id) < 60 THEN 0 ELSE 1 END AS new FROM c0),
cl AS (SELECT *, (sum(new) OVER (PARTITION BY src_id ORDER BY centre, spec_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM c1)"""
_U = "('0x' || substr({}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query("win_1_merge_intervals", "calls", f'WITH {_ISLANDS} SELECT clip_id, island, s AS start, e AS "end" FROM islands')
def _(t):
    return I.merged_intervals(t.calls, 2.0, 3600.0)


@query("win_2_free_gaps", "calls clips", f"WITH {_GAPS} SELECT * FROM gaps")
def _(t):
    return I.free_gaps(t.clips, t.calls, 2.0)


@query("flt_11_wide_gaps", "calls clips", f'WITH {_GAPS} SELECT clip_id, gap FROM gaps WHERE "end" - start >= 40')
def _(t):
    return I.free_gaps(t.clips, t.calls, 2.0).filter(F.col("end") - F.col("start") >= 40).select("clip_id", "gap")


_NEGATIVES = _GAPS + """,
wide AS (SELECT clip_id, gap, start, "end", sum("end" - start) OVER (PARTITION BY clip_id ORDER BY gap ROWS UNBOUNDED PRECEDING) AS upto FROM gaps WHERE "end" - start >= 40),
total AS (SELECT clip_id, max(upto) AS total FROM wide GROUP BY clip_id),
kk AS (SELECT clip_id, count(*) AS k FROM calls GROUP BY clip_id),
att AS (SELECT clip_id, k, total, unnest(range(1, 5 * k + 1)) AS i FROM kk JOIN total USING (clip_id)),
u AS (SELECT *, ('0x' || substr(md5('neg|' || clip_id || '|' || i::VARCHAR || '|gap'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u1,
             ('0x' || substr(md5('neg|' || clip_id || '|' || i::VARCHAR || '|start'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u2 FROM att),
pick AS (SELECT u.clip_id, k, i, u2, arg_min(struct_pack(s := start, e := "end"), upto) AS g FROM u JOIN wide ON wide.clip_id = u.clip_id AND upto > u1 * total GROUP BY ALL),
draws AS (SELECT clip_id, any_value(k) AS k, list(g.s + u2 * (g.e - 40 - g.s) ORDER BY i) AS s FROM pick GROUP BY clip_id),
tried AS (
  SELECT clip_id, k, s, 1 AS i, []::DOUBLE[] AS held FROM draws
  UNION ALL
  SELECT clip_id, k, s, i + 1, CASE WHEN len(held) < k AND len(list_filter(held, lambda x: 40 - abs(x - s[i]) > 0.2::DOUBLE * 40)) = 0 THEN list_append(held, s[i]) ELSE held END FROM tried WHERE i <= len(s)),
kept AS (SELECT clip_id, unnest(held) AS start FROM tried WHERE i = len(s) + 1),
negatives AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start)::INT AS n, start, start + 40 AS "end" FROM kept)"""


@query("smp_5_negative_windows", "calls clips", f"WITH RECURSIVE {_NEGATIVES} SELECT * FROM negatives")
def _(t):
    return I.negative_windows(t.clips, t.calls)


@query("set_3_labelled_windows", "calls clips", f"""WITH RECURSIVE {_NEGATIVES}
SELECT clip_id, begin_s AS start, end_s AS "end", 1 AS label FROM calls UNION ALL SELECT clip_id, start, "end", 0 FROM negatives""")
def _(t):
    return I.labelled_windows(t.calls, I.negative_windows(t.clips, t.calls))


@query("win_7_clips_around", "calls clips", """SELECT clip_id, lag(clip_id) OVER w AS previous, lead(clip_id) OVER w AS next
FROM clips WINDOW w AS (PARTITION BY device_code ORDER BY clip_start, clip_id)""")
def _(t):
    return I.clips_around(t.clips).select("clip_id", "previous", "next")


@query("win_9_gap_to_next", "calls", "SELECT call_id, lead(begin_s) OVER (PARTITION BY clip_id ORDER BY begin_s, call_id) - begin_s AS gap FROM calls")
def _(t):
    return I.gaps_to_next(t.calls, "clip_id", "begin_s").select("call_id", "gap")


@query("win_10_gap_clusters", "calls entries", f"WITH {_CLUSTER} SELECT spec_id, src_id, cluster FROM cl")
def _(t):
    return I.gap_clusters(t.entries, 60.0).select("spec_id", "src_id", "cluster")


@query("join_1_arithmetic_neighbours", "calls clips", """SELECT c.clip_id, p.clip_id AS previous, n.clip_id AS next FROM clips c LEFT JOIN clips p ON p.device_code = c.device_code AND p.clip_start = c.clip_start - INTERVAL 3600 SECOND
LEFT JOIN clips n ON n.device_code = c.device_code AND n.clip_start = c.clip_start + INTERVAL 3600 SECOND""")
def _(t):
    return I.arithmetic_neighbours(t.clips, 3600).select("clip_id", "previous", "next")


@query("join_2_neighbour_with_tolerance", "calls clips assets", """SELECT clip_id, asset FROM (SELECT clip_id, asset, row_number() OVER (PARTITION BY clip_id ORDER BY asset_ts, asset) AS n
FROM clips JOIN assets a USING (device_code) WHERE asset_ts BETWEEN clip_start + INTERVAL 3600 SECOND - INTERVAL 120 SECOND AND clip_start + INTERVAL 3600 SECOND + INTERVAL 120 SECOND) WHERE n = 1""")
def _(t):
    due = t.clips.withColumn("due", F.expr("timestampadd(SECOND, 3600, clip_start)"))
    return I.nearest_within(due, t.assets, "device_code", "due", "asset_ts", 120, ["asset_ts", "asset"], ["clip_id"]).select("clip_id", "asset")


def _signals(t):
    e = t["embeddings"]
    rate = F.when(F.col("vec_id") % 7 == 0, 32).otherwise(64)
    return e.select("vec_id", F.col("label").cast("string").alias("device_code"), F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"), rate.alias("fs"))


_SIGNALS = "sig AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x, CASE WHEN vec_id % 7 = 0 THEN 32 ELSE 64 END AS fs FROM embeddings)"


@query("join_3_stitch_by_order", "", f"""WITH {_SIGNALS},
s AS (SELECT *, lag(fs) OVER w AS pf, lead(fs) OVER w AS nf, lag(x[57:64]) OVER w AS tail, lead(x[1:8]) OVER w AS head FROM sig WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
j AS (SELECT vec_id, list_concat(CASE WHEN pf = fs THEN tail ELSE [] END, x, CASE WHEN nf = fs THEN head ELSE [] END) AS y FROM s)
SELECT vec_id, len(y)::INT AS n, y[1] AS first, y[len(y)] AS last, y[9] AS ninth FROM j""")
def _(t):
    y = F.col("stitched")
    return I.stitched(_signals(t), 8).select("vec_id", F.size(y).alias("n"), F.element_at(y, 1).alias("first"), F.element_at(y, -1).alias("last"), F.element_at(y, 9).alias("ninth"))


@query("join_4_assets_of_calls", "calls assets", """SELECT asset, min(call_id) AS call_id FROM (SELECT call_id, asset, row_number() OVER (PARTITION BY call_id ORDER BY asset_ts, asset) AS n
FROM (SELECT * FROM calls WHERE call_type <> 'view') c JOIN assets a ON a.device_code = c.device_code AND contains(lower(asset), 'spect')
AND asset_ts BETWEEN call_ts - INTERVAL 900 SECOND AND call_ts + INTERVAL 900 SECOND) WHERE n <= 2 GROUP BY asset""")
def _(t):
    return I.assets_of_calls(t.calls.filter("call_type <> 'view'"), t.assets)


@query("ord_5_two_assets", "calls assets", """SELECT call_id, asset, place FROM (
SELECT call_id, asset, row_number() OVER (PARTITION BY call_id ORDER BY asset_ts, asset)::INT AS place FROM calls c JOIN assets a
ON a.device_code = c.device_code AND contains(lower(asset), 'spect') AND asset_ts BETWEEN call_ts - INTERVAL 900 SECOND AND call_ts + INTERVAL 900 SECOND
WHERE call_type <> 'view') WHERE place <= 2""")
def _(t):
    return I.assets_per_call(t.calls.filter("call_type <> 'view'"), t.assets)


@query("join_8_split_join_back", "calls entries", f"""WITH so AS (SELECT src_id, {_SPLIT} AS split FROM (SELECT src_id, row_number() OVER (ORDER BY md5('source|' || src_id)) AS r, count(*) OVER () AS n
FROM (SELECT DISTINCT src_id FROM entries)))
SELECT spec_id, split FROM entries JOIN so USING (src_id)""")
def _(t):
    return P.source_split(t.entries).select("spec_id", "split")


@query("join_11_uncovered_windows", "calls clips", """SELECT clip_id, i::INT AS i FROM clips, (SELECT unnest(range(90)) AS i)
WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.clip_id = clips.clip_id AND c.begin_s - 2 < i * 40.0 + 40 AND c.end_s + 2 > i * 40.0)""")
def _(t):
    w = t.clips.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(89))).alias("i")).withColumn("start", F.col("i") * 40.0).withColumn("end", F.col("start") + 40)
    return I.uncovered(w, t.calls, 2.0).select("clip_id", "i")


@query("join_12_overlapping_pairs", "calls", """SELECT a.clip_id, a.call_id AS a, b.call_id AS b, least(a.end_s, b.end_s) - greatest(a.begin_s, b.begin_s) AS overlap_s FROM calls a
JOIN calls b ON a.clip_id = b.clip_id AND a.call_id < b.call_id
WHERE least(a.end_s, b.end_s) - greatest(a.begin_s, b.begin_s) > 8""")
def _(t):
    return I.overlapping_pairs(t.calls, "clip_id", "call_id", "begin_s", "end_s", 8.0)


@query("join_14_leaked_sources", "calls entries", f"""WITH {_RATIO}, ds AS (SELECT DISTINCT src_id, split FROM sp) SELECT a.split AS a, b.split AS b, count(DISTINCT src_id) AS sources
FROM ds a JOIN ds b USING (src_id) WHERE a.split < b.split GROUP BY ALL""")
def _(t):
    return P.leaked_sources(P.ratio_split(t.entries))


@query("join_15_gap_violations", "calls entries", f"""WITH {_RATIO} SELECT a.src_id, a.spec_id, b.spec_id AS other FROM sp a JOIN sp b ON a.src_id = b.src_id AND a.spec_id < b.spec_id AND a.split <> b.split
AND abs((a.begin_s + a.end_s) / 2 - (b.begin_s + b.end_s) / 2) < 60""")
def _(t):
    return P.gap_violations(P.ratio_split(t.entries), 60.0)


@query("smp_1_stratified_sample", "calls", """WITH k AS (SELECT greatest(1, 300 // count(*)) AS each FROM (SELECT DISTINCT device_code, call_type FROM calls)),
r AS (SELECT call_id, md5('sample|' || call_id::VARCHAR) AS h, row_number() OVER (PARTITION BY device_code, call_type ORDER BY md5('sample|' || call_id::VARCHAR)) AS n FROM calls)
SELECT call_id FROM (SELECT call_id, row_number() OVER (ORDER BY (n > each), h) AS place FROM r, k) WHERE place <= 300""")
def _(t):
    return P.stratified_sample(t.calls, 300, ["device_code", "call_type"]).select("call_id")


_SAMPLED = """r AS (SELECT call_id, md5('sample|' || call_id::VARCHAR) AS h,
      row_number() OVER (PARTITION BY device_code, call_type ORDER BY md5('sample|' || call_id::VARCHAR)) AS n FROM calls)"""


@query("join_10_not_sampled", "calls", f"WITH {_SAMPLED} SELECT call_id FROM r WHERE n > 15")
def _(t):
    return P.not_sampled(t.calls, P.stratum_firsts(t.calls, 15, ["device_code", "call_type"])).select("call_id")


@query("set_2_sample_and_extra", "calls", f"""WITH {_SAMPLED}, k AS (SELECT greatest(1, 310 // count(*)) AS each FROM (SELECT DISTINCT device_code, call_type FROM calls))
SELECT call_id, round FROM (SELECT call_id, (n > each)::INT AS round, row_number() OVER (ORDER BY (n > each), h) AS place FROM r, k) WHERE place <= 310""")
def _(t):
    return P.sample_rounds(t.calls, 310, ["device_code", "call_type"]).select("call_id", "round")


@query("win_4_class_ranks", "calls entries", """SELECT spec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('split|' || spec_id::VARCHAR)) AS rank,
count(*) OVER (PARTITION BY label) AS size FROM entries""")
def _(t):
    return P.class_ranks(t.entries).select("spec_id", "label", "rank", "size")


@query("smp_2_ratio_split", "calls entries", f"WITH {_RATIO} SELECT spec_id, label, split FROM sp")
def _(t):
    return P.ratio_split(t.entries).select("spec_id", "label", "split")


@query("smp_3_source_split", "calls entries", f"""WITH so AS (SELECT src_id, {_SPLIT} AS split FROM (SELECT src_id, row_number() OVER (ORDER BY md5('source|' || src_id)) AS r, count(*) OVER () AS n
FROM (SELECT DISTINCT src_id FROM entries)))
SELECT split, count(DISTINCT src_id) AS sources, count(*) AS entries FROM entries JOIN so USING (src_id) GROUP BY split""")
def _(t):
    return P.source_split(t.entries).groupBy("split").agg(F.count_distinct("src_id").alias("sources"), F.count("*").alias("entries"))


@query("smp_4_time_split", "calls entries", f"""WITH {_CLUSTER}, z AS (SELECT src_id, cluster, count(*) AS size, min(label) + max(label) AS own, md5('time|' || src_id || '|' || cluster::VARCHAR) AS h FROM cl GROUP BY src_id, cluster),
z1 AS (SELECT *, CASE WHEN (SELECT min(c) FROM (SELECT count(*) AS c FROM z GROUP BY own)) < 3 THEN 0 ELSE own END AS kind FROM z),
y AS (SELECT *, row_number() OVER w AS r, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY kind) AS n, count(*) OVER (PARTITION BY kind) AS c FROM z1 WINDOW w AS (PARTITION BY kind ORDER BY h, src_id, cluster)),
x AS (SELECT *, least(count(*) FILTER (WHERE before < 0.7::DOUBLE * n) OVER (PARTITION BY kind), greatest(1, c - 2)) AS t FROM y),
v AS (SELECT src_id, cluster, CASE WHEN r <= t THEN 'train' WHEN r = c THEN CASE WHEN c > 2 THEN 'test' ELSE 'val' END WHEN r = t + 1 OR before < (0.7::DOUBLE + 0.15::DOUBLE) * n THEN 'val' ELSE 'test' END AS split FROM x)
SELECT spec_id, cluster, split FROM cl JOIN v USING (src_id, cluster)""")
def _(t):
    return P.time_split(t.entries, 60.0).select("spec_id", "cluster", "split")


@query("smp_6_balanced_draws", "calls entries", f"""WITH r AS (SELECT spec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('draw|' || spec_id::VARCHAR)) AS rank, count(*) OVER (PARTITION BY label) AS size FROM entries),
z AS (SELECT label, max(size) AS size, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS classes FROM r GROUP BY label),
d AS (SELECT draw, {_U.format("md5('drawc|' || draw::VARCHAR)")} AS u, {_U.format("md5('drawr|' || draw::VARCHAR)")} AS v FROM (SELECT unnest(range((SELECT 2 * max(size) FROM z))) AS draw))
SELECT draw, r.label, spec_id FROM d JOIN z ON z.i = floor(u * classes) JOIN r ON r.label = z.label AND r.rank = floor(v * z.size) + 1""")
def _(t):
    return P.balanced_draws(t.entries)


@query("agg_1_split_counts", "calls entries", f"WITH {_RATIO} SELECT split, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg, count(*) AS total FROM sp GROUP BY split")
def _(t):
    return P.split_counts(P.ratio_split(t.entries))


@query("arr_1_context_windows", "calls", "SELECT call_id, begin_s - (40 - (end_s - begin_s)) / 2 AS start_s, end_s + (40 - (end_s - begin_s)) / 2 AS stop_s FROM calls")
def _(t):
    pad = (40 - (F.col("end_s") - F.col("begin_s"))) / 2
    return t.calls.select("call_id", (F.col("begin_s") - pad).alias("start_s"), (F.col("end_s") + pad).alias("stop_s"))


_TOTAL = "(SELECT doc_id, (n_chars % 4000 + 1)::INT AS t FROM documents)"


@query("arr_2_even_tiling", "", f"""SELECT doc_id, i::INT AS i, round_even(i * step, 0)::INT AS start
FROM (SELECT doc_id, t, greatest(1, ceil(t / 96))::INT AS n, CASE WHEN t > 96 THEN (t - 96) / (ceil(t / 96) - 1) ELSE 0 END AS step FROM {_TOTAL}), unnest(range(n)) AS u(i)""")
def _(t):
    total = (F.col("n_chars") % 4000 + 1).cast("int")
    return t["documents"].select("doc_id", F.posexplode(T.even_starts(total, F.lit(96))).alias("i", "start"))


@query("arr_3_sliding_windows", "", f"""SELECT doc_id, i::INT AS i, round_even(i * step, 0)::INT AS start
FROM (SELECT doc_id, t, CASE WHEN t > 96 THEN ceil((t - 96) / 40)::INT + 1 ELSE 1 END AS n, CASE WHEN t > 96 THEN (t - 96) / ceil((t - 96) / 40) ELSE 0 END AS step FROM {_TOTAL}), unnest(range(n)) AS u(i)""")
def _(t):
    total = (F.col("n_chars") % 4000 + 1).cast("int")
    return t["documents"].select("doc_id", F.posexplode(T.sliding_starts(total, F.lit(96), F.lit(40))).alias("i", "start"))


@query("arr_4_segments", "", f"""WITH a AS (SELECT doc_id, t::DOUBLE AS d, ceil(t / 40.0::DOUBLE) AS n FROM {_TOTAL}), b AS (SELECT *, 40 - CASE WHEN n > 1 THEN greatest((n * 40 - d) / (n - 1), 2.0::DOUBLE) ELSE 2.0 END AS step FROM a)
SELECT doc_id, i::INT AS i, i * step AS start FROM (SELECT *, CASE WHEN d <= 40 THEN 1 ELSE least(floor((d + 0.001::DOUBLE - 40) / step)::INT, 100) + 1 END AS m FROM b), unnest(range(m)) AS u(i)""")
def _(t):
    total = (F.col("n_chars") % 4000 + 1).cast("double")
    return t["documents"].select("doc_id", F.posexplode(T.segment_starts(total, F.lit(40.0), F.lit(2.0))).alias("i", "start"))


@query("set_5_expected_windows", "", f"""SELECT doc_id FROM {_TOTAL} WHERE t > 96 AND doc_id % 3 = 0""")
def _(t):
    starts = T.even_starts((F.col("n_chars") % 4000 + 1).cast("int"), F.lit(96))
    seen = F.when(F.col("doc_id") % 3 == 0, F.slice(starts, F.lit(1), F.greatest(F.lit(1), F.size(starts) - 1))).otherwise(starts)
    return t["documents"].filter(F.size(F.array_except(starts, seen)) > 0).select("doc_id")


@query("set_7_coverage", "", f"SELECT doc_id, t AS covered FROM {_TOTAL}")
def _(t):
    total = (F.col("n_chars") % 4000 + 1).cast("int")
    return t["documents"].select("doc_id", T.covered(T.even_starts(total, F.lit(96)), 96, total).cast("int").alias("covered"))


@query("arr_5_sample_slice", "", f"WITH {_SIGNALS} SELECT vec_id, len(y)::INT AS n, y[1] AS first, y[len(y)] AS last FROM (SELECT vec_id, x[(vec_id % 60) + 1:least(64, vec_id % 60 + 12)] AS y FROM sig)")
def _(t):
    k = F.col("vec_id") % 60
    y = I.sample_slice(F.col("samples"), k / F.lit(64.0), (k + 12) / F.lit(64.0), F.lit(64))
    return _signals(t).select("vec_id", F.size(y).alias("n"), F.element_at(y, 1).alias("first"), F.element_at(y, -1).alias("last"))


@query("arr_6_window_samples", "", f"""WITH {_SIGNALS}, n AS (SELECT a.vec_id, a.x, b.x AS p, c.x AS f, (a.vec_id % 80) - 20 + (a.vec_id % 4) * 0.25::DOUBLE AS s
FROM sig a LEFT JOIN sig b ON b.vec_id = a.vec_id - 1 AND a.vec_id % 5 > 0 LEFT JOIN sig c ON c.vec_id = a.vec_id + 1 AND a.vec_id % 5 < 4),
m AS (SELECT *, least(trunc(greatest(0, s)), 63)::INT AS a, trunc(least(64, s + 24))::INT AS e FROM n),
y AS (SELECT vec_id, list_concat(
  CASE WHEN s >= 0 THEN [] WHEN p IS NULL THEN list_transform(range(trunc(-s)::INT), lambda i: 0.0::DOUBLE) ELSE p[trunc(64 + s)::INT + 1:64] END,
  CASE WHEN e > a THEN x[a + 1:e] ELSE [] END,
  CASE WHEN s + 24 <= 64 THEN [] WHEN f IS NULL THEN list_transform(range(trunc(s - 40)::INT), lambda i: 0.0::DOUBLE) ELSE f[1:trunc(s - 40)::INT] END) AS y FROM m)
SELECT vec_id, i::INT AS i, coalesce(y[i + 1], 0) AS x FROM y, (SELECT unnest(range(24)) AS i)""")
def _(t):
    """Windows that begin at a quarter of a sample, before, inside or behind a recording, with neighbours or without."""
    x = _signals(t).select("vec_id", "samples")
    other = lambda d, name, when: x.select((F.col("vec_id") + d).alias("vec_id"), F.col("samples").alias(name)).filter(when)
    j = x.join(other(1, "previous", "vec_id % 5 > 0"), "vec_id", "left").join(other(-1, "following", "vec_id % 5 < 4"), "vec_id", "left")
    s = F.col("vec_id") % 80 - 20 + (F.col("vec_id") % 4) * F.lit(0.25)
    y = I.window_samples(F.col("previous"), F.col("samples"), F.col("following"), s / F.lit(64.0), (s + 24) / F.lit(64.0), F.lit(64))
    return j.select("vec_id", F.posexplode(y).alias("i", "x"))


@query("win_3_ordinals", "calls", """SELECT call_id, clip_id || '_neg_' || (row_number() OVER (PARTITION BY clip_id ORDER BY begin_s, call_id) - 1)::VARCHAR AS window_id FROM calls""")
def _(t):
    return numbered(t.calls, "clip_id", ["begin_s", "call_id"], "%s_neg_%d", "window_id").select("call_id", "window_id")
