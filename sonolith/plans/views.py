"""Deterministic stand-ins for calls, clips, spectra and scores on the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_NAME = "yyyyMMdd'T'HHmmss"


class Tables:
    """Tables and stand-in views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def calls(self) -> DataFrame:
        e = self["events"].withColumn("clip_start", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
        e = e.withColumn("device_code", F.concat(F.lit("ICDEV"), (F.col("user_id") % 4).cast("string")))
        e = e.withColumn("begin_s", F.expr("timestampdiff(MICROSECOND, clip_start, ts)") / F.lit(1e6))
        clip = F.concat("device_code", F.lit("_"), F.date_format("clip_start", _NAME), F.lit(".000Z.wav"))
        return e.select(
            F.col("event_id").alias("call_id"), clip.alias("clip_id"), "device_code", F.col("ts").alias("call_ts"), "clip_start",
            "begin_s", (F.col("begin_s") + 1 + F.col("value") % 40).alias("end_s"), F.col("event_type").alias("call_type"),
        )

    @cached_property
    def clips(self) -> DataFrame:
        c = self.calls.select("clip_id", "device_code", "clip_start").distinct()
        return c.withColumn("fs", F.lit(64)).withColumn("length_s", F.lit(3600.0))

    @cached_property
    def assets(self) -> DataFrame:
        e = self["events"].filter("event_type = 'view'").withColumn("device_code", F.concat(F.lit("ICDEV"), (F.col("user_id") % 4).cast("string")))
        kind = F.when(F.col("event_id") % 2 == 0, "_Spect_").otherwise("_audio_")
        name = F.concat("device_code", F.lit("_"), F.date_format("ts", _NAME), kind, F.col("event_id").cast("string"))
        return e.select(name.alias("asset"), "device_code", F.col("ts").alias("asset_ts"))

    @cached_property
    def frames(self) -> DataFrame:
        """One spectrum per row: 64 powers of frame t_idx of spectrogram spec_id."""
        power = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
        return self["embeddings"].select(F.expr("vec_id div 50").alias("spec_id"), (F.col("vec_id") % 50).cast("int").alias("t_idx"), power.alias("power"), "label")

    @cached_property
    def cells(self) -> DataFrame:
        """Long form of frames: spec_id, t_idx, f_idx, power."""
        return self.frames.select("spec_id", "t_idx", F.posexplode("power").alias("f_idx", "power"))

    @cached_property
    def spectra(self) -> DataFrame:
        """Matrix form: p[f][t] with axes f (0..63) and t."""
        m = self.frames.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("t_idx", "power"))).alias("m"))
        rows = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform("m", lambda r: F.element_at(r["power"], i + 1)))
        return m.select(
            "spec_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double")).alias("f"),
            F.transform("m", lambda r: r["t_idx"].cast("double")).alias("t"), rows.alias("p"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        sample = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        return self["lineitem"].select(
            F.col("l_linestatus").alias("model"), sample.alias("sample_id"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
            (F.col("l_quantity") / 50).alias("score"), (F.col("l_tax") * 10).alias("dist_frac"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """Reviewable items: two class scores, and a verification where quality is known to be 1."""
        d = self["labels"].join(self["documents"], "doc_id")
        outputs = F.array(
            F.struct(F.lit("Call > A").alias("class_hierarchy"), (F.col("n_chars") % 101 / F.lit(100.0)).alias("score")),
            F.struct(F.lit("Call > B").alias("class_hierarchy"), F.when(F.col("n_chars") % 3 > 0, F.col("n_chars") % 53 / F.lit(52.0)).alias("score")),
        )
        rounds = F.when(F.col("quality") == 1, F.array(F.struct(F.lit("2024-01-01T00:00:00Z").alias("verified_at"), F.lit("ann").alias("verified_by"), F.col("toxic").cast("string").alias("label"), F.lit(1).alias("verification_round"))))
        return d.select(F.concat(F.lit("item_"), F.col("doc_id").cast("string")).alias("item_id"), "doc_id", outputs.alias("model_outputs"), rounds.alias("verifications"), "n_chars", "lang", "source")

    @cached_property
    def predictions(self) -> DataFrame:
        """Flat predictions: confidence, and an expert label on every third one."""
        o = self["orders"]
        label = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
        stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
        reviewer = F.when(label.isNotNull(), F.concat(F.lit("r"), (F.col("o_orderkey") % 7).cast("string")))
        return o.select(
            F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_id"), stamp.alias("audio_timestamp"), (F.col("o_totalprice") % 1000 / 1000).alias("confidence"),
            label.alias("expert_label"), reviewer.alias("expert_reviewer"), F.when(label.isNotNull(), stamp).alias("review_timestamp"),
        )

    @cached_property
    def packed(self) -> DataFrame:
        d = self["documents"]
        stamp = F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)"), _NAME)
        device = F.when(F.col("doc_id") % 11 == 0, F.lit("buoy")).otherwise(F.concat(F.lit("IC"), F.upper("lang"), (F.col("doc_id") % 7).cast("string")))
        tail = F.when(F.col("doc_id") % 13 == 0, F.lit("raw")).otherwise(F.concat(stamp, F.lit(".128Z")))
        label = F.when(F.col("doc_id") % 5 == 0, F.lit("normal")).when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(F.concat_ws(";", "source", "lang"))
        return d.select("doc_id", F.concat_ws("_", device, tail).alias("source"), label.alias("label_string"), F.col("n_chars"))

    @cached_property
    def entries(self) -> DataFrame:
        c = self.calls
        return c.select(F.col("call_id").alias("spec_id"), F.regexp_replace("clip_id", r"\.wav$", "").alias("src_id"), "begin_s", "end_s", (F.col("call_type") == "purchase").cast("int").alias("label"))


VIEWS = {
    "calls": r"""calls AS (
  SELECT *, begin_s + 1 + value % 40 AS end_s FROM (
    SELECT event_id AS call_id, 'ICDEV' || (user_id % 4)::VARCHAR || '_' || strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%S') || '.000Z.wav' AS clip_id,
           'ICDEV' || (user_id % 4)::VARCHAR AS device_code, ts AS call_ts, date_trunc('hour', ts) AS clip_start,
           date_diff('microsecond', date_trunc('hour', ts), ts) / 1e6::DOUBLE AS begin_s, event_type AS call_type, value FROM events))""",
    "clips": "clips AS (SELECT DISTINCT clip_id, device_code, clip_start, 64 AS fs, 3600.0::DOUBLE AS length_s FROM calls)",
    "assets": r"""assets AS (
  SELECT 'ICDEV' || (user_id % 4)::VARCHAR || '_' || strftime(ts, '%Y%m%dT%H%M%S') || CASE WHEN event_id % 2 = 0 THEN '_Spect_' ELSE '_audio_' END || event_id::VARCHAR AS asset,
         'ICDEV' || (user_id % 4)::VARCHAR AS device_code, ts AS asset_ts FROM events WHERE event_type = 'view')""",
    "cells": """cells AS (
  SELECT vec_id // 50 AS spec_id, (vec_id % 50)::INT AS t_idx, i::INT AS f_idx, embedding[i + 1]::DOUBLE * embedding[i + 1]::DOUBLE AS power, label
  FROM embeddings, (SELECT unnest(range(64)) AS i))""",
    "scored": """scored AS (
  SELECT l_linestatus AS model, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS sample_id, (l_returnflag = 'R')::INT AS y_true,
         l_quantity / 50 AS score, l_tax * 10 AS dist_frac FROM lineitem)""",
    "items": """items AS (
  SELECT 'item_' || doc_id::VARCHAR AS item_id, doc_id, n_chars % 101 / 100.0::DOUBLE AS score_a,
         CASE WHEN n_chars % 3 > 0 THEN n_chars % 53 / 52.0::DOUBLE END AS score_b, quality, toxic, n_chars, lang, source
  FROM labels JOIN documents USING (doc_id))""",
    "predictions": r"""predictions AS (
  SELECT 'f' || o_orderkey::VARCHAR AS file_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS audio_timestamp,
         o_totalprice % 1000 / 1000 AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS expert_label,
         CASE WHEN o_orderkey % 3 = 0 THEN 'r' || (o_orderkey % 7)::VARCHAR END AS expert_reviewer,
         CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS review_timestamp FROM orders)""",
    "packed": r"""packed AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'buoy' ELSE 'IC' || upper(lang) || (doc_id % 7)::VARCHAR END || '_' ||
         CASE WHEN doc_id % 13 = 0 THEN 'raw' ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y%m%dT%H%M%S') || '.128Z' END AS source,
         CASE WHEN doc_id % 5 = 0 THEN 'normal' WHEN doc_id % 17 = 0 THEN '' ELSE concat_ws(';', source, lang) END AS label_string, n_chars FROM documents)""",
    "entries": """entries AS (
  SELECT call_id AS spec_id, regexp_replace(clip_id, '\\.wav$', '') AS src_id, begin_s, end_s, (call_type = 'purchase')::INT AS label FROM calls)""".replace("\\\\", "\\"),
}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query of Tables under a name, with its SQL over the named views (and further CTEs in sql)."""

    def add(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ctes = ", ".join(VIEWS[v] for v in views.split())
            body = sql.strip()
            if ctes:
                word = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
                body = f"{word}{ctes}{', ' + body[len(word) :] if body.startswith(word) else ' ' + body}"
            ORACLE[name] = body
        return f

    return add
