"""Readers of annotation, clip, spectrogram and window catalogues."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.failures import reason
from ..session import materialize
from .recordings import BATCH_BYTES, BATCH_ROWS, columns_of, samples_of, wav_format

ESSENTIAL = ("date (utc)", "begin time (s)", "end time (s)", "clip id")


def _resolved(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(given, at): each given path as the file system writes it, or null where nothing is there. No job runs."""
    rows, conf = [], spark._jsc.hadoopConfiguration()
    for given in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(given)
        fs = path.getFileSystem(conf)
        rows.append((given, fs.makeQualified(path).toUri().toString().rstrip("/") if fs.exists(path) else None))
    return spark.createDataFrame(rows, "given string, at string")


def _annotation_lines(spark: SparkSession, paths: list[str], essential: tuple[str, ...]) -> tuple[DataFrame | None, DataFrame, int]:
    """(lines with source_file, line and place, or None; files with source_file, file, header, fault and place; columns).

    One text scan whatever the number of files; a second reads the first lines. place is an array: where each essential
    column is among a file's fields.
    """
    known = _resolved(spark, paths)
    there = [r["at"] for r in known.collect() if r["at"]]  # one row per given path
    gone = known.filter("at IS NULL").select(F.col("given").alias("source_file"), F.lit(None).cast("string").alias("file"), F.lit("not found").alias("fault"))
    if not there:
        return None, gone, 0
    raw = spark.read.text(there).select(F.col("value").alias("line"), F.regexp_replace("_metadata.file_path", "^(file|hdfs):/+", "$1:/").alias("file"), F.col("_metadata.file_block_start").alias("_from"))
    at = known.filter("at IS NOT NULL").select(F.regexp_replace("at", "^(file|hdfs):/+", "$1:/").alias("at"), "given")
    # a given path is a file, or a folder of files
    whole, folder = (F.broadcast(at.select(F.col("at").alias(f"_at{i}"), F.col("given").alias(f"_given{i}"))) for i in (0, 1))
    raw = raw.join(whole, F.col("file") == F.col("_at0"), "left").join(folder, F.regexp_replace("file", "/[^/]*$", "") == F.col("_at1"), "left")
    raw = raw.select("line", "file", "_from", F.coalesce("_given0", "_given1").alias("source_file"))
    first = raw.filter("_from = 0").withColumn("_id", F.monotonically_increasing_id()).groupBy("source_file", "file").agg(F.min_by("line", "_id").alias("header"))
    first = materialize(first.filter("header IS NOT NULL"), "headers")
    columns = first.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    named = F.transform(_fields(F.col("header"), columns), lambda h: F.lower(F.trim(F.regexp_replace(F.coalesce(h, F.lit("")), "^\ufeff", ""))))
    place = lambda e: F.get(F.filter(F.transform(named, lambda h, i: F.when(h.contains(e), i)), lambda i: i.isNotNull()), F.lit(0))
    files = first.withColumn("place", F.array(*map(place, essential)))
    lacks = F.filter(F.transform("place", lambda i, n: F.when(i.isNull(), F.element_at(F.array(*map(F.lit, essential)), n + 1))), lambda e: e.isNotNull())
    files = files.withColumn("fault", F.when(F.size(lacks) > 0, F.concat(F.lit("missing columns: "), F.concat_ws(", ", lacks))))
    usable = files.filter("fault IS NULL").select("file", "header", "place")
    lines = raw.drop("_from").join(F.broadcast(usable), "file").filter((F.col("line") != F.col("header")) & (F.trim("line") != ""))
    empty = at.select("given").join(first.select(F.col("source_file").alias("given")), "given", "left_anti").select(F.col("given").alias("source_file"), F.lit(None).cast("string").alias("file"), F.lit("empty").alias("fault"))
    faults = files.filter("fault IS NOT NULL").select("source_file", "file", "fault").unionByName(gone).unionByName(empty)
    return lines, faults, columns


def _fields(line: Column, columns: int) -> Column:
    """Fields of a CSV line, quoted ones too, as an array."""
    made = F.from_csv(line, ", ".join(f"c{i} string" for i in range(columns)), {"escape": '"'})
    return F.array(*[made[f"c{i}"] for i in range(columns)])


def load_annotations(spark: SparkSession, paths: list[str], essential: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """Annotation files (CSV with header), or folders of them, as one table with the source file and its class.

    Headers are trimmed and lower-cased; an essential column is the first header that contains its name, wherever it
    stands in a file. A file that lacks one, is empty or isn't there is skipped (``annotation_faults`` tells why); no usable file
    is an error. All files are one scan, whose fields are cut by the header of their file.
    """
    lines, _, columns = _annotation_lines(spark, paths, essential)
    if lines is None or lines.isEmpty():
        raise ValueError("no usable annotation file")
    cut = lines.withColumn("_f", _fields(F.col("line"), columns))
    field = {e: F.get("_f", F.get("place", F.lit(i))) for i, e in enumerate(essential)}
    clip, number = field["clip id"], lambda e: S.clock_seconds(field[e])
    return cut.select(
        clip.alias("clip_id"), S.device_code(clip).alias("device_code"), S.iso_timestamp(field["date (utc)"]).alias("call_ts"),
        number("begin time (s)").alias("begin_s"), number("end time (s)").alias("end_s"), S.library_class(F.col("source_file")).alias("call_type"), "source_file",
    )


def annotation_faults(spark: SparkSession, paths: list[str], essential: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """(source_file, file, fault): what load_annotations() skips, and why; file is null where the path as a whole is at fault."""
    return _annotation_lines(spark, paths, essential)[1].select("source_file", "file", "fault")


def _decoded(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples of the first channel in [-1, 1)) of a WAV file."""
    form = wav_format(io.BytesIO(content), len(content))
    return form.rate, samples_of(content[form.at : form.at + form.frames * form.channels * form.width], form.width, form.channels)


def load_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Every WAV recording below a folder: clip_id, fs, n_samples, samples in [-1, 1) of the first channel, and error.

    A file that can't be decoded gives a row with the reason as error and nothing else, and doesn't end the job. Arrow
    batches end at spark.sql.execution.arrow.maxBytesPerBatch, so a task holds few recordings at a time. Spark's scan gives a
    task some 32 short files at most; up to sixteen such tasks are one here.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py().rsplit("/", 1)[-1]
                try:
                    rate, x = _decoded(content.as_py())
                    rows.append({"clip_id": name, "fs": rate, "n_samples": len(x), "samples": x})
                    held += x.nbytes
                except (ValueError, struct.error) as e:
                    rows.append({"clip_id": name, "error": reason(e)})
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield columns_of(rows, schema)
                    rows, held = [], 0
            if rows:
                yield columns_of(rows, schema)

    schema = pa.schema([("clip_id", pa.string()), ("fs", pa.int32()), ("n_samples", pa.int64()), ("samples", pa.list_(pa.float64())), ("error", pa.string())])
    tasks = files.rdd.getNumPartitions()
    few = min(tasks, max(4 * spark.sparkContext.defaultParallelism, tasks // 16))
    return files.select("path", "content").coalesce(few).mapInArrow(decode, "clip_id string, fs int, n_samples long, samples array<double>, error string")


def labelled_files(spark: SparkSession, positive: str, negative: str, pattern: str = "*.[mM][aA][tT]") -> DataFrame:
    """Files of two folders with label 1 and 0 and what their names say; contents are never read."""
    one = lambda d, label: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(d).select("path").withColumn("label", F.lit(label))
    both = one(positive, 1).unionByName(one(negative, 0))
    return labelled_names(both.withColumn("name", F.element_at(F.split("path", "/"), -1)))


def labelled_names(files: DataFrame) -> DataFrame:
    """Entries from file names: name, src, start, second number and label."""
    src, start, second = S.spectrogram_name(F.col("name"))
    return files.select("name", src.alias("src"), start.alias("start_s"), second.alias("second_s"), "label")


#: Fields of a window in either layout.
_CHUNK = (
    "chunk_id string, mat_path string, audio_path string, timestamp string, chunk_shape array<int>, original_shape array<int>, "
    "window_index int, window_start int, window_time_start double, window_time_end double, source_audio string, date string"
)
_FILE = (
    "file_id string, mat_path string, audio_path string, audio_timestamp string, spectrogram_path string, segment_start_sec double, "
    "segment_end_sec double, source_audio string, date string"
)


def window_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per document: path, at (its place in the file), layout, fault, device_code, date_from, date_to, sample_rate,
    spec_config (JSON), windows (JSON).

    The layout of each document is decided by its own keys: the older ``files`` with data_source, or ``chunks`` with
    processing_parameters. Others, and texts that aren't JSON, have a fault. spec_config names the source of its spectra.
    """
    raw = spark.read.text(path, wholetext=not lines)
    # beside the row's id, which no filter passes, a document is parsed once
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    doc = raw.filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), at.alias("at"), F.try_parse_json("value").alias("v"))
    get = lambda key, kind="string": F.try_variant_get("v", f"$.{key}", kind)
    has = lambda key: F.try_variant_get("v", f"$.{key}", "variant").isNotNull()
    layout = F.when(has("data_source") & has("files"), "files").when(has("chunks") & has("processing_parameters"), "chunks")
    fault = F.when(F.col("v").isNull(), "no JSON").when(F.col("layout").isNull(), "unknown layout")
    either = lambda old, new, default: F.when(F.col("layout") == "files", get(old)).when(F.col("layout") == "chunks", F.coalesce(get(new), F.lit(default)))
    config = F.when(F.col("layout") == "files", get("spectrogram_config")).otherwise(get("processing_parameters"))
    return doc.withColumn("layout", layout).withColumn("fault", fault).select(
        "path", "at", "layout", "fault", either("data_source.device_code", "device_code", "unknown").alias("device_code"), either("data_source.date_from", "start_date", "").alias("date_from"),
        either("data_source.date_to", "end_date", "").alias("date_to"), F.when(F.col("layout") == "files", get("data_source.sample_rate", "double")).alias("sample_rate"), config.alias("spec_config"),
        F.coalesce(F.get_json_object(config, "$.source"), F.get_json_object(config, "$.spectrogram_source"), S.provenance_by(lambda k: get(k).isNotNull())).alias("spectra_from"),
        F.when(F.col("layout") == "files", get("files")).otherwise(get("chunks")).alias("windows"),
    )


def window_catalogue(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Window metadata of documents of either layout, mixed as they may be, in one schema, with facts of their documents.

    A file is one document, or with ``lines`` one document per line, which large files need to be split. Windows without an id
    are left out; of windows with one id the last counts, by path, place of the document and place in it. Documents
    with a fault give no window (``catalogue_faults``).
    """
    doc = window_documents(spark, path, lines).filter("fault IS NULL")
    new, old = F.from_json("windows", f"array<struct<{_as_struct(_CHUNK)}>>"), F.from_json("windows", f"array<struct<{_as_struct(_FILE)}>>")
    facts = ["layout", "device_code", "date_from", "date_to", "sample_rate", "spec_config", "spectra_from"]
    none = lambda kind: F.lit(None).cast(kind)
    shared = ("mat_path", "audio_path")
    chunk = lambda c: F.struct(
        c["chunk_id"].alias("file_id"), *[c[x].alias(x) for x in shared], c["window_time_start"].alias("start_s"), c["window_time_end"].alias("end_s"), c["timestamp"].alias("audio_timestamp"),
        *[c[x].alias(x) for x in ("chunk_shape", "original_shape", "window_index", "window_start", "source_audio", "date")], none("string").alias("spectrogram_path"),
    )
    file = lambda c: F.struct(
        c["file_id"].alias("file_id"), *[c[x].alias(x) for x in shared], c["segment_start_sec"].alias("start_s"), c["segment_end_sec"].alias("end_s"), c["audio_timestamp"].alias("audio_timestamp"),
        none("array<int>").alias("chunk_shape"), none("array<int>").alias("original_shape"), none("int").alias("window_index"), none("int").alias("window_start"),
        *[c[x].alias(x) for x in ("source_audio", "date", "spectrogram_path")],
    )
    # each document by its own layout, in one pass
    every = doc.select("path", "at", *facts, F.posexplode(F.when(F.col("layout") == "chunks", F.transform(new, chunk)).otherwise(F.transform(old, file))).alias("_p", "c"))
    every = every.select("path", "at", "_p", *facts, "c.*").filter(F.col("file_id").isNotNull() & (F.col("file_id") != ""))
    rest = [x for x in every.columns if x not in ("path", "at", "_p", "file_id")]
    return every.groupBy("file_id").agg(F.max_by(F.struct(*rest), F.struct("path", "at", "_p")).alias("w")).select("file_id", *[F.col(f"w.{x}").alias(x) for x in rest])


def _as_struct(fields: str) -> str:
    return ", ".join(f"{n}: {k}" for n, k in (f.split(" ", 1) for f in fields.split(", ")))


def catalogue_faults(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(path, fault, documents): documents that window_catalogue() can't read."""
    return window_documents(spark, path, lines).filter("fault IS NOT NULL").groupBy("path", "fault").agg(F.count("*").alias("documents"))


def documentation(spark: SparkSession, path: str) -> DataFrame | None:
    """Dataset documentation, or None where there is none."""
    try:
        return spark.read.option("multiLine", "true").json(path)
    except AnalysisException:
        return None
