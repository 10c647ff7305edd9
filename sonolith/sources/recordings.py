"""Recordings read in blocks: a Spark data source whose partitions are byte ranges of PCM data.

A WAV file of any length is read by as many tasks as its size asks for. The listing gives only paths and sizes; each task
reads the header of its files and the bytes of its own blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "clip_id string, fs int, n_samples long, start long, samples array<double>, error string"
#: What opening a file costs in bytes: many short recordings are one task.
OPEN_COST = 32 << 10
#: Rows, and bytes of samples, that leave a task together.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
_PCM, _EXTENSIBLE = 1, 0xFFFE
#: A length that a writer leaves where it doesn't know it.
_UNKNOWN = 0xFFFFFFFF


@dataclass(frozen=True)
class Format:
    """Where a file's samples are and how they are written."""

    rate: int
    channels: int
    width: int
    at: int
    frames: int


def wav_format(f, size: int) -> Format:
    """Header of an open WAV or RF64 file of so many bytes; ValueError says what is wrong with it.

    A data chunk that goes on beyond the end, or doesn't tell its length, ends with the file.
    """

    def read(n: int) -> bytes:
        data = f.read(n)
        if len(data) < n:
            raise ValueError("the header is cut off")
        return data

    kind, _, wave = struct.unpack("<4sI4s", read(12))
    if kind not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise ValueError("file does not start with RIFF id")
    long_data, form, at = None, None, 12
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", read(8))
        at += 8
        if name == b"ds64":
            long_data = struct.unpack("<QQ", read(16))[1]
        elif name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(16))
            if tag == _EXTENSIBLE and length >= 26:
                tag = struct.unpack("<8xH", read(10))[0]
            if tag != _PCM or bits not in (8, 16, 24, 32) or not channels or not rate:
                raise ValueError(f"not PCM of 8 to 32 bits: format {tag}, {bits} bits, {channels} channels")
            form = channels, rate, bits // 8
        elif name == b"data":
            if form is None:
                raise ValueError("data before its format")
            channels, rate, width = form
            length = long_data if length == _UNKNOWN and long_data is not None else length
            held = size - at if length == _UNKNOWN else min(length, size - at)
            return Format(rate, channels, width, at, held // (channels * width))
        at += length + length % 2
    raise ValueError("no data chunk")


def samples_of(raw: bytes, width: int, channels: int) -> np.ndarray:
    """The first channel in [-1, 1) of PCM frames with 8 to 32 bits a sample."""
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:  # the only unsigned one
        x = np.frombuffer(raw, np.uint8)[::channels].astype(np.int64) - 128
    else:
        wide = np.zeros((len(raw) // (width * channels), 4), np.uint8)
        wide[:, 4 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, channels, width)[:, 0]
        x = (wide.view("<i4").ravel() >> (32 - 8 * width)).astype(np.int64)
    return x / float(1 << (8 * width - 1))


def columns_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch, nulls where they lack a column; arrays stay arrays."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


class _Range(InputPartition):
    """Byte ranges (path, size, first, end) of files."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(ranges)


class RecordingReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        self.folder = options["path"]
        self.block, self.halo = int(options.get("block", 1 << 20)), int(options.get("halo", 0))
        self.split, self.tasks = int(options.get("splitbytes", 64 << 20)), int(options.get("tasks", 1))
        if self.block < 1 or self.halo < 0 or self.split < 1:
            raise ValueError("block and splitBytes are positive, halo isn't negative")

    def partitions(self) -> list[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.folder)
        files = where.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((x.path, x.size) for x in files if x.type == fs.FileType.File and x.path.lower().endswith(".wav"))
        total = sum(size + OPEN_COST * max(1, -(-size // self.split)) for _, size in found)
        most = min(self.split, max(8 * OPEN_COST, total // max(1, self.tasks)))  # few short files are dealt to all cores
        out, held, cost = [], [], 0
        for path, size in found:
            for a in range(0, max(size, 1), self.split):
                b = min(a + self.split, size)
                if held and cost + b - a + OPEN_COST > most:
                    out.append(_Range(held))
                    held, cost = [], 0
                held.append((path, size, a, b if b < size else size + 1))
                cost += b - a + OPEN_COST
        return [*out, _Range(held)] if held else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"clip_id": pa.string(), "fs": pa.int32(), "n_samples": pa.int64(), "start": pa.int64(), "samples": pa.list_(pa.float64()), "error": pa.string()}
        schema = pa.schema([(n, kinds[n]) for n in self.names])
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += 0 if row.get("samples") is None else row["samples"].nbytes
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield columns_of(rows, schema)
                rows, held = [], 0
        if rows:
            yield columns_of(rows, schema)

    def _rows(self, partition: InputPartition) -> Iterator[dict]:
        where, _ = fs.FileSystem.from_uri(self.folder)
        for path, size, first, end in partition.value:
            name = path.rsplit("/", 1)[-1]
            try:
                with where.open_input_file(path) as f:
                    form = wav_format(f, size)
                    step = form.channels * form.width
                    jump = step * self.block
                    blocks = max(1, -(-form.frames // self.block))
                    # a block belongs to the range in which its first byte lies
                    for i in range(max(0, -(-(first - form.at) // jump)), blocks):
                        if form.at + i * jump >= end:
                            break
                        begin = i * self.block
                        row = {"clip_id": name, "fs": form.rate, "n_samples": form.frames, "start": begin, "error": None}
                        if "samples" in self.names:
                            f.seek(form.at + i * jump)
                            n = min(self.block + self.halo, form.frames - begin)
                            row["samples"] = samples_of(f.read(n * step), form.width, form.channels)
                        yield row
            except (ValueError, struct.error, OSError) as e:
                if first == 0:  # one row, whatever the number of ranges
                    yield {"clip_id": name, "error": str(e) or type(e).__name__}


class Recordings(DataSource):
    """``recordings``: options path, block and halo (samples), splitBytes, and tasks: over so many short files are spread. A schema given to the reader picks columns."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(schema, self.options)


def load_blocks(spark: SparkSession, folder: str, block: int = 1 << 20, halo: int = 0, split_bytes: int = 64 << 20, columns: list[str] | None = None) -> DataFrame:
    """Every WAV recording below a folder in blocks: clip_id, fs, n_samples (of the recording), start, samples, error.

    A row has ``block`` samples of the first channel from ``start``, and up to ``halo`` more that the next row has too. An
    empty recording is one row without samples; a file that can't be decoded is one row with the reason as error. Without
    ``samples`` among the columns only headers are read. The folder must be reached by pyarrow.fs.
    """
    spark.dataSource.register(Recordings)
    kinds = dict(x.strip().split(" ") for x in SCHEMA.split(","))
    reader = spark.read.format("recordings").option("block", block).option("halo", halo).option("splitBytes", split_bytes).option("tasks", spark.sparkContext.defaultParallelism)
    if columns is not None:
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(folder)
