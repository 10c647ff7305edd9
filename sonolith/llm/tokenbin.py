"""Token ids in binary files, compressed by a Re-Pair grammar per segment.

A segment stores its rules, the length that each nonterminal expands to, the remaining sequence and where documents
start, so any range of ids is decoded from the symbols that cover it.

Segment, little-endian: uint32 first nonterminal, rules, symbols, documents, uint64 ids, bytes of document names and bytes of
lengths; pairs of the rules, as many bits a symbol as the largest needs; expansion lengths of the rules, 7 bits a byte,
low ones first, the last byte of each under 128; uint64 ids before every BLOCK-th symbol; uint64 starts of the documents;
symbols, of as many bits as in rules; the documents' names as an Arrow stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .files import TaskFile, read_at
from .repair import compress, expand, lengths
from .wordids import encoder

#: Ids of a segment at least, but for the last of a file; a document is never cut.
SEGMENT_IDS = 1 << 19
BLOCK = 4096
_HEAD = struct.Struct("<4I3Q")


def _bits(largest: int) -> int:
    return max(1, int(largest).bit_length())


def _pack(x: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits each, 32 at most, high bits first, the last byte filled with zeros.

    8 numbers fill ``width`` bytes, so the j-th of all groups goes to the same bytes of each.
    """
    n = len(x)
    rows = np.zeros((-(-n // 8), 8), np.uint64)
    rows.ravel()[:n] = x
    out = np.zeros((len(rows), width + 5), np.uint8)
    for j in range(8):
        at, bit = divmod(j * width, 8)
        shifted = rows[:, j] << np.uint64(40 - width - bit)
        for i in range(5):
            out[:, at + i] |= (shifted >> np.uint64(32 - 8 * i)).astype(np.uint8)
    return out[:, :width].tobytes()[: -(-n * width // 8)]


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    groups = -(-n // 8)
    raw = np.zeros((groups, width + 5), np.uint8)
    whole = np.frombuffer(data.ljust(groups * width, b"\0"), np.uint8, groups * width)
    raw[:, :width] = whole.reshape(groups, width)
    out = np.empty((groups, 8), np.int64)
    for j in range(8):
        at, bit = divmod(j * width, 8)
        held = np.zeros(groups, np.uint64)
        for i in range(5):
            held |= raw[:, at + i].astype(np.uint64) << np.uint64(32 - 8 * i)
        out[:, j] = (held >> np.uint64(40 - width - bit)) & np.uint64((1 << width) - 1)
    return out.ravel()[:n]


def _varints(x: np.ndarray) -> bytes:
    if not len(x):
        return b""
    groups = max(1, -(-_bits(int(x.max())) // 7))
    parts = (x[:, None] >> (7 * np.arange(groups))) & 127
    used = np.maximum(1, (parts > 0).cumsum(1).argmax(1) + 1)
    more = np.arange(groups) < used[:, None] - 1
    return (parts | np.where(more, 128, 0)).astype(np.uint8)[np.arange(groups) < used[:, None]].tobytes()


def _from_varints(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not n:
        return np.empty(0, np.int64)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127) << (7 * place), starts)


#: Occurrences from which a rule is made. One saves a symbol of some 17 bits; a rule costs two symbols, a byte or more for its
#: length, and its share of a bit in every symbol: three occurrences hardly pay, and where they cost a bit they don't.
LEAST = 4
#: Segments that a task reads.
SEGMENTS_A_TASK = 8


def pack_segment(ids: np.ndarray, starts: np.ndarray, first: int, names: pa.Array | None = None, least: int = LEAST) -> bytes:
    """Re-Pair ends where no pair occurs ``least`` times: where a rule no longer pays for itself."""
    rules, symbols = compress(ids, first, least)
    sizes = lengths(rules, first)
    n = np.ones(len(symbols), np.int64)
    big = symbols >= first
    n[big] = sizes[symbols[big] - first]
    before = (np.cumsum(n) - n)[::BLOCK]
    sink = pa.BufferOutputStream()
    if names is not None:
        batch = pa.RecordBatch.from_arrays([names], ["doc_id"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
    tail, spans, width = sink.getvalue().to_pybytes(), _varints(sizes), _bits(max(1, first + len(rules) - 1))
    head = _HEAD.pack(first, len(rules), len(symbols), len(starts), len(ids), len(tail), len(spans))
    parts = [head, _pack(rules.ravel(), width), spans, before.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), _pack(symbols, width), tail]
    return b"".join(parts)


class Segment:
    """Reader of one packed segment, given as bytes or as a function (offset, size) -> bytes. Each part is read when it is
    first needed, symbols only as far as a slice needs them."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self._read = source if callable(source) else lambda at, size: source[at : at + size]
        self.first, r, s, d, self.n_ids, tail, spans = _HEAD.unpack(self._read(0, _HEAD.size))
        self.n_rules, self.n_symbols, self.n_docs = r, s, d
        self.width = _bits(max(1, self.first + r - 1))
        packed = lambda n: -(-n * self.width // 8)
        sizes = [packed(2 * r), spans, 8 * -(-s // BLOCK), 8 * d, packed(s), tail]
        self._at = np.cumsum([_HEAD.size, *sizes]).tolist()

    def _part(self, i: int) -> bytes:
        return self._read(self._at[i], self._at[i + 1] - self._at[i])

    @cached_property
    def rules(self) -> np.ndarray:
        return _unpack(self._part(0), self.width, 2 * self.n_rules).reshape(-1, 2)

    @cached_property
    def lengths(self) -> np.ndarray:
        return _from_varints(self._part(1), self.n_rules)

    @cached_property
    def before(self) -> np.ndarray:
        return np.frombuffer(self._part(2), "<u8").astype(np.int64)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self._part(3), "<u8").astype(np.int64)

    @cached_property
    def names(self) -> pa.Array:
        return pa.ipc.open_stream(self._part(5)).read_all().column(0).combine_chunks()

    def symbols(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Symbols from ``start``, a multiple of 8, where a byte begins."""
        stop = self.n_symbols if stop is None else min(stop, self.n_symbols)
        at = start * self.width // 8
        return _unpack(self._read(self._at[4] + at, -(-stop * self.width // 8) - at), self.width, stop - start)

    def ids(self) -> np.ndarray:
        return expand(self.symbols(), self.rules, self.lengths, self.first)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids()[start:stop], from the blocks of symbols that cover them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.int64)
        a = int(np.searchsorted(self.before, start, "right")) - 1
        b = int(np.searchsorted(self.before, stop, "left"))
        base = int(self.before[a])
        return expand(self.symbols(a * BLOCK, b * BLOCK), self.rules, self.lengths, self.first, start - base, stop - base)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the ids of all texts, documents in ascending doc_id (null first), and return the manifest.

    Range-sorted partitions write one file each, of one or more segments. The manifest has file, part, segment, at,
    size, n_ids. It is written last; what it doesn't name isn't part of the output.
    """

    def run(batches):
        own = encoder(path)
        first = max(own.tokenizer.get_vocab_size(), end_id + 1)
        part = TaskContext.get().partitionId()
        out, segment = None, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        waiting = 0

        def segments(last: bool):
            """Manifest rows of the segments that what is held fills, and at last of the rest."""
            nonlocal out, segment, held, waiting
            ids, sizes = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            names = pa.concat_arrays([h[2] for h in held])
            ends = np.cumsum(sizes)
            rows, done, at = [], 0, 0
            while done < len(sizes) and (last or ends[-1] - at >= segment_ids):
                stop = min(int(np.searchsorted(ends, at + segment_ids)) + 1, len(sizes))
                out = out or TaskFile(folder, f"part-{part:06d}.tok")
                starts = (ends - sizes)[done:stop] - at
                data = pack_segment(ids[at : ends[stop - 1]], starts, first, names.slice(done, stop - done))
                rows.append((out.name, part, segment, out.write(data), len(data), int(ends[stop - 1]) - at))
                done, at, segment = stop, int(ends[stop - 1]), segment + 1
            held, waiting = ([(ids[at:], sizes[done:], names.slice(done))] if done < len(sizes) else []), int(len(ids) - at)
            return pa.RecordBatch.from_pylist([dict(zip(manifest.names, r, strict=True)) for r in rows], manifest)

        for batch in batches:
            for piece in C.pieces([batch], rows=4096, size=4 << 20):
                ids, sizes = own.encode(piece.column(1), end_id)
                held.append((ids, sizes, piece.column(0)))
                waiting += len(ids)
                if waiting >= segment_ids:
                    yield segments(False)
        if held:
            yield segments(True)
        if out:
            out.commit()

    manifest = pa.schema([("file", pa.string()), ("part", pa.int32()), ("segment", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # the beginning of the text lets one repeated doc_id spread over partitions
    rows = rows.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return C.materialize(rows.mapInArrow(run, "file string, part int, segment int, at long, size long, n_ids long"), "token-manifest")


def read(manifest: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """Per document of the files: doc_id (of type ``kind``), start (ids of all documents before it), n_tokens, ids_crc32.

    Running sums take two levels: one row per file, and the segments of a file.
    """
    files = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(files, "part")
    based = based.withColumn("base", F.col("base") + F.col("inside"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(read_at(folder, row["file"], row["at"], row["size"]))
                ids = memoryview(segment.ids().astype("<u4").tobytes())
                starts = segment.starts
                stops = np.append(starts[1:], segment.n_ids)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                made = [segment.names, pa.array(row["base"] + starts), pa.array(stops - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a manifest row is small but stands for much work, so partitions are counted in segments, not bytes
    spread = based.repartition(max(1, min(-(-manifest.count() // SEGMENTS_A_TASK), 20_000)), "part", "segment")
    return spread.select("file", "at", "size", "base").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_range(folder: str, file: str, at: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the segment at an offset of a file; of its symbols only the blocks that hold them are read."""
    return Segment(lambda offset, size: read_at(folder, file, at + offset, size)).slice(start, stop)


def round_trip(docs: DataFrame, path: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """write() to a new shared folder, then read().

    Null texts count as empty and hold the end id alone. Rows with one doc_id stay apart, in the order of their texts.
    An empty table writes no file and gives an empty result.
    """
    folder = C.scratch(docs.sparkSession, "tokens")
    return read(write(docs, folder, path, end_id, text, doc_id, segment_ids), folder, dict(docs.dtypes)[doc_id])
