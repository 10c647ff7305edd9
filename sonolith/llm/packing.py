"""Packing of documents into sequences by lexical retrieval.

Documents are dealt to partitions in the order of their two most telling token ids, so that documents about the same lie
side by side, and cut into shards there. Each shard has an inverted index of its documents' ids, weighted by BM25 with
the whole corpus's document frequencies. A seed document opens a sequence; its unused neighbours in the index fill it,
best first, whole while they fit; the best that doesn't fit is cut so that the sequence is full, and its rest is the next seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .wordids import ByteEncoder, encoder

#: A shard is closed at so many ids or documents; that bounds its index.
SHARD_IDS, SHARD_DOCS = 1 << 21, 1 << 15
#: Telling ids of a seed that ask the index, and neighbours that are ranked at first; all are if those don't fill.
QUERY_IDS, RANKED = 16, 64
#: BM25's usual constants.
K1, B = 1.2, 0.75
MOST_PARTITIONS = 20_000


def bags(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, occurrences) of every distinct id of every document, in order."""
    pairs = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) << np.uint64(32) | ids.astype(np.uint64)
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(pairs)))
    return (pairs[first] >> np.uint64(32)).astype(np.int64), (pairs[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), times


class Weights:
    """BM25 weights of ids in documents, by the corpus's document frequencies and mean length."""

    def __init__(self, frequencies: np.ndarray, documents: int, ids: int):
        f = frequencies.astype(np.float64)
        self.idf = np.log1p((documents - f + 0.5) / (f + 0.5)).astype(np.float32)
        self.mean = max(1.0, ids / max(1, documents))

    def __call__(self, lengths: np.ndarray, token: np.ndarray, times: np.ndarray) -> np.ndarray:
        """``lengths`` are those of the documents, one for each pair."""
        return self.idf[token] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / self.mean))


class Index:
    """Inverted index of a shard: for each id the documents that hold it, and what it adds to their scores."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, weights: Weights):
        self.n = len(lengths)
        doc, self.token, times = bags(ids, lengths)
        self.weight = weights(lengths[doc], self.token, times)
        self.bag = np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(self.token, kind="stable")
        self.docs, self.adds = doc[order], self.weight[order]
        self.starts = np.searchsorted(self.token[order], np.arange(len(weights.idf) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a telling id of the seed, by falling score, equal ones in order."""
        a, b = self.bag[seed], self.bag[seed + 1]
        asked = self.token[a:b]
        if len(asked) > QUERY_IDS:
            asked = asked[np.argpartition(-self.weight[a:b], QUERY_IDS)[:QUERY_IDS]]
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in asked.tolist()]
        if not spans:
            return
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.adds[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        worth = -score[found]
        if len(found) > RANKED:
            best = np.argpartition(worth, RANKED)[:RANKED]
            best = best[np.lexsort((best, worth[best]))]
            yield from found[best].tolist()
            worth[best] = np.inf
            rest = np.argsort(worth, kind="stable")[: len(found) - RANKED]
            yield from found[rest].tolist()
        else:
            yield from found[np.argsort(worth, kind="stable")].tolist()


def fill(lengths: np.ndarray, index: Index, size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length): every id of every document in one of them, all but the last full."""
    done = np.zeros(len(lengths), np.int64)
    unused = lengths > 0
    ahead = 0
    seed: int | None = None
    while True:
        while ahead < len(lengths) and not unused[ahead]:
            ahead += 1
        if seed is None:
            if ahead == len(lengths):
                return
            seed = ahead
        room, sequence, rest = size, [], None

        def put(i: int) -> bool:
            """Place what fits of a document; whether all of it did."""
            nonlocal room
            n = min(room, int(lengths[i] - done[i]))
            sequence.append((i, int(done[i]), n))
            done[i] += n
            room -= n
            unused[i] = done[i] < lengths[i]
            return not unused[i]

        whole = put(seed)
        if not whole:
            rest = seed
        elif room:
            over = None
            for i in index.neighbours(seed, unused):
                if lengths[i] - done[i] <= room:
                    put(i)
                    if not room:
                        break
                elif over is None:
                    over = i
            if room and over is not None and not put(over):
                rest = over
            while room:  # nothing shares an id with the seed any more: what is next in order
                while ahead < len(lengths) and not unused[ahead]:
                    ahead += 1
                if ahead == len(lengths):
                    break
                if not put(ahead):
                    rest = ahead
        yield sequence
        seed = rest


class _Packer:
    """Pieces of one partition's documents."""

    def __init__(self, size: int, weights: Weights, width: np.dtype, names: list[str], part: int):
        self.size, self.weights, self.width, self.names = size, weights, width, names
        self.sequence = part << 32
        self._clear()

    def _clear(self) -> None:
        self.ids: list[np.ndarray] = []  # ends of documents, each shorter than a sequence
        self.lengths: list[int] = []
        self.starts: list[int] = []
        self.totals: list[int] = []
        self.keys: list[pa.Array] = []
        self.held = 0

    def add(self, keys: pa.Array, docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Take documents; gives sequences that long ones fill by themselves, and shards that are full."""
        whole, of = [], []
        for i, ids in enumerate(docs):
            cut = len(ids) // self.size * self.size
            for at in range(0, cut, self.size):
                whole.append((ids[at : at + self.size], at, len(ids), self.sequence))
                of.append(i)
                self.sequence += 1
                if len(whole) >= 1024:
                    yield self._batch(keys.take(pa.array(of)), whole, [0] * len(whole))
                    whole, of = [], []
            self.ids.append(ids[cut:].copy())
            self.lengths.append(len(ids) - cut)
            self.starts.append(cut)
            self.totals.append(len(ids))
            self.held += len(ids) - cut
        if whole:
            yield self._batch(keys.take(pa.array(of)), whole, [0] * len(whole))
        self.keys.append(keys)
        if self.held >= SHARD_IDS or len(self.lengths) >= SHARD_DOCS:
            yield from self.close()

    def close(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Pack what is held. Unless it is the last, a sequence that isn't full goes on in the next shard."""
        lengths = np.array(self.lengths, np.int64)
        keys = pa.concat_arrays(self.keys) if self.keys else None
        index = Index(np.concatenate(self.ids) if self.ids else np.empty(0, self.width), lengths, self.weights)
        made, of, offsets, left = [], [], [], []
        for sequence in fill(lengths, index, self.size):
            if sum(n for _, _, n in sequence) < self.size and not last:
                left = sequence
                break
            at = 0
            for i, start, n in sequence:
                made.append((self.ids[i][start : start + n], self.starts[i] + start, self.totals[i], self.sequence))
                of.append(i)
                offsets.append(at)
                at += n
            self.sequence += 1
        for a in range(0, len(made), 4096):
            yield self._batch(keys.take(pa.array(of[a : a + 4096])), made[a : a + 4096], offsets[a : a + 4096])
        ids, starts, totals = self.ids, self.starts, self.totals
        self._clear()
        for i, start, n in left:
            self.ids.append(ids[i][start : start + n])
            self.lengths.append(n)
            self.starts.append(starts[i] + start)
            self.totals.append(totals[i])
            self.held += n
        if left:
            self.keys.append(keys.take(pa.array([i for i, _, _ in left])))

    def _batch(self, keys: pa.Array, made: list[tuple], offsets: list[int]) -> pa.RecordBatch:
        ids, starts, totals, sequences = zip(*made, strict=True)
        data = np.concatenate(ids).astype("<u4")
        ends = np.cumsum([0, *map(len, ids)]) * 4
        binary = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        numbers = (pa.array(x, pa.int64()) for x in (starts, totals, sequences, offsets))
        start, total, sequence, offset = numbers
        return pa.RecordBatch.from_arrays([keys, start, binary, total, sequence, offset], self.names)


def _split(batch: pa.RecordBatch, column: str, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows in a row, number of each) of a binary column."""
    data = batch.column(column).cast(pa.large_binary())
    _, offsets, held = data.buffers()
    at = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    ids = np.frombuffer(held, np.uint8)[at[0] : at[-1]].view(width) if held is not None and len(at) and at[-1] > at[0] else np.empty(0, width)
    return ids, np.diff(at) // width.itemsize


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", shard_partitions: int | None = None) -> DataFrame:
    """A row for each piece: doc_id, start (ids of its document before it), ids (little-endian uint32), doc_tokens (ids of
    the document with the end id), sequence_id, offset (ids of the sequence before it).

    A document is its ids by the byte-level tokenizer at ``path``, then the end id; a null or empty text is the end id alone.
    Documents of ``size`` ids or more fill sequences by themselves, their ends are packed like short ones. In each
    partition all sequences but the last hold ``size`` ids. Every row is a document: rows with one doc_id, null or not,
    stay apart, and are spread like others. Further columns are ignored; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[doc_id]
    probe = encoder(path, ByteEncoder)
    vocabulary = max(probe.tokenizer.get_vocab_size(), end_id + 1)
    width = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, ByteEncoder)
        row = TaskContext.get().partitionId() << 33
        for batch in C.pieces(batches, rows=4096, size=4 << 20):
            ids, sizes = own.encode(batch.column(1), end_id)
            ends = np.concatenate([[0], np.cumsum(sizes)]) * width.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(width))])
            rows = pa.array(np.arange(row, row + len(sizes)))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), data.cast(pa.binary())], ["row", "doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokens = C.materialize(rows.mapInArrow(encode, f"row long, doc_id {kind}, ids binary"), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(vocabulary, np.int64), 0, 0
        for batch in C.pieces(batches, rows=4096, size=8 << 20):
            ids, sizes = _split(batch, "ids", width)
            held += np.bincount(bags(ids, sizes)[1], minlength=vocabulary)
            n, total = n + len(sizes), total + int(sizes.sum())
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(held[seen], [n, total]))], ["id", "n"])

    # one row per id of the vocabulary at most, and two more
    counts = {r["id"]: r["n"] for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    n, total = counts.pop(-1, 0), counts.pop(-2, 0)
    frequencies = np.zeros(vocabulary, np.int64)
    frequencies[list(counts)] = list(counts.values())
    weights = Weights(frequencies, n, total)

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the two ids of largest weight; -1 where there is none."""
        for batch in C.pieces(batches, rows=4096, size=8 << 20):
            ids, sizes = _split(batch, "ids", width)
            doc, token, times = bags(ids, sizes)
            worth = weights(sizes[doc], token, times)
            first = np.searchsorted(doc, np.arange(len(sizes)))
            best = []
            for _ in range(2):
                top = np.maximum.reduceat(worth, first)
                at = np.flatnonzero(worth == top[doc])
                at = at[np.unique(doc[at], return_index=True)[1]]
                best.append(np.where(worth[at] > 0, token[at], -1).astype(np.int32))
                worth[at] = 0
            yield pa.RecordBatch.from_arrays([*map(pa.array, best), *batch.columns], ["first", "second", *batch.schema.names])

    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, weights, width, names, TaskContext.get().partitionId())
        for batch in C.pieces(batches, rows=1024, size=4 << 20):
            ids, sizes = _split(batch, "ids", width)
            yield from packer.add(batch.column("doc_id"), np.split(ids, np.cumsum(sizes)[:-1]))
        yield from packer.close(last=True)

    parts = shard_partitions or max(1, min(MOST_PARTITIONS, -(-total // SHARD_IDS)))
    keyed = tokens.mapInArrow(telling, f"first int, second int, row long, doc_id {kind}, ids binary")
    dealt = keyed.repartitionByRange(parts, "first", "second", "row").sortWithinPartitions("first", "second", "row").select("doc_id", "ids")
    return dealt.mapInArrow(run, f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def report(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """pack() with ``length`` and ``ids_crc32`` of each piece's ids in their place."""
    p = pack(docs, path, size, end_id)
    return p.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
