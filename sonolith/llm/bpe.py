"""Byte-level BPE encoding and decoding.

Inside a piece, a segment tree over byte positions stores the leftmost minimum pair rank. Its root names the next
merge; a merge updates the leaves of the merged position and of its live neighbours, each in logarithmic time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A space next to other white space, or at an edge: then single spaces don't bound pieces.
_ODD = re.compile(r" \s|\s | \Z")


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always merges the adjacent pair of least rank, the leftmost of equals."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    shift = 13 if n < 1 << 13 else 40  # keys of short pieces fit a machine word
    low, none = (1 << shift) - 1, 1 << (shift + 17)
    size = 1 << max(0, (n - 2).bit_length())
    tree = [none] * (2 * size)
    ends = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n))  # start of the token before it
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    while (least := tree[1]) != none:
        at = least & low
        gone = ends[at]
        ends[at] = end = ends[gone]
        rank = get(piece[at : ends[end]]) if end < n else None
        changed = [(size + at, none if rank is None else rank << shift | at)]
        before[end] = at
        if gone < n - 1:
            changed.append((size + gone, none))
        if at:
            prev = before[at]
            rank = get(piece[prev:end])
            changed.append((size + prev, none if rank is None else rank << shift | prev))
        for i, value in changed:
            if tree[i] != value:
                tree[i] = value
                while i > 1:
                    other = tree[i ^ 1]
                    if other < value:
                        value = other
                    i >>= 1
                    if tree[i] == value:
                        break
                    tree[i] = value
    out, at = [], 0
    while at < n:
        end = ends[at]
        out.append(ranks[piece[at:end]])
        at = end
    return out


class PairRanks:
    """Ranks of adjacent ids, for arrays: two ids merge if the bytes of both together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 where they don't merge or either is below 0."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        key = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


_SHIFT, _NONE = 24, 1 << 62


def merged_rows(pieces: list[bytes], size: int, pair: PairRanks) -> list[bytes]:
    """merged() for many pieces of 2 to size + 1 bytes, packed; row r of ``tree`` is the segment tree of piece r."""
    count = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    ids = np.full((count, size + 2), -1, np.int64)
    held = np.arange(size + 2) < lengths[:, None]
    ids[held] = pair.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, size + 3), (count, 1))
    before = np.tile(np.arange(-1, size + 1), (count, 1))
    tree = np.full((count, 2 * size + 2), _NONE, np.int64)
    rank = pair(ids[:, :size].ravel(), ids[:, 1 : size + 1].ravel()).reshape(count, size)
    tree[:, size : 2 * size] = np.where(rank < 0, _NONE, rank << _SHIFT | np.arange(size))
    level = size
    while level > 1:
        level >>= 1
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    rows = np.arange(count)
    while True:
        root = tree[rows, 1]
        live = root != _NONE
        rows, root = rows[live], root[live]
        if not len(rows):
            break
        at, token = root & ((1 << _SHIFT) - 1), root >> _SHIFT
        gone = after[rows, at]
        end = after[rows, gone]
        after[rows, at] = end
        before[rows, end] = at
        ids[rows, at] = token
        ids[rows, gone] = -1
        prev = before[rows, at]
        right = pair(token, ids[rows, end])
        left = pair(ids[rows, prev], token)
        tree[rows, size + gone] = _NONE
        tree[rows, size + at] = np.where(right < 0, _NONE, right << _SHIFT | at)
        first = prev < 0
        prev = np.where(first, at, prev)
        keep = ~first
        tree[rows[keep], size + prev[keep]] = np.where(left < 0, _NONE, left << _SHIFT | prev)[keep]
        three = np.tile(rows, 3)
        node = np.concatenate([np.minimum(size + gone, 2 * size - 1), size + at, size + prev])
        while size > 1 and node[0] > 1:
            node >>= 1
            tree[three, node] = np.minimum(tree[three, 2 * node], tree[three, 2 * node + 1])
    stays = ids >= 0
    packed = ids[stays].astype("<u4").tobytes()
    stops = (np.cumsum(stays.sum(1)) * 4).tolist()
    return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]


class _Cache:
    """Values by key in two generations of bounded size: what is still in use outlives a change of generation.

    Keys of over ``longest`` characters are not kept, so the number of entries bounds the memory.
    """

    def __init__(self, most: int, longest: int = 256):
        self.most, self.longest, self.new, self.old = most, longest, {}, {}

    def take(self, keys: set, make) -> dict:
        """A value for each key; make gets those not held, as a list, and returns their values."""
        found, new, old, lacks = {}, self.new, self.old, []
        for k in keys:
            v = new.get(k)
            if v is None:
                v = old.get(k)
            if v is None:
                lacks.append(k)
            else:
                found[k] = v
        if lacks:
            found.update(zip(lacks, make(lacks), strict=True))
        if len(new) + len(found) > self.most:
            self.old, self.new = new, {}
        self.new.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        return found


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str, cached: int = 400_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pair = PairRanks(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.by_piece, self.by_word = _Cache(cached), _Cache(cached)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = struct.pack("<I", whole)
            elif len(p) > 1024:
                ids = merged(p, self.ranks)
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
            elif p:
                classes.setdefault(1 << (len(p) - 2).bit_length(), []).append(i)
        for size, members in classes.items():
            step = max(1, (1 << 18) // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, merged_rows([raw[i] for i in part], size, self.pair), strict=True):
                    out[i] = ids
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        split = [self.pieces(w) for w in words]
        found = self.by_piece.take({p for ps in split for p in ps}, self._encode_pieces)
        return [found[ps[0]] if len(ps) == 1 else b"".join([found[p] for p in ps]) for ps in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A single space between two other characters always starts a piece, so a text without odd white space is the
        sequence of its words with the space before each.
        """
        keys = []
        for text in texts:
            if _ODD.search(text) or text[:1] == " ":
                keys.append(self.pieces(text))
            else:
                first, *rest = text.split(" ")
                keys.append([first, *[" " + w for w in rest]])
        found = self.by_word.take(set().union(*keys), self._encode_words)
        return [b"".join([found[k] for k in ks]) for ks in keys]

    @cached_property
    def _vocabulary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        sizes = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, packed: bytes) -> bytes:
        flat, starts, sizes = self._vocabulary
        ids = np.frombuffer(packed, "<u4")
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            n = sizes[part]
            shift = starts[part] - (np.cumsum(n) - n)
            out.append(flat[np.arange(n.sum()) + np.repeat(shift, n)].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker, so its caches outlive a task."""
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", ids: bool = True) -> DataFrame:
    """Per row: doc_id, ids (array of int, if asked for), n_tokens, ids_sha256, decoded_sha256.

    path must be readable on every executor. Null texts count as empty; the empty text has no ids. Rows are encoded
    one by one, so repeated rows and an empty table need no care.
    """

    def run(batches):
        own = codec(path, pattern)
        for part in C.pieces(batches, rows=1024):
            packed = own.encode([x or "" for x in part.column(1).to_pylist()])
            columns = [
                part.column(0),
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in packed]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in packed], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
