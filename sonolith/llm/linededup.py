"""Removal of repeated passages by overlapping windows of lines.

A line of over ``LONG`` words is wrapped into parts where its own words say so, so that a passage inside it is cut the
same way wherever it stands. Every ``k`` consecutive parts (whole lines, or parts of long ones) make a window. Windows
that occur more than once in the corpus keep their first occurrence; parts that later ones cover are removed,
overlapping windows merged.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Lines of more words are wrapped. A part begins at a word whose rank is the least of itself and NEAR words on either
#: side. Parts have 9 words on average, 5 at least, the first of a line 4.
LONG, NEAR = 24, 4
#: Bytes of a window's key, and the odd factor that scatters ranks and mixes the hashes of parts.
KEY, FACTOR = 12, 0x5851F42D4C957F2D

_TOKEN = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


class Part(NamedTuple):
    """Words ``start`` to ``end`` of a line of a text."""

    text: int
    line: int
    start: int
    end: int


def _ranks(words: list[bytes]) -> np.ndarray:
    """A number for each word: its first 8 bytes, zeros behind a shorter one, times FACTOR modulo 2 ** 64."""
    return np.array(words, "S8").view(">u8").astype(np.uint64) * np.uint64(FACTOR)


def _cuts(lines: list[list[bytes]]) -> list[list[int]]:
    """Where the parts of long lines begin, and their lengths. Of equal ranks side by side the first is the least."""
    if not lines:
        return []
    sizes = np.array([len(w) for w in lines])
    ends, line = sizes.cumsum(), np.arange(len(sizes)).repeat(sizes)
    at = np.arange(len(line)) - (ends - sizes)[line]
    x = _ranks(list(chain.from_iterable(lines)))
    mid = x[NEAR:-NEAR]
    least = ((at >= NEAR) & (at < sizes[line] - NEAR))[NEAR:-NEAR]
    for s in range(1, NEAR + 1):
        least &= (mid < x[NEAR - s : len(x) - NEAR - s]) & (mid <= x[NEAR + s : len(x) - NEAR + s])
    here = np.flatnonzero(least) + NEAR
    out = [[0] for _ in lines]
    for i, p in zip(line[here].tolist(), at[here].tolist(), strict=True):
        out[i].append(p)
    for cuts, n in zip(out, sizes.tolist(), strict=True):
        cuts.append(n)
    return out


def parts(texts: list[bytes | None]) -> tuple[list[Part], np.ndarray]:
    """Texts in parts, lines without a word passed over, and two 64-bit hashes for each part.

    Hashes are of words joined by single spaces: runs of white space count as one, at the ends as none.
    """
    lines = [(t, i, words) for t, x in enumerate(texts) if x for i, line in enumerate(x.split(b"\n")) if (words := line.split())]
    cuts = iter(_cuts([words for _, _, words in lines if len(words) > LONG]))
    found, hashes = [], []
    for t, i, words in lines:
        at = next(cuts) if len(words) > LONG else (0, len(words))
        for a, b in zip(at, at[1:], strict=False):
            found.append((t, i, a, b))
            hashes.append(xxhash.xxh3_128_digest(b" ".join(words[a:b])))
    return list(map(Part._make, found)), np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)


def window_keys(texts: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first part, KEY bytes) of each window: k parts in a row of one text. ``texts`` tells the text of each part.

    A key is a linear form of the parts' hashes with odd factors, so different windows meet as rarely as hashes do.
    """
    n = max(0, len(texts) - k + 1)
    key = np.zeros((n, 2), np.uint64)
    for j in range(k):
        key = key * np.uint64(FACTOR) + hashes[j : j + n]
    at = np.flatnonzero(texts[:n] == texts[k - 1 : k - 1 + n])
    return at, np.ascontiguousarray(key[at]).view(np.uint8).reshape(-1, 16)[:, :KEY]


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def clean(text: bytes, first: set[bytes], later: set[bytes], k: int) -> tuple[bytes, int, int]:
    """(text without later occurrences, lines with a word, parts removed).

    ``first`` are repeated windows whose first occurrence in the corpus is this text's first, ``later`` those that
    occurred before it. A part of a first occurrence stays though a later one overlaps it.
    """
    lines = text.split(b"\n")
    if not first and not later:
        return text, sum(1 for x in lines if x.strip()), 0
    found, hashes = parts([text])
    gone, stays = set(), set()
    first, later = set(first), set(later)
    at, keys = window_keys(np.zeros(len(found), int), hashes, k)
    for p, key in zip(at.tolist(), _binary(keys).to_pylist(), strict=True):
        if key in first:
            first.discard(key)
            later.add(key)
            stays.update(range(p, p + k))
        elif key in later:
            gone.update(range(p, p + k))
    gone -= stays
    left: dict[int, list[Part]] = {}
    for p, x in enumerate(found):
        left.setdefault(x.line, []).extend([] if p in gone else [x])
    cut = {found[p].line for p in gone}
    kept = []
    for i, line in enumerate(lines):
        if i in cut and left[i]:
            tokens = _TOKEN.findall(line)
            kept.append(b"".join([t for x in left[i] for t in tokens[x.start : x.end]]))
        elif i not in cut:
            kept.append(line)
    return (b"\n".join(kept) if gone else text), len(left), len(gone)


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3) -> DataFrame:
    """Per text with repeated windows: doc_id, mark (crc32 of the text), first and later (arrays of window keys).

    The document order is ascending doc_id, null last. A row has the keys of its own text only (of texts with one doc_id and
    mark, which are rarely different), so a doc_id, null too, may have any number of rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for part in C.pieces(batches):
            held = part.column("text").cast(pa.binary()).to_pylist()
            found, hashes = parts(held)
            texts = np.array([x.text for x in found], np.int32)
            at, keys = window_keys(texts, hashes, k)
            of = texts[at]
            marks = np.array([zlib.crc32(x) if x else 0 for x in held], np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([_binary(keys), part.column("doc_id").take(pa.array(of)), pa.array(marks[of])], ["key", "doc_id", "mark"])

    windows = C.materialize(rows.mapInArrow(run, f"key binary, doc_id {dict(rows.dtypes)['doc_id']}, mark int"), "windows")
    groups = windows.groupBy("key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("times")).filter("times > 1")
    found = C.join_groups(windows, groups, "key", "times", windows.count()).filter("times IS NOT NULL")
    own = F.col("doc_id").eqNullSafe(F.col("owner"))
    lists = found.groupBy("doc_id", "mark").agg(F.collect_set(F.when(own, F.col("key"))).alias("first"), F.collect_set(F.when(~own, F.col("key"))).alias("later"))
    # written, so that the windows can go before whole documents are shuffled
    lists = C.materialize(lists, "repeated")
    C.discard(windows)
    return lists


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3) -> DataFrame:
    """docs with repeated passages cut from ``text``, and the columns n_lines (lines with a word) and n_removed (parts).

    Rows with one doc_id count as one document: they don't lose lines to each other. Null texts stay null; a text
    whose every line is removed becomes empty; fewer than k parts are no window. Of a line that loses some of its parts
    the rest stays as it was written. An empty table gives an empty result.
    """
    key, mark = C.in_frame("_key", docs), C.in_frame("_mark", docs)
    first, later = C.in_frame("_first", docs), C.in_frame("_later", docs)
    found = repeated(docs, text, doc_id, k).toDF(key, mark, first, later)
    # the low 32 bits, as the tasks see them
    own = F.crc32(C.text_or_empty(docs[text]))
    own = F.when(own >= 1 << 31, own - (1 << 32)).otherwise(own).cast("int")
    rows = docs.join(found, docs[doc_id].eqNullSafe(found[key]) & (own == found[mark]), "left")
    at, width = docs.columns.index(text), len(docs.columns)
    names = [*docs.columns, C.in_frame("n_lines", docs), C.in_frame("n_removed", docs)]

    def run(batches):
        for part in C.pieces(batches):
            mine = (part.column(c).to_pylist() for c in (first, later))
            made = [(x, 0, 0) if not x else clean(x, set(a or ()), set(b or ()), k) for x, a, b in zip(part.column(at).cast(pa.binary()).to_pylist(), *mine, strict=True)]
            columns = list(part.columns)[:width]
            columns[at] = pa.array([m[0] for m in made], pa.binary()).cast(part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2))], names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names[-2:])])
    return rows.select(*docs.columns, first, later).mapInArrow(run, schema)
