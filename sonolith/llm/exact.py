"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes has a given form, so equal passages give equal chunks wherever
they stand. Chunks move once, to prove that no two different ones share an identifier; after that a document is its
ordered list of identifiers, and only these short recipes are grouped and joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_GEAR = np.frombuffer(hashlib.shake_256(b"gear").digest(1024), np.uint32)


def normalised(text: bytes | None) -> bytes:
    """Every run of ASCII white space as one space; null as the empty text."""
    if not text:
        return b""
    body = b" ".join(text.split())
    if not body:
        return b" "
    return (b" " if text[0] in _SPACES else b"") + body + (b" " if text[-1] in _SPACES else b"")


def chunks(text: bytes, least: int = 512, bits: int = 11, most: int = 8192) -> list[bytes]:
    """Pieces of least to most bytes, cut after a byte whose rolling hash over 32 bytes ends in ``bits`` zero bits."""
    n = len(text)
    if n <= least:
        return [text] if text else []
    h = _GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    cuts = (np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1).tolist()
    out, at = [], 0
    for cut in [*cuts, n]:
        while cut - at > most:
            out.append(text[at : at + most])
            at += most
        if cut - at >= least or (cut == n and cut > at):
            out.append(text[at:cut])
            at = cut
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _collides(docs: DataFrame, text: str, size: int) -> bool:
    """Whether two different chunks of the corpus share an identifier of so many bytes."""

    def run(batches):
        for part in C.pieces(batches):
            seen: set[bytes] = set()
            for x in part.column(0).cast(pa.binary()).to_pylist():
                seen.update(chunks(normalised(x)))
            found = list(seen)
            ids = [_digest(c, size) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.binary())], ["id", "chunk"])

    distinct = docs.select(text).mapInArrow(run, "id binary, chunk binary").distinct()
    return not distinct.groupBy("id").count().filter("count > 1").isEmpty()


def verified_size(docs: DataFrame, text: str = "text", size: int = 16, most: int = 64) -> int:
    """The first identifier length, doubling from ``size``, at which no two chunks of the corpus collide."""
    while _collides(docs, text, size):
        if size >= most:
            raise ValueError(f"chunks collide at {size} bytes")
        size = min(2 * size, most)
    return size


def recipes(docs: DataFrame, text: str = "text", size: int | None = None) -> DataFrame:
    """docs with ``recipe`` (identifiers in order, as one binary) and ``text_sha256`` of the normalised text."""
    size = size or verified_size(docs, text)
    names = [C.in_frame("recipe", docs), C.in_frame("text_sha256", docs)]

    def run(batches):
        for part in C.pieces(batches):
            ids, shas = [], []
            for x in part.column(text).cast(pa.binary()).to_pylist():
                body = normalised(x)
                ids.append(b"".join(_digest(c, size) for c in chunks(body)))
                shas.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(shas, pa.string())], [*part.schema.names, *names])

    fields = [T.StructField(names[0], T.BinaryType()), T.StructField(names[1], T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The smallest doc_id of a group stays; null ids come last. Of repeated rows with that id exactly one is kept. Null
    texts count as empty. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = recipes(rows, "text", verified_size(rows, "text", size)).drop("text")
    rows = C.materialize(made.groupBy("doc_id", "recipe", "text_sha256").agg(F.count("*").alias("copies")), "recipes")
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    total = rows.agg(F.sum("copies")).first()[0] or 0
    joined = C.join_groups(rows, groups, "recipe", "group_size", total)
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 16) -> DataFrame:
    """The row with the smallest doc_id of each group of equal texts, with the columns of docs.

    Recipes are made and written once, without texts. Where each row has an id of its own, documents are then chosen by it;
    else they are matched by recipe too, and of repeated rows one stays.
    """
    names = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    size = verified_size(names, "_text", size)
    narrow = C.materialize(recipes(names, "_text", size).select("_id", "recipe"), "recipes")
    keep = narrow.groupBy("recipe").agg(F.min("_id").alias("_keep")).select(F.col("recipe").alias("_recipe"), "_keep")
    if narrow.agg((F.count("*") == F.count_distinct("_id")).alias("x")).first()["x"]:
        keep = keep.select("_keep").hint("merge")
        return docs.join(keep, docs[doc_id] == keep["_keep"], "left_semi")
    recipe = C.in_frame("recipe", docs)
    full = recipes(docs, text, size)
    match = (full[recipe] == keep["_recipe"]) & full[doc_id].eqNullSafe(keep["_keep"])
    return full.join(keep, match, "left_semi").dropDuplicates([doc_id, recipe]).select(*docs.columns)
