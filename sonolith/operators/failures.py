"""Stages that carry errors: a bad row becomes a row with a reason, and the job goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ERROR = "error"


def reason(e: BaseException) -> str:
    return str(e) or type(e).__name__


def safe_batches(df: DataFrame, batch: Callable[[list[dict]], list[dict]], schema: str, keep: list[str] | None = None, batch_rows: int = 256, batch_bytes: int = 4 << 20) -> DataFrame:
    """df through a function of lists of rows, with the columns ``keep`` (all by default), those of ``schema`` and ``error``.

    The function returns one row for each that it is given. If it fails on a batch, or returns another number, the rows of the batch go to
    it one by one, and those on which it fails get nulls and the reason. An exception in place of a row is the fault of that row alone.
    Rows that come with an error skip it and keep theirs. Batches end at batch_rows rows or batch_bytes bytes, but for a longer row.
    """
    keep = [c for c in df.columns if c != ERROR] if keep is None else keep
    given = [c for c in df.columns if c != ERROR]
    made = T._parse_datatype_string(schema).fields
    fields = [*(df.schema[c] for c in keep if c not in {f.name for f in made}), *made, T.StructField(ERROR, T.StringType())]
    out = T.StructType(fields)
    arrow = to_arrow_schema(out)

    def checked(rows: list[dict]) -> list[dict]:
        done = batch([{c: r[c] for c in given} for r in rows])
        if len(done) != len(rows):
            raise ValueError(f"{len(done)} rows made of {len(rows)}")
        return done

    def cut(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = whole.num_rows
        if n <= 1 or n <= batch_rows and whole.nbytes <= batch_bytes:
            yield from [whole] if n else []
            return
        for half in (whole.slice(0, n // 2), whole.slice(n // 2)):
            yield from cut(half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in cut(whole):
                rows = part.to_pylist()
                ready = [i for i, r in enumerate(rows) if r.get(ERROR) is None]
                found: dict[int, dict] = {}
                try:
                    found.update(zip(ready, checked([rows[i] for i in ready]) if ready else [], strict=True))
                    result = pa.RecordBatch.from_pylist([_row(rows[i], found.get(i), None) for i in range(len(rows))], arrow)
                except Exception:  # any fault of one row must not cost the others
                    result = pa.RecordBatch.from_pylist([_alone(r, i in set(ready)) for i, r in enumerate(rows)], arrow)
                yield result

    def _row(row: dict, found: dict | Exception | None, error: str | None) -> dict:
        if isinstance(found, Exception):
            found, error = None, reason(found)
        error = row.get(ERROR) or error
        return {c: row[c] for c in keep} | {f.name: found.get(f.name) if found else None for f in made} | {ERROR: error}

    def _alone(row: dict, ready: bool) -> dict:
        if not ready:
            return _row(row, None, None)
        try:
            made_row = _row(row, checked([row])[0], None)
            pa.RecordBatch.from_pylist([made_row], arrow)  # a value of another type is a fault of this row too
            return made_row
        except Exception as e:
            return _row(row, None, reason(e))

    return df.mapInArrow(run, out)


def safe_map(df: DataFrame, one: Callable[[dict], dict], schema: str, keep: list[str] | None = None, batch_rows: int = 256, batch_bytes: int = 4 << 20) -> DataFrame:
    """safe_batches() for a function of one row."""

    def tried(row: dict) -> dict | Exception:
        try:
            return one(row)
        except Exception as e:
            return e

    return safe_batches(df, lambda rows: [tried(r) for r in rows], schema, keep, batch_rows, batch_bytes)


def failure_report(stages: dict[str, DataFrame], row: str, clip: str) -> DataFrame:
    """(stage, row, clip, reason): the rows with an error of each stage, where it arose."""
    ids = [F.col(c).cast("string").alias(c) for c in (row, clip)]
    bad = F.col(ERROR).isNotNull()
    parts = [df.filter(bad).select(F.lit(i).alias("_i"), F.lit(name).alias("stage"), *ids, F.col(ERROR).alias("reason")) for i, (name, df) in enumerate(stages.items())]
    if not parts:
        raise ValueError("no stages")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = every.groupBy(row, clip).agg(F.min_by(F.struct("stage", "reason"), "_i").alias("f"))
    return first.select("f.stage", row, clip, "f.reason")
