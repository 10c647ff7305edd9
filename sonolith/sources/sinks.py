"""Writers of predictions, splits, spectrograms, windows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import Record


def write_items(items: DataFrame, folder: str, version: str, created_at: str, updated_at: str, key: str = "item_id") -> int:
    """Save a prediction document whole; items may come from the document itself. created_at stays from the first save."""
    return Record(items.sparkSession, folder, key).replace(items, version, created_at, updated_at)


def update_items(items: DataFrame, folder: str, version: str, created_at: str, updated_at: str, key: str = "item_id") -> int:
    """Save some items of a prediction document, new or in place of those of their ids; the buckets of others aren't touched."""
    return Record(items.sparkSession, folder, key).upsert(items, version, created_at, updated_at)


def read_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items of a document's last save."""
    return Record(spark, folder).read()


def write_splits(entries: DataFrame, folder: str) -> None:
    """Per split a folder of path<TAB>label lines."""
    entries.select("path", "label", "split").write.partitionBy("split").option("sep", "\t").csv(folder)


def write_by_date(df: DataFrame, folder: str) -> None:
    """Parquet by date and device; rows of a folder come from few tasks, of a large one from several."""
    df.hint("rebalance", "date", "device_code").write.partitionBy("date", "device_code").parquet(folder)


def write_report(report: DataFrame, folder: str) -> None:
    report.coalesce(1).write.json(folder)


def write_windows(windows: DataFrame, folder: str, parameters: dict[str, float]) -> None:
    """Window catalogue with its processing parameters as a struct column."""
    literal = F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()])
    windows.withColumn("processing_parameters", literal).write.json(folder)
