"""Metadata of logs and runs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog import functions as K

#: Rows of a preview, and bytes of each field in it.
PREVIEW_ROWS, PREVIEW_BYTES = 32, 128


def preview(records: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """The first records in key order, tombstones with them: pos, shortened key and value, their whole lengths, deleted."""
    top = records.orderBy(key).limit(PREVIEW_ROWS)
    k, v = F.col(key).cast("binary"), F.col(value).cast("binary")
    return top.select(
        (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("pos"), F.substring(k, 1, PREVIEW_BYTES).alias("key"), K.length_or_zero(k).alias("key_bytes"),
        F.col(seq).alias("seq"), F.substring(v, 1, PREVIEW_BYTES).alias("value"), K.length_or_zero(v).alias("value_bytes"), v.isNull().alias("deleted"),
    )


def run_metadata(runs: DataFrame, run: str = "run", key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """Of each run: records, bytes of its records, smallest and largest key, largest sequence number."""
    k, v = F.col(key).cast("binary"), F.col(value).cast("binary")
    return runs.groupBy(F.col(run).cast("long").alias("run_id")).agg(F.sum(K.record_bytes(k, v)).alias("bytes"), F.count(F.lit(1)).alias("records"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.max(seq).alias("max_seq"))


def overlapping(metadata: DataFrame, low, high) -> DataFrame:
    """Of run_metadata(), the runs that may hold a key of [low, high]."""
    return metadata.filter((F.col("min_key") <= F.lit(high)) & (F.col("max_key") >= F.lit(low)))


def write_amplification(flushed: DataFrame, compacted: DataFrame, log: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row: bytes that flushes (bytes) and compactions (bytes) wrote, over the log's logical bytes."""
    total = lambda df: df.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    written = total(flushed) + total(compacted)
    return log.agg(F.sum(K.logical_bytes(F.col(key), F.col(value))).alias("logical_bytes")).select("logical_bytes", F.lit(written).cast("long").alias("written_bytes"), (F.lit(float(written)) / F.col("logical_bytes")).alias("write_amplification"))


def rotation_charge(newest: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row, charge: what the newest version of each key counts towards the memtable's limit."""
    return newest.agg(F.coalesce(F.sum(K.entry_charge(F.col(key), F.col(value))), F.lit(0)).cast("long").alias("charge"))
