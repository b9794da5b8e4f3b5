"""Runs: Parquet folders sorted by key, with Bloom filters on the key."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import Corruption
from tidelog.functions import record_bytes
from tidelog.schema import LOG, Options
from tidelog.sources.manifest import Run

#: Bytes of a file of a run, about; the number of range partitions follows from it.
FILE_BYTES = 256 << 20


def write(rows: DataFrame, path: str, run_id: int, options: Options, size_hint: int) -> Run:
    """Writes rows (one for each key) in key order over range partitions, so files hold disjoint key ranges."""
    files = max(1, -(-size_hint // FILE_BYTES))
    ordered = rows.repartitionByRange(files, "key") if files > 1 else rows.coalesce(1)
    seen = Observation()
    sorted_ = ordered.sortWithinPartitions("key").select("key", "seq", "value").observe(
        seen, F.coalesce(F.sum(record_bytes(F.col("key"), F.col("value"))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("records"),
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.coalesce(F.max("seq"), F.lit(0)).alias("seq"),
    )
    (
        sorted_.write
        .option("parquet.page.size", str(options.block_size)).option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.fpp#key", str(min(0.5, 0.6185**options.bloom_filter_bits_per_key)))
        .parquet(path)
    )
    m = seen.get  # counted by the tasks that wrote
    return Run(run_id, m["bytes"], m["records"], None if m["lo"] is None else bytes(m["lo"]).hex(), None if m["hi"] is None else bytes(m["hi"]).hex(), m["seq"])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def check(path: Path, run: Run) -> None:
    """Raises where a run's files are not whole, or do not hold the records and sequence numbers that the manifest has; only footers are read."""
    records, last = 0, 0
    try:
        for p in sorted(path.glob("*.parquet")):
            meta = pq.read_metadata(p)
            records += meta.num_rows
            at = meta.schema.names.index("seq")
            for g in range(meta.num_row_groups):
                seen = meta.row_group(g).column(at).statistics
                last = max(last, seen.max if seen is not None and seen.has_min_max else 0)
    except (pa.ArrowException, OSError, ValueError) as e:
        raise Corruption(f"run {run.run_id} is damaged") from e
    if records != run.records or last != run.max_seq:
        raise Corruption(f"run {run.run_id} is not what the manifest says")
