"""Generated operation logs: the model's workloads as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import XorShift, ordered_key
from tidelog.operators import compaction


def churn(spark: SparkSession, keys: int) -> DataFrame:
    """key, seq, value (generation): all keys, then every second rewritten, then every fourth deleted."""
    i = F.col("id")
    first = spark.range(keys).select(i.alias("key"), (i + 1).alias("seq"), F.lit(0).cast("long").alias("value"))
    second = spark.range(keys).filter(i % 2 == 0).select(i.alias("key"), (i + 1 + keys).alias("seq"), F.lit(1).cast("long").alias("value"))
    third = spark.range(keys).filter(i % 4 == 0).select(i.alias("key"), (i + 1 + 2 * keys).alias("seq"), F.lit(None).cast("long").alias("value"))
    return first.union(second).union(third)


#: Fixed values of the merge matrix: runs, bytes of keys, shapes with their keys; bytes of a value.
MATRIX_RUNS, MATRIX_KEYS, MATRIX_SHAPES, MATRIX_VALUE = (2, 4, 8, 9, 16), (8, 136), {"distinct": 32_768, "overlap": 8_192, "deletes": 8_192}, 128


def generated_value(i: Column, generation: Column, size: int) -> Column:
    """size bytes: the key's number, the generation, and a byte of it over and over."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    return F.concat(ordered_key(i * 2), byte(generation), F.repeat(byte(generation.bitwiseXOR(F.lit(42))).cast("binary"), size - 9).cast("binary"))


def merge_matrix(spark: SparkSession, runs: int) -> list[DataFrame]:
    """Runs (key, seq, value) of all shapes and sizes of keys at once; key is a struct of key_bytes, shape and the key.

    distinct: the keys are dealt to the runs; overlap: each run has all; deletes:
    so too, and the last run deletes every fourth.
    """
    out = []
    for r in range(runs):
        for_shape = []
        for shape, keys in MATRIX_SHAPES.items():
            i = F.col("id")
            generation = F.lit(0 if shape == "distinct" else r).cast("long")
            value = generated_value(i, generation, MATRIX_VALUE)
            if shape == "deletes" and r == runs - 1:
                value = F.when(i % 4 != 0, value)
            rows = spark.range(r, keys, runs) if shape == "distinct" else spark.range(keys)
            sizes = F.explode(F.array(*[F.lit(n) for n in MATRIX_KEYS])).alias("key_bytes")
            rows = rows.select("id", sizes, (i + 1 + r * keys).alias("seq"), value.alias("value"))
            key = F.concat(F.expr("cast(repeat('x', key_bytes - 8) as binary)"), ordered_key(i * 2))
            for_shape.append(rows.select(F.struct("key_bytes", F.lit(shape).alias("shape"), key.alias("key")).alias("key"), "seq", "value"))
        out.append(reduce(DataFrame.union, for_shape))
    return out


def hot_keys(spark: SparkSession, reads: int, keys: int) -> DataFrame:
    """read, key: four of five reads go to the first hundredth of the keys."""
    n, i = max(1, keys // 100), F.col("id")
    mixed = (i * 48271 + 11) % 2147483647
    return spark.range(reads).select(i.alias("read"), F.when(i % 5 != 0, mixed % n).otherwise(mixed % keys).alias("key"))


def reads(spark: SparkSession, kind: str, count: int, keys: int) -> DataFrame:
    """read, key of uniform, hot or missing (odd: workload keys are even) point reads."""
    i = F.col("id")
    mixed = (i * 48271 + 11) % 2147483647 % keys
    if kind == "hot":
        return hot_keys(spark, count, keys)
    return spark.range(count).select(i.alias("read"), (mixed * 2 + (1 if kind == "miss" else 0)).alias("key"))


def log_pattern(spark: SparkSession, kind: str, rows: int) -> DataFrame:
    """key, seq, value of a log: sorted, random, overwrite (a tenth as many keys) or hotspot (1000 keys)."""
    i = F.col("id")
    mixed = (i * 48271 + 11) % 2147483647
    key = {"sorted": i, "random": mixed, "overwrite": mixed % max(1, rows // 10), "hotspot": mixed % 1000}[kind]
    return spark.range(rows).select(key.alias("key"), (i + 1).alias("seq"), i.alias("value"))


def tombstones(spark: SparkSession, keys: int) -> DataFrame:
    """key, seq, value: all keys are written and all but every seventeenth deleted."""
    i = F.col("id")
    gone = spark.range(keys).filter(i % 17 != 0).select(i.alias("key"), (i + 1 + keys).alias("seq"), F.lit(None).cast("long").alias("value"))
    return spark.range(keys).select(i.alias("key"), (i + 1).alias("seq"), i.alias("value")).union(gone)


def shaped_keys(spark: SparkSession, keys: int, prefix: int = 128) -> DataFrame:
    """key, seq, value of keys that share prefix bytes and are of many lengths."""
    i = F.col("id")
    key = F.concat(F.lit(b"x" * prefix), ordered_key(i), F.expr("cast(repeat('z', cast(id % 31 as int)) as binary)"))
    return spark.range(keys).select(key.alias("key"), (i + 1).alias("seq"), ordered_key(i).alias("value"))


#: Fixed values of the policy workloads: seeded keys, batches, writes of a batch, bytes of a value, keys of the hot set, and the generator's seed.
SEEDED, BATCHES, WRITES, POLICY_VALUE, HOT_SET, POLICY_SEED = 8192, 64, 128, 128, 256, 0xACE123
POLICY_WORKLOADS = ("append", "hot-set", "delete-heavy")


def policy_writes(workload: str):
    """For each batch its (key, whether it is deleted)."""
    rng = XorShift(POLICY_SEED)
    for batch in range(BATCHES):
        out = []
        for i in range(WRITES):
            drawn, at = rng.next(), batch * WRITES + i
            key = {"append": SEEDED + at, "hot-set": at % HOT_SET}.get(workload, drawn % SEEDED)
            out.append((key, workload == "delete-heavy" and drawn % 3 == 0))
        yield out


def policy_model(workload: str, style: str, threshold: int = 4) -> dict[str, int]:
    """What a compaction policy leaves after each batch was flushed and all due merges were made: merges, runs, records, logical bytes.

    Runs are dicts from key to sequence number and whether it is a deletion; a
    run's bytes are its records'. Deletions go where a merge has all runs.
    """
    size = lambda run: sum(17 + 8 + (0 if gone else POLICY_VALUE) for _, gone in run.values())
    runs, merges, last, seq, logical = {1: {k: (k + 1, False) for k in range(SEEDED)}}, 0, 1, SEEDED, SEEDED * (8 + POLICY_VALUE)
    for batch in policy_writes(workload):
        last += 1
        runs[last] = {k: (seq + 1 + i, gone) for i, (k, gone) in enumerate(batch)}
        seq += len(batch)
        logical += sum(8 + (0 if gone else POLICY_VALUE) for _, gone in batch)
        while (ids := compaction.pick([(i, size(r)) for i, r in runs.items()], style, threshold)) and not len(ids) == len(runs) == 1:
            whole, merged = len(ids) == len(runs), {}
            for i in ids:
                for k, version in runs.pop(i).items():
                    merged[k] = max(version, merged.get(k, version))
            last += 1
            runs[last] = {k: v for k, v in merged.items() if not (whole and v[1])}
            merges += 1
    return {"merges": merges, "runs": len(runs), "records": sum(map(len, runs.values())), "logical_bytes": logical}
