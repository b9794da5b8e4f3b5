"""Compaction policy: which runs are merged. files is (id, bytes), at most a few thousand rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import size_class, size_class_of

#: Most inputs of one merge, and the bytes of their buffers together.
FAN_IN, BUFFER_BUDGET = 16, 512 << 10


def full_pick(files: DataFrame, threshold: int) -> DataFrame:
    """All files, if there are enough."""
    return files.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).filter(F.col("_n") >= threshold).drop("_n")


def tiered_pick(files: DataFrame, threshold: int) -> DataFrame:
    """id, tier: the threshold oldest files of the smallest size class that has so many."""
    tiers = files.select("id", size_class(F.col("bytes")).alias("tier"))
    ready = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
    smallest = ready.agg(F.min("tier").alias("tier"))
    return tiers.join(F.broadcast(smallest), "tier").orderBy("id").limit(threshold).select("id", "tier")  # one row is broadcast


def pick(files: list[tuple[int, int]], style: str, threshold: int) -> list[int]:
    """The same on the driver, over a manifest's (id, bytes) in publication order; ids in that order."""
    if len(files) < threshold:
        return []
    if style == "full":
        return [i for i, _ in files]
    tiers: dict[int, list[int]] = {}
    for i, size in files:
        tiers.setdefault(size_class_of(size), []).append(i)
    ready = [t for t, ids in tiers.items() if len(ids) >= threshold]
    if not ready:
        return []
    chosen = set(sorted(tiers[min(ready)])[:threshold])
    return [i for i, _ in files if i in chosen]


def fan_in(costs: list[int]) -> int:
    """How many inputs from the first on are merged at once: as many as fit the buffers, FAN_IN at most, two at least (or all there are)."""
    if len(costs) <= 2:
        return len(costs)
    total, n = 0, 0
    for c in costs[:FAN_IN]:
        total += c
        if total > BUFFER_BUDGET:
            break
        n += 1
    return max(2, n)


def fan_in_frame(inputs: DataFrame) -> DataFrame:
    """One row, inputs: fan_in() over inputs(pos, cost)."""
    running = inputs.withColumn("total", F.sum("cost").over(Window.orderBy("pos")))
    fits = running.agg(F.sum(F.when((F.col("total") <= BUFFER_BUDGET) & (F.col("pos") < FAN_IN), 1).otherwise(0)).alias("fits"), F.count(F.lit(1)).alias("n"))
    return fits.select(F.least("n", F.greatest("fits", F.lit(2))).cast("long").alias("inputs"))
