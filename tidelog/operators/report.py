"""Operators of benchmark reports: grouping, pairing, medians, bootstrap, percentiles.

rows: suite, case, scenario, stage, backend, trial, seconds (and other metrics).
"""

from __future__ import annotations

import math
import random
import statistics
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.twister import random_after

GROUP = ["suite", "case", "scenario", "stage"]
#: Fixed values of the bootstrap: resamples, seed, and the places of the bounds among the sorted medians.
RESAMPLES, SEED, LOW, HIGH = 4000, 20261029, 100, 3899
#: Draws of one block of resamples, blocks of a group at most, and draws made at once.
BLOCK_DRAWS, BLOCKS, DRAWN = 1 << 26, 32, 1 << 16
#: A stage is slower if the median ratio is under this and the bounds lie under 1.
SLOWER = 0.97
#: Parts that a group's values are cut into to find a rank.
PARTS = 64
#: Samples that a percentile needs.
NEEDED = {95: 20, 99: 100}


def duration(rows: DataFrame) -> DataFrame:
    """rows and duration: the first of seconds, commit_seconds and microseconds over a million that there is."""
    ways = {"seconds": F.col("seconds") if "seconds" in rows.columns else None, "commit_seconds": F.col("commit_seconds") if "commit_seconds" in rows.columns else None, "us": F.col("us") / 1e6 if "us" in rows.columns else None}
    return rows.withColumn("duration", F.coalesce(*[c for c in ways.values() if c is not None]))


def flatten(rows: DataFrame, json_column: str, keys: list[str]) -> DataFrame:
    """keys, path, number: the numbers of a JSON text under dotted paths; truth values and what is not finite are left out.

    A level is expanded at a time, until no object is left; each level but the
    first is looked for by a job.
    """
    level = rows.select(*keys, F.lit("").alias("path"), F.col(json_column).alias("j"))
    out = None
    while True:
        pairs = level.select(*keys, "path", F.explode(F.from_json("j", "map<string,string>")).alias("k", "v")).select(*keys, F.concat("path", "k").alias("path"), "v")
        number = F.expr("try_cast(v as double)")
        leaf = pairs.filter(~F.col("v").startswith("{") & ~F.col("v").isin("true", "false")).select(*keys, "path", number.alias("number")).filter(F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") < float("inf")))
        out = leaf if out is None else out.union(leaf)
        level = pairs.filter(F.col("v").startswith("{")).select(*keys, F.concat("path", F.lit(".")).alias("path"), F.col("v").alias("j"))
        if level.isEmpty():
            return out


def paired_ratios(rows: DataFrame, current: str, other: str, measure: str = "duration", keys: list[str] = GROUP) -> DataFrame:
    """keys, trial, ratio: other over current for the trials of both."""
    side = lambda b, n: rows.filter(F.col("backend") == b).select(*keys, "trial", F.col(measure).alias(n))
    return side(current, "_current").join(side(other, "_other"), [*keys, "trial"]).select(*keys, "trial", (F.col("_other") / F.col("_current")).alias("ratio"))


def summary(rows: DataFrame, measure: str, keys: list[str]) -> DataFrame:
    """keys, trials, median, least, most; the median is exact."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.median(measure).alias("median"), F.min(measure).alias("least"), F.max(measure).alias("most"))


def by_backend(rows: DataFrame, backends: list[str], measure: str = "duration", keys: list[str] = GROUP) -> DataFrame:
    """keys, trial and a column for each backend."""
    return rows.groupBy(*keys, "trial").pivot("backend", backends).agg(F.first(measure))


def _has_order(values: np.ndarray) -> bool:
    """Whether no median of some of the values is NaN: none is NaN, and infinities are of one sign."""
    return not np.isnan(values).any() and not (values.min() == -np.inf and values.max() == np.inf)


def resampled(values: np.ndarray, first: int, last: int) -> np.ndarray:
    """Medians of the resamples with replacement from first to before last, by the random numbers of random.Random(SEED).choices; _has_order(values) holds.

    A value stands for its rank, so the middle of a resample is found in linear time.
    """
    n, half, ordered = len(values), len(values) // 2, np.sort(values)
    rank = np.empty(n, np.int32)
    rank[np.argsort(values, kind="stable")] = np.arange(n, dtype=np.int32)
    rng, out, some = random_after(SEED, first * n), [], max(1, DRAWN // n)
    for start in range(first, last, some):
        drawn = np.empty((min(some, last - start), n), np.int32)
        flat = drawn.reshape(-1)
        for i in range(0, flat.size, DRAWN):
            flat[i : i + DRAWN] = rank[(rng.random_sample(min(DRAWN, flat.size - i)) * n).astype(np.int64)]
        drawn.partition(half, axis=1)
        upper = ordered[drawn[:, half]]
        with np.errstate(all="ignore"):
            out.append(upper if n % 2 else (ordered[drawn[:, :half].max(axis=1)] + upper) / 2)
    return np.concatenate(out)


def bootstrap_bounds(values: list[float]) -> tuple[float, float]:
    """Bounds of 95 % of the median: of sorted medians of resamples with replacement. Where a median may be NaN, Python's sort decides."""
    if _has_order(drawn := np.array(values, float)):
        medians = np.sort(resampled(drawn, 0, RESAMPLES))
        return float(medians[LOW]), float(medians[HIGH])
    rng = random.Random(SEED)
    medians = sorted(statistics.median(rng.choices(values, k=len(values))) for _ in range(RESAMPLES))
    return medians[LOW], medians[HIGH]


def bootstrap(ratios: DataFrame, keys: list[str] = GROUP, value: str = "ratio", order: str = "trial") -> DataFrame:
    """keys, median, low, high. A group is the trials of one condition, resampled in the order of order; without that column, in ascending order.

    Small groups are done where they are gathered. The values of a larger one, 8
    bytes each, go to up to BLOCKS tasks, each of which makes its share of the
    resamples from its place among the random numbers on. Nulls count as NaN,
    and a group in which a median may be NaN is not dealt out.
    """
    order = order if order in ratios.columns else value
    by, n_keys = list(dict.fromkeys([order, value])), len(keys)
    typed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ratios.select(*keys).schema.fields) + "median double, low double, high double, "

    def gathered(group: pa.Table) -> pa.Table:
        values = group.select(by).to_pandas().sort_values(by)[value].to_numpy(float)
        blocks = 1 if not _has_order(values) else min(BLOCKS, -(-len(values) * RESAMPLES // BLOCK_DRAWS))
        low, high = bootstrap_bounds(values.tolist()) if blocks == 1 else (None, None)
        out = group.select(keys).slice(0, 1)
        for name, x, kind in [("median", statistics.median(values.tolist()), pa.float64()), ("low", low, pa.float64()), ("high", high, pa.float64()), ("_blocks", blocks, pa.int32()), ("_values", values.tobytes() if blocks > 1 else None, pa.binary())]:
            out = out.append_column(name, pa.array([x], kind))
        return out

    def share(batches):
        for b in batches:
            medians = []
            for blocks, block, values in zip(b["_blocks"].to_pylist(), b["_block"].to_pylist(), b["_values"]):
                medians.append(resampled(np.frombuffer(values.as_buffer()), RESAMPLES * block // blocks, RESAMPLES * (block + 1) // blocks) if values.is_valid else None)
            yield pa.RecordBatch.from_arrays([*b.columns[: n_keys + 3], pa.array(medians, pa.list_(pa.float64()))], [*b.schema.names[: n_keys + 3], "_medians"])

    groups = ratios.select(*dict.fromkeys([*keys, order, value])).withColumn(value, F.col(value).cast("double")).groupBy(*keys).applyInArrow(gathered, typed + "_blocks int, _values binary")
    # by a number, as the tasks' work does not show in their bytes
    dealt = groups.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).repartition(4 * ratios.sparkSession.sparkContext.defaultParallelism, *keys, "_block")
    whole = dealt.mapInArrow(share, typed + "_medians array<double>").groupBy(*keys).agg(F.first("median").alias("median"), F.first("low").alias("low"), F.first("high").alias("high"), F.sort_array(F.flatten(F.collect_list("_medians"))).alias("_medians"))
    return whole.select(*keys, "median", *[F.coalesce(b, F.get("_medians", F.lit(place))).alias(b) for b, place in (("low", LOW), ("high", HIGH))])


def regressions(bounds: DataFrame) -> DataFrame:
    """Of bootstrap(), the conditions that are slower."""
    return bounds.filter((F.col("median") < SLOWER) & (F.col("high") < 1))


def incomplete(rows: DataFrame, trials: int, keys: list[str] = GROUP) -> DataFrame:
    """keys, backend, trials, distinct_trials of conditions with another number of trials, or with one twice."""
    n = rows.groupBy(*keys, "backend").agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("trial").alias("distinct_trials"))
    return n.filter((F.col("trials") != trials) | (F.col("distinct_trials") != trials))


def unpaired(rows: DataFrame, one: str, other: str, keys: list[str] = GROUP) -> DataFrame:
    """keys, trial of one backend that the other lacks."""
    side = lambda b: rows.filter(F.col("backend") == b).select(*keys, "trial")
    return side(one).join(side(other), [*keys, "trial"], "left_anti")


def first_metric(rows: DataFrame, metrics: list[str], keys: list[str] = GROUP) -> DataFrame:
    """keys, metric, value: of each row the first metric that it has; what a CSV export writes."""
    name = F.coalesce(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in metrics])
    return rows.select(*keys, name.alias("metric"), F.coalesce(*[F.col(m).cast("double") for m in metrics]).alias("value"))


def percentile(rows: DataFrame, value: str, percents: list[int], keys: list[str]) -> DataFrame:
    """keys, percent, n, value: nearest rank (from 0: (n - 1) * percent div 100); null where there are too few samples. Nulls are the smallest values.

    Equal values are counted first. Approximate quantiles cut each group's values
    into PARTS, whose sizes tell in which part a rank lies; only that part of a
    group is put in order, so no task sorts a whole group.
    """
    same = lambda pairs: reduce(and_, [x.eqNullSafe(y) for x, y in pairs], F.lit(True))
    counted = rows.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("times"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 1000).alias("cuts"), F.count(F.lit(1)).alias("n"))
    cut = counted.join(cuts, on=same([(counted[k], cuts[k]) for k in keys])).select(*[counted[k] for k in keys], "value", "times", "n", F.coalesce(F.size(F.array_distinct(F.filter("cuts", lambda c: c < F.col("value")))), F.lit(0)).alias("part"))
    parts = cut.groupBy(*keys, "part").agg(F.sum("times").alias("rows"), F.first("n").alias("n"))
    ordered = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    places = parts.withColumn("before", F.coalesce(F.sum("rows").over(ordered), F.lit(0)))
    wanted = places.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    wanted = wanted.withColumn("at", F.call_function("div", (F.col("n") - 1) * F.col("percent"), F.lit(100).cast("long"))).filter("before <= at and at < before + rows")
    wanted = wanted.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("part").alias("w_part"), "percent", "at", "before")
    inside = cut.join(wanted, on=same([(F.col(k), F.col(f"w_{k}")) for k in keys]) & (F.col("part") == F.col("w_part")))
    run = Window.partitionBy(*keys, "percent").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)  # of one part
    reached = inside.withColumn("first", F.col("before") + F.coalesce(F.sum("times").over(run), F.lit(0))).filter("first <= at and at < first + times")
    needed = F.coalesce(*[F.when(F.col("percent") == p, n) for p, n in NEEDED.items()], F.lit(1))
    return reached.select(*keys, "percent", "n", F.when(F.col("n") >= needed, F.col("value")).alias("value"))


def nearest_rank(values: list[float], percent: int) -> float | None:
    """The same on the driver."""
    return sorted(values)[(len(values) - 1) * percent // 100] if values and len(values) >= NEEDED.get(percent, 1) else None


def two_levels(rows: DataFrame, current: str, other: str, keys: list[str] = ["case", "scenario", "stage"]) -> DataFrame:  # noqa: B006
    """keys, median, other_median, ratio_median, ratio_least, ratio_most, peak_rss: medians of both backends, their trials' ratios, and the median of the current one's memory (peak_rss of rows)."""
    own = rows.filter(F.col("backend") == current).groupBy(*keys).agg(F.median("duration").alias("median"), F.median("peak_rss").alias("peak_rss"))
    theirs = rows.filter(F.col("backend") == other).groupBy(*keys).agg(F.median("duration").alias("other_median"))
    ratios = summary(paired_ratios(rows, current, other, "duration", keys), "ratio", keys).select(*keys, F.col("median").alias("ratio_median"), F.col("least").alias("ratio_least"), F.col("most").alias("ratio_most"))
    return own.join(theirs, keys).join(ratios, keys).select(*keys, "median", "other_median", "ratio_median", "ratio_least", "ratio_most", "peak_rss")


def strided(rows: DataFrame, order: str, most: int = 10_000) -> DataFrame:
    """Every ceil(n / most)-th row in the order of a column that counts from 0 without gaps."""
    stride = max(1, math.ceil(rows.count() / most))
    return rows.filter(F.col(order) % stride == 0)
