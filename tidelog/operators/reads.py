"""Point, range and multi-key reads of a log: each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import lww
from tidelog.operators.ranges import KeyRange, OPEN, excluded, included


def scan(log: DataFrame, range_: KeyRange = KeyRange(), *, key: str = "key", seq: str = "seq", value: str = "value", at: int | None = None, unique: bool = False) -> DataFrame:
    """The live keys of a range. unique: log is a single run, which needs no merge.

    The range is applied below the merge. Values are filtered by the caller,
    above it: below, an older version would come back.
    """
    seen = range_.restrict(log, key)
    if at is not None:
        seen = lww.at_sequence(seen, at, seq)
    return seen.filter(F.col(value).isNotNull()) if unique else lww.live(seen, key, seq, value)


def get(log: DataFrame, wanted, *, key: str = "key", seq: str = "seq", value: str = "value", at: int | None = None) -> DataFrame:
    """The live version of one key, or no row."""
    return scan(log, KeyRange(included(wanted), included(wanted)), key=key, seq=seq, value=value, at=at)


def multi_get(log: DataFrame, keys: DataFrame, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """The live versions of the keys in keys, all of one snapshot. The semi-join comes before the merge, so other keys are not shuffled twice."""
    return lww.live(log.join(keys.select(key).distinct(), key, "left_semi"), key, seq, value)


def first(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    """The first n rows in key order, with their place from 0: a bounded sort, not a full one."""
    ordered = df.orderBy(key).limit(n)
    return ordered.withColumn("pos", (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))  # n rows


def seek(log: DataFrame, wanted, *, after: bool = False, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """The first live key from wanted on, or after it."""
    return scan(log, KeyRange(excluded(wanted) if after else included(wanted), OPEN), key=key, seq=seq, value=value).orderBy(key).limit(1)


def many_ranges(log: DataFrame, ranges: DataFrame, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """range_id and the live keys with low <= key < high, for ranges(range_id, low, high) over integer keys.

    A range is cut at multiples of a width of its own (its length, rounded up to
    a power of two), so it becomes two rows at most; a key meets them in the cell
    that it has at each width. Widths are collected: there are 64 at most. Only
    keys inside some range's bounds are merged.
    """
    ranges = ranges.filter("high > low").withColumn("width", F.length(F.bin(F.col("high") - F.col("low") - 1)).cast("int"))
    ranges = ranges.withColumn("width", F.when(F.col("high") - F.col("low") == 1, 0).otherwise(F.col("width")))
    bounds, widths = ranges.agg(F.struct(F.min("low"), F.max("high")), F.collect_set("width")).first()
    cell = lambda c, w: F.shiftright(c.cast("long"), w)
    cut = ranges.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.expr(f"shiftright(cast({e} as bigint), width)") for e in ("low", "high - 1")]))))
    if not widths:
        return log.limit(0).select(F.lit(None).cast(ranges.schema["range_id"].dataType).alias("range_id"), key, value)
    alive = lww.live(KeyRange(included(bounds[0]), excluded(bounds[1])).restrict(log, key), key, seq, value)
    cells = F.array(*[F.struct(F.lit(w).alias("width"), cell(F.col(key), w).alias("cell")) for w in sorted(widths)])
    alive = alive.withColumn("_at", F.explode(cells)).select(key, value, "_at.width", "_at.cell")
    return alive.join(cut, ["width", "cell"]).filter((F.col(key) >= F.col("low")) & (F.col(key) < F.col("high"))).select("range_id", key, value)


def counts(log: DataFrame, *, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """One row: live keys, deleted keys, versions."""
    newest = log.groupBy(key).agg(F.max_by(F.col(value).isNotNull(), seq).alias("alive"), F.count(F.lit(1)).alias("n"))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return newest.agg(one(F.col("alive")).alias("live_keys"), one(~F.col("alive")).alias("deleted_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("versions"))


def difference(old: DataFrame, new: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key and change (added, removed, changed) between two sets of live keys."""
    x, y = old.select(key, F.col(value).alias("_old")), new.select(key, F.col(value).alias("_new"))
    change: Column = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return x.join(y, key, "full_outer").select(key, change.alias("change")).filter("change is not null")
