"""The merge of versions: of each key the one with the highest sequence number.

A tombstone wins like any version and is dropped only after that; dropped
before, it would bring an older value back. The merge is associative and
idempotent, so runs may be merged one by one, all at once or raw.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FORMS = ("max_by", "window", "join")


def latest(log: DataFrame, key: str = "key", seq: str = "seq", *, form: str = "max_by") -> DataFrame:
    """The newest version of each key, tombstones with them; all columns of log.

    max_by sums up before the shuffle, in a hash aggregate while all columns are
    of fixed width; window drops all but the first row of each key on the map
    side; join (a hash aggregate of the sequence numbers, joined back) keeps wide
    values out of the aggregate. Equal sequence numbers do not occur in a log;
    where runs are merged that have some, merge_runs(ties=True) tells them apart.
    """
    others = [c for c in log.columns if c not in (key, seq)]
    if form == "max_by":
        return log.groupBy(key).agg(*[F.max_by(c, seq).alias(c) for c in others], F.max(seq).alias(seq)).select(log.columns)
    if form == "window":
        newest = Window.partitionBy(key).orderBy(F.desc(seq))
        return log.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place")
    if form == "join":
        return log.join(log.groupBy(key).agg(F.max(seq).alias(seq)), [key, seq]).select(log.columns)
    raise ValueError(f"form is one of {FORMS}")


def live(log: DataFrame, key: str = "key", seq: str = "seq", value: str = "value", *, form: str = "max_by") -> DataFrame:
    """The newest version of each key that is not deleted."""
    return latest(log, key, seq, form=form).filter(F.col(value).isNotNull())


def at_sequence(log: DataFrame, last: int, seq: str = "seq") -> DataFrame:
    """The log as it was when its last sequence number was last."""
    return log.filter(F.col(seq) <= last)


def merge_runs(runs: list[DataFrame], key: str = "key", seq: str = "seq", value: str = "value", *, drop_tombstones: bool = False, ties: bool = False) -> DataFrame:
    """Runs (one row for each key) merged into one.

    Tombstones may be dropped only if every live run takes part: an older run
    that does not could still hold the value. One run alone needs no merge.
    ties: of equal sequence numbers of a key the run that comes first counts.
    """
    if ties and len(runs) > 1:
        # the sequence number and, against it, the run's place are compared together
        both = reduce(DataFrame.unionByName, [r.withColumn("_age", F.struct(F.col(seq), F.lit(-i).alias("run"))) for i, r in enumerate(runs)])
        merged = latest(both, key, "_age").select(runs[0].columns)
    else:
        merged = runs[0] if len(runs) == 1 else latest(reduce(DataFrame.unionByName, runs), key, seq)
    return merged.filter(F.col(value).isNotNull()) if drop_tombstones else merged


def repeated_sequences(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Sequence numbers that a log has more than once; empty for a valid one."""
    return log.groupBy(seq).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
