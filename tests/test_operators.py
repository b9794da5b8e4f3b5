import itertools
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog import functions as K
from tidelog.errors import InvalidConfig
from tidelog.functions.twister import random_after
from tidelog.operators import compaction, inspection, lww, reads, report
from tidelog.operators.ranges import OPEN, KeyRange, excluded, included, prefix_range, successor
from tidelog.schema import LOG, Options
from tidelog.sources import oplog

def generated_runs(seed, runs=3, keys=9, writes=8):
    """Runs of (sequence, key, value or None), numbered over all of them in an order that mixes the runs."""
    rng, out = K.XorShift(seed), {r: {} for r in range(runs)}
    for seq in range(1, runs * writes + 1):
        k = bytes([97 + rng.below(keys)]) * (1 + rng.below(2))
        out[rng.below(runs)][k] = (seq, k, None if rng.below(4) == 0 else b"%d" % seq)
    return {r: list(x.values()) for r, x in out.items()}


def model(records):
    """The newest version of each key."""
    newest = {}
    for seq, k, v in sorted(records):
        newest[k] = (seq, v)
    return newest


def rows(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


@pytest.mark.parametrize("form", lww.FORMS)
def test_newest_wins_in_any_run(spark, form):
    records = [r for run in generated_runs(5).values() for r in run]
    want = {k: v for k, (_, v) in model(records).items() if v is not None}
    assert rows(lww.live(oplog.frame(spark, records), form=form)) == want and len(want) < len(model(records))


def test_merge_in_any_order_and_grouping(spark):
    runs = generated_runs(11)
    frames = {i: oplog.frame(spark, r) for i, r in runs.items()}
    want = sorted((k, seq, v) for k, (seq, v) in model([r for run in runs.values() for r in run]).items())
    for order in itertools.permutations(runs):
        two = lww.merge_runs([frames[order[0]], frames[order[1]]])
        assert sorted((bytes(r.key), r.seq, r.value and bytes(r.value)) for r in lww.merge_runs([two, frames[order[2]]]).collect()) == want


def test_partial_merge_keeps_tombstones(spark):
    runs = generated_runs(3)
    want = {k: v for k, (_, v) in model(runs[0] + runs[1]).items()}
    merged = lww.merge_runs([oplog.frame(spark, runs[0]), oplog.frame(spark, runs[1])])
    assert {bytes(r.key): r.value and bytes(r.value) for r in merged.collect()} == want and None in want.values()
    alone = lww.merge_runs([oplog.frame(spark, runs[2])], drop_tombstones=True)
    assert rows(alone) == {k: v for _, k, v in runs[2] if v is not None}


def test_equal_sequence_numbers(spark):
    runs = [oplog.frame(spark, [(5, b"k", b"%d" % i), (i + 1, b"m", b"%d" % i), (5, b"n", None if i == 0 else b"x")]) for i in range(3)]
    assert rows(lww.merge_runs(runs, ties=True, drop_tombstones=True)) == {b"k": b"0", b"m": b"2"}
    assert rows(lww.merge_runs(runs[::-1], ties=True, drop_tombstones=True)) == {b"k": b"2", b"m": b"2", b"n": b"x"}


LETTERS = [b"\x00", b"M", b"\xff"]
KEYS = [b"", *LETTERS, *(x + y for x in LETTERS for y in LETTERS)]
BOUNDS = [OPEN, *(f(k) for k in [*KEYS[:9:2], b"L", b"MZ", b"\xff\xff\x00"] for f in (included, excluded))]


def test_all_pairs_of_bounds(spark):
    log = oplog.frame(spark, [(i + 1, k, b"v") for i, k in enumerate(KEYS)]).cache()
    for n, (lo, hi) in enumerate(itertools.product(BOUNDS, BOUNDS)):
        if lo.value is not None and hi.value is not None and lo.value > hi.value:
            with pytest.raises(InvalidConfig):
                KeyRange(lo, hi)
            continue
        r = KeyRange(lo, hi)
        above = lambda k, lo=lo: lo.value is None or (k >= lo.value if lo.included else k > lo.value)
        below = lambda k, hi=hi: hi.value is None or (k <= hi.value if hi.included else k < hi.value)
        want = sorted(k for k in KEYS if above(k) and below(k))
        assert [k for k in sorted(KEYS) if r.holds(k)] == want
        if r.is_empty():
            assert not want
        elif want:
            assert r.overlaps(min(want), max(want))
        if n % 7 == 0:
            assert sorted(rows(reads.scan(log, r))) == want


def test_prefixes(spark):
    assert successor(b"a\xff") == b"b" and successor(b"\xff") is None and successor(b"") is None
    log = oplog.frame(spark, [(1, b"user:1", b"x"), (2, b"user:10", b"y"), (3, b"user:2", b"z"), (4, b"\xff\xff", b"w")])
    assert sorted(rows(reads.scan(log, prefix_range(b"user:1")))) == [b"user:1", b"user:10"]
    assert sorted(rows(reads.scan(log, prefix_range(b"\xff")))) == [b"\xff\xff"]
    assert len(rows(reads.scan(log, prefix_range(b"")))) == 4


def test_range_reaches_the_scan(spark, tmp_path):
    oplog.frame(spark, [(i + 1, bytes([i]), b"v") for i in range(9)]).write.parquet(str(tmp_path / "run"))
    plan = reads.scan(spark.read.schema(LOG).parquet(str(tmp_path / "run")), KeyRange(included(b"\x02"), excluded(b"\x05")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


def test_counts_and_empty_logs(spark):
    empty = spark.createDataFrame([], LOG)
    assert reads.counts(empty).first().asDict() == {"live_keys": 0, "deleted_keys": 0, "versions": 0}
    assert not reads.scan(empty).count() and not lww.repeated_sequences(empty).count()
    assert inspection.rotation_charge(empty).first().charge == 0


def picked_by_hand(files, threshold):
    """The oldest files of the smallest power of two that has enough of them, in the order given."""
    for power in range(63):
        fit = sorted(i for i, size in files if 2**power <= max(size, 1) < 2 ** (power + 1))
        if len(fit) >= threshold:
            return [i for i, _ in files if i in fit[:threshold]]
    return []


@pytest.mark.parametrize("seed", range(8))
def test_tiered_pick(spark, seed):
    rng = K.XorShift(seed + 1)
    files, threshold = [(i, rng.next() >> (1 + rng.below(60))) for i in range(rng.below(40))], 2 + rng.below(4)
    files.sort(key=lambda f: f[1] % 7)
    want = picked_by_hand(files, threshold)
    assert compaction.pick(files, "size_tiered", threshold) == want
    got = compaction.tiered_pick(spark.createDataFrame(files, "id long, bytes long"), threshold)
    assert sorted(r.id for r in got.collect()) == sorted(want)
    assert compaction.pick(files, "full", threshold) == ([i for i, _ in files] if len(files) >= threshold else [])


def test_fan_in(spark):
    rng = K.XorShift(9)
    for n in range(0, 24):
        costs = [1 + rng.below(compaction.BUFFER_BUDGET // (1 + rng.below(20))) for _ in range(n)]
        fits = max([m for m in range(n + 1) if sum(costs[:m]) <= compaction.BUFFER_BUDGET and m <= 16], default=0)
        want = min(n, max(2, fits))
        assert compaction.fan_in(costs) == want
        if n % 6 == 1:
            assert compaction.fan_in_frame(spark.createDataFrame(list(enumerate(costs)), "pos long, cost long")).first().inputs == want


def test_size_class(spark):
    sizes = [0, *(2**p + d for p in range(0, 63, 5) for d in (-1, 0, 1) if 0 < 2**p + d < 2**63)]
    assert [K.size_class_of(x) for x in sizes] == [max(x, 1).bit_length() - 1 for x in sizes]
    got = spark.createDataFrame([(x,) for x in sizes], "x long").select("x", K.size_class(F.col("x")).alias("c")).collect()
    assert all(r.c == K.size_class_of(r.x) for r in got)


def test_ordered_keys(spark):
    got = [bytes(r[0]) for r in spark.range(0, 1000, 37).select(K.ordered_key(F.col("id"))).collect()]
    assert got == [i.to_bytes(8, "big") for i in range(0, 1000, 37)]


@pytest.mark.parametrize("bad", [{"memtable_size_limit": 0}, {"max_immutable_memtables": 0}, {"block_size": 63}, {"bloom_filter_bits_per_key": 31}, {"compaction_file_threshold": 1}, {"max_value_size": 32 << 20}, {"compaction_style": "other"}])
def test_options(bad):
    with pytest.raises(InvalidConfig):
        Options(**bad).validate()
    Options(block_cache_capacity=0).validate()


def test_percentiles(spark):
    rng = K.XorShift(4)
    groups = {"a": [float(rng.below(50)) for _ in range(500)], "b": [1.0], "c": [7.5] * 300 + [float(rng.below(10**9)) for _ in range(200)], None: [float(i) for i in range(25)], "d": [None] * 9 + [2.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double")
    got = {(r.g, r.percent): (r.n, r.value) for r in report.percentile(df, "v", [0, 50, 95, 99, 100], ["g"]).collect()}
    for g, values in groups.items():
        placed = sorted(values, key=lambda v: (v is not None, v))
        for p in (0, 50, 95, 99, 100):
            enough = len(values) >= {95: 20, 99: 100}.get(p, 1)
            assert got[g, p] == (len(values), placed[(len(values) - 1) * p // 100] if enough else None), (g, p)
            if g != "d":
                assert report.nearest_rank(values, p) == got[g, p][1]
    assert report.percentile(df.limit(0), "v", [50], ["g"]).count() == 0
    assert report.percentile(df.filter("g = 'a'"), "v", [50], []).first().value == got["a", 50][1]


def test_bootstrap_takes_trials_in_their_order(spark):
    values = [0.93, 1.08, 0.9, 1.02, 0.97, 0.88, 1.1, 0.95]
    rng = random.Random(report.SEED)
    medians = sorted(statistics.median(rng.choices(values, k=len(values))) for _ in range(report.RESAMPLES))
    ratios = spark.createDataFrame([("x", t, v) for t, v in reversed(list(enumerate(values)))], "g string, trial int, ratio double")
    one = report.bootstrap(ratios, ["g"]).first()
    assert (one.low, one.high, one.median) == (medians[report.LOW], medians[report.HIGH], statistics.median(values))
    slower = report.bootstrap(ratios.withColumn("ratio", F.col("ratio") - 0.2), ["g"])
    assert report.regressions(slower).count() == 1 and report.regressions(report.bootstrap(ratios.drop("trial"), ["g"])).count() == 0


def plain_medians(values):
    rng = random.Random(report.SEED)
    return [statistics.median(rng.choices(values, k=len(values))) for _ in range(report.RESAMPLES)]


def test_bootstrap_of_large_groups_is_fast():
    """the same bounds as by lists and sorting, in well under a third of the time."""
    rng = K.XorShift(31)
    values = [rng.below(10**6) / 1000 for _ in range(2001)]
    start = time.perf_counter()
    medians = sorted(plain_medians(values))
    plain = time.perf_counter() - start
    start = time.perf_counter()
    assert report.bootstrap_bounds(values) == (medians[report.LOW], medians[report.HIGH])
    assert time.perf_counter() - start < plain / 3


def test_resamples_of_any_share():
    rng = K.XorShift(32)
    for n in (1, 2, 25, 40, 333):
        values = [float(rng.below(n)) / 7 for _ in range(n)]
        want = plain_medians(values)
        for first, last in ((0, report.RESAMPLES), (0, 1), (17, 1300), (3999, 4000)):
            assert report.resampled(np.array(values), first, last).tolist() == want[first:last], (n, first)


def test_bootstrap_deals_large_groups_out(spark, monkeypatch):
    monkeypatch.setattr(report, "BLOCK_DRAWS", 200_000)
    rng, inf = K.XorShift(33), float("inf")
    groups = {("a", 1): 1000, ("a", None): 301, (None, 1): 120, ("b", 2): 60, ("b", 3): 2, ("b", 4): 1}
    groups = {k: [rng.below(50) / 8 for _ in range(n)] for k, n in groups.items()} | {("c", 1): [inf, -inf] * 80, ("d", 1): [1.0, -inf, 2.0] * 50, ("c", 2): [float("nan") if i % 9 == 0 else float(i) for i in range(150)]}
    rows = [(*k, t, v) for k, values in groups.items() for t, v in enumerate(values)]
    rows.sort(key=lambda r: (r[3] != r[3], r[3], r[2]))  # not in the order of trials
    df = spark.createDataFrame([(*r[:3], None if r[2] == 9 and r[3] != r[3] else r[3]) for r in rows], "g string, h long, trial int, ratio double")
    got = {(r.g, r.h): r for r in report.bootstrap(df, ["g", "h"]).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        medians = sorted(plain_medians(values))
        assert repr(tuple(got[k])[2:]) == repr((statistics.median(values), medians[report.LOW], medians[report.HIGH])), k
    assert report.bootstrap(df.limit(0), ["g", "h"]).collect() == []


def test_random_numbers_from_any_place_on():
    for n in (0, 1, 311, 312, 313, 9968, 9969, 123_457):
        rng = random.Random(report.SEED)
        for _ in range(n):
            rng.random()
        assert random_after(report.SEED, n).random_sample(1500).tolist() == [rng.random() for _ in range(1500)], n


def test_many_ranges_of_all_widths(spark):
    rng = K.XorShift(21)
    log = spark.createDataFrame([(rng.below(4000) - 500, i + 1, i if rng.below(5) else None) for i in range(900)], "key long, seq long, value long")
    alive = {r.key: r.value for r in reads.scan(log).collect()}
    ranges = [(i, low, low + rng.below(2 ** rng.below(13))) for i, low in enumerate(rng.below(4200) - 600 for _ in range(60))] + [(99, -(2**40), 2**40), (98, 5, 5), (97, 9, 2)]
    got = reads.many_ranges(log, spark.createDataFrame(ranges, "range_id long, low long, high long"))
    assert sorted((r.range_id, r.key, r.value) for r in got.collect()) == sorted((i, k, v) for i, lo, hi in ranges for k, v in alive.items() if lo <= k < hi)
    assert reads.many_ranges(log, spark.createDataFrame([(1, 3, 3)], "range_id long, low long, high long")).collect() == []


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2.5, "d": {"e": true, "f": "x", "g": 3}}}')], "id int, j string")
    assert {r.path: r.number for r in report.flatten(df, "j", ["id"]).collect()} == {"a": 1.0, "b.c": 2.5, "b.d.g": 3.0}


def test_two_levels_and_files(spark, tmp_path):
    from tidelog.sources import reports

    rows = [("s", "c", "x", "load", b, t, sec, None, None, 10.0 * t) for t in (1, 2, 3) for b, sec in (("engine", 1.0 * t), ("other", 2.0 * t))]
    reports.write_lines(spark.createDataFrame(rows, reports.ROWS), str(tmp_path / "lines"))
    back = report.duration(reports.read_lines(spark, str(tmp_path / "lines")))
    r = report.two_levels(back, "engine", "other").first()
    assert (r.median, r.other_median, r.ratio_median, r.ratio_least, r.ratio_most, r.peak_rss) == (2.0, 4.0, 2.0, 2.0, 2.0, 20.0)
    reports.write_csv(report.first_metric(back, ["us", "seconds"]), str(tmp_path / "csv"))
    assert {x.metric for x in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()} == {"seconds"}


def test_numbers_at_any_depth(spark):
    import json

    deep = 1.5
    for k in "gfedcba":
        deep = {k: deep, "n": True}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"x": 2}'), (3, None)], "id int, j string")
    assert {(r.id, r.path, r.number) for r in report.flatten(rows, "j", ["id"]).collect()} == {(1, "a.b.c.d.e.f.g", 1.5), (2, "x", 2.0)}
