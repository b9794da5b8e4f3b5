import struct
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.engine import Store, WriteBatch
from tidelog.functions import XorShift
from tidelog.operators.ranges import KeyRange, excluded, included
from tidelog.schema import MAX_SEQUENCE, Options
from tidelog.sources import files, manifest, oplog

TINY = Options(memtable_size_limit=2048, block_size=256, block_cache_capacity=8192, compaction_file_threshold=3)


def content(store, range_=KeyRange()):
    return [(bytes(r.key), bytes(r.value)) for r in store.scan(range_).collect()]


@pytest.fixture(autouse=True)
def no_faults():
    files.FAULTS.clear()
    yield
    files.FAULTS.clear()


def mutate(rng, keys, n):
    """n operations (key, value or None) on a few keys of one to three bytes, empty keys and values among them."""
    return [(bytes([65 + rng.below(keys)]) * rng.below(4), None if rng.below(3) == 0 else b"%d" % rng.below(50) * rng.below(3)) for _ in range(n)]


def apply(model, operations):
    for k, v in operations:
        if v is None:
            model.pop(k, None)
        else:
            model[k] = v


@pytest.mark.parametrize("seed", [2, 31])
def test_versions_in_layers(spark, tmp_path, seed):
    """Two runs and memory that shadow each other."""
    rng, model = XorShift(seed), {}
    with Store(spark, str(tmp_path / "s"), TINY) as s:
        for layer in range(3):
            operations = mutate(rng, 6, 15)
            for k, v in operations:
                s.delete(k) if v is None else s.put(k, v)
            apply(model, operations)
            if layer < 2:
                s.flush()
        live = sorted(model.items())
        assert content(s) == live
        for k in sorted({k for k, _ in mutate(rng, 7, 12)}):
            assert s.get(k) == model.get(k)
            assert s.seek(k) == next((x for x in live if x[0] >= k), None) and s.seek(k, after=True) == next((x for x in live if x[0] > k), None)
        lo, hi = live[0][0], live[-1][0]
        assert content(s, KeyRange(excluded(lo), included(hi))) == live[1:] and content(s, KeyRange(included(lo), excluded(hi))) == live[:-1]
        wanted = [*model, b"no such key"]
        got = s.multi_get(spark.createDataFrame([(bytearray(k),) for k in wanted], "key binary")).collect()
        assert {bytes(r.key): bytes(r.value) for r in got} == model


def test_batches_count_and_last_one_wins(spark, tmp_path):
    rng, model, count = XorShift(77), {}, 0
    with Store(spark, str(tmp_path / "s"), TINY) as s:
        for n in (1, 6, 0, 9, 4):
            operations, b = mutate(rng, 3, n), WriteBatch()
            for k, v in operations:
                b.delete(k) if v is None else b.put(k, v)
            s.write_batch(b)
            apply(model, operations)
            count += n
            assert s.seq == count and len(b) == n and b.is_empty() == (n == 0)
            if n == 6:
                s.flush()
        assert content(s) == sorted(model.items())


def test_store_in_memory(spark):
    s, rng, model = Store(spark), XorShift(13), {}
    operations = mutate(rng, 4, 40)
    for k, v in operations:
        s.delete(k) if v is None else s.put(k, v)
    apply(model, operations)
    assert s.seq == 40 and content(s) == sorted(model.items()) and set(s.active) == set(model)
    assert s.charge == sum(48 + len(k) + len(v) for k, v in model.items())
    for k in model:
        s.delete(k)
    assert s.charge == 0 and content(s) == []
    s.flush()
    s.compact()


def test_bad_batches_change_nothing(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), Options(max_key_size=4, max_value_size=4)) as s:
        for bad in (WriteBatch().put(b"ok", b"ok").put(b"12345", b""), WriteBatch().put(b"ok", b"12345")):
            with pytest.raises(errors.InvalidConfig):
                s.write_batch(bad)
        assert s.seq == 0 and s.get(b"ok") is None
        s.seq = MAX_SEQUENCE
        with pytest.raises(errors.SequenceExhausted):
            s.put(b"a", b"b")


def test_sequence_outlives_the_data(spark, tmp_path):
    path, names = str(tmp_path / "s"), [b"%d" % i for i in range(7)]
    with Store(spark, path, TINY) as s:
        for action in (lambda k: s.put(k, k), s.delete):
            for k in names:
                action(k)
        s.compact()
        assert not s.manifest.runs and not list((s.folder / "runs").iterdir())
    with Store(spark, path, TINY) as s:
        assert s.seq == 2 * len(names)
        s.put(b"more", b"")
        assert s.seq == 2 * len(names) + 1


def test_differential_model(spark, tmp_path):
    rng, model, path = XorShift(7), {}, str(tmp_path / "s")
    s = Store(spark, path, TINY)
    for step in range(600):
        key = struct.pack(">Q", rng.below(48))
        if rng.below(3):
            value = bytes([rng.below(256)]) * rng.below(60)
            s.put(key, value)
            model[key] = value
        else:
            s.delete(key)
            model.pop(key, None)
        if step % 200 == 199:
            assert content(s) == sorted(model.items())
            s.close()
            s = Store(spark, path, TINY)
            probe = struct.pack(">Q", rng.below(48))
            assert s.get(probe) == model.get(probe)
    s.compact()
    assert len(s.manifest.runs) <= 1 and content(s) == sorted(model.items())
    before = s.manifest
    s.compact()
    assert s.manifest == before
    s.close()


def test_snapshots_stay(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), TINY) as s:
        s.put(b"a", b"1")
        s.flush()
        with s.snapshot() as old:
            s.put(b"a", b"2")
            s.delete(b"b")
            s.compact()
            assert [(bytes(r.key), bytes(r.value)) for r in old.scan().collect()] == [(b"a", b"1")]
            assert s.dropped
        assert not s.dropped and content(s) == [(b"a", b"2")]


def test_partial_compaction_keeps_deletions(spark, tmp_path):
    large = spark.range(300).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"old" * 30).alias("value"), F.col("id").alias("ord"))
    with Store(spark, str(tmp_path / "s"), Options(compaction_file_threshold=2)) as s:
        s.ingest(large)
        for gen in (b"one", b"two"):
            s.delete(b"17")
            for i in range(20, 32):
                s.put(b"%d" % i, gen * 30)
            s.flush()
        assert len(s.manifest.runs) == 2  # the two small ones became one
        assert s.get(b"17") is None and s.get(b"25") == b"two" * 30 and s.get(b"40") == b"old" * 30
        s.compact()
        assert s.scan().count() == 299 and s.activity_stats()["compactions"] == 2 and s.manifest.runs[0].records == 299


def test_get_prunes_runs(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), Options(compaction_file_threshold=9)) as s:
        for k in (b"a", b"m", b"x"):
            s.put(k, k)
            s.flush()
        s.counters["runs_read"] = 0
        assert s.get(b"m") == b"m" and s.counters["runs_read"] == 1
        assert s.get(b"zz") is None and s.counters["runs_read"] == 1
        assert content(s, KeyRange(included(b"b"), excluded(b"n"))) == [(b"m", b"m")] and s.counters["runs_read"] == 2


def test_one_store_to_a_folder(spark, tmp_path):
    (tmp_path / "alias").symlink_to(tmp_path / "s")
    with Store(spark, str(tmp_path / "s")), pytest.raises(errors.Locked):
        Store(spark, str(tmp_path / "alias"))
    s = Store(spark, str(tmp_path / "s"))
    s.close()
    with pytest.raises(errors.Closed):
        s.put(b"a", b"b")


@pytest.mark.parametrize("place", ["wal.before_write", "wal.before_sync", "wal.after_sync", "run.before_write", "run.after_write", "manifest.before_rename", "manifest.after_rename"])
def test_failures_lose_nothing_that_was_acknowledged(spark, tmp_path, place):
    path = str(tmp_path / "s")
    s = Store(spark, path, TINY)
    s.put(b"kept", b"1")

    def fail():
        raise OSError("fault")

    files.FAULTS[place] = fail
    with pytest.raises(errors.Background):
        s.put(b"new", b"2") if place.startswith("wal") else s.flush()
    with pytest.raises(errors.Background):
        s.get(b"kept")
    files.FAULTS.clear()
    s.close()
    with Store(spark, path, TINY) as s:
        assert s.get(b"kept") == b"1"
        assert s.get(b"new") in (None, b"2")
        s.put(b"more", b"3")
        s.flush()
        assert dict(content(s))[b"kept"] == b"1"


def test_every_cut_and_flip_of_the_log(tmp_path):
    path = tmp_path / "1.log"
    w = oplog.Writer(path)
    commits = [[(1, b"a", b"1")], [(2, b"b", None), (3, b"c", b"")]]
    for c in commits:
        w.append(c)
    w.close()
    whole = path.read_bytes()
    assert oplog.replay(path, 0, newest=True) == (commits, 3)
    for n in range(len(whole)):
        path.write_bytes(whole[:n])
        got, _ = oplog.replay(path, 0, newest=True)
        assert got == commits[: len(got)]
        path.write_bytes(whole[:n])
        if len(oplog.MAGIC) < n and n not in (len(oplog.MAGIC), len(oplog.MAGIC) + len(oplog.encode(commits[0]))):
            with pytest.raises(errors.Corruption):
                oplog.replay(path, 0, newest=False)
    for n in range(len(whole)):
        path.write_bytes(whole[:n] + bytes([whole[n] ^ 0x40]) + whole[n + 1 :])
        try:
            got, _ = oplog.replay(path, 0, newest=True)
            assert got == commits[: len(got)] and len(got) < 2
        except errors.Corruption:
            pass


def test_manifest_is_checked(tmp_path):
    m = manifest.Manifest(3, 2, 9, (manifest.Run(1, 10, 1, "61", "61", 9),))
    manifest.save(tmp_path, m)
    assert manifest.load(tmp_path) == m
    data = (tmp_path / manifest.NAME).read_bytes()
    for n in range(len(data)):
        (tmp_path / manifest.NAME).write_bytes(data[:n])
        with pytest.raises(errors.Corruption):
            manifest.load(tmp_path)
    for bad in ('{"version":1,"wal_floor":0,"max_seq":1,"runs":[{"run_id":1,"bytes":1,"records":1,"min_key":"","max_key":"","max_seq":2}]}', '{"version":1}'):
        (tmp_path / manifest.NAME).write_bytes(f"{zlib.crc32(bad.encode()):08x} {bad}\n".encode())
        with pytest.raises(errors.Corruption):
            manifest.load(tmp_path)


def test_data_without_a_manifest(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        s.put(b"a", b"1")
    (tmp_path / "s" / manifest.NAME).unlink()
    with pytest.raises(errors.Corruption):
        Store(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "wal" / "strange").write_bytes(b"")
    with pytest.raises(errors.Corruption):
        Store(spark, str(tmp_path / "s"))


def test_inspection(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        for i in range(40):
            s.put(bytes([i]), b"v" * 200)
        s.delete(b"\x00")
        assert len(s.inspect()["active"]) == 32 and s.inspect()["active"][0] == (b"\x00", 41, None, 1, 0)
        s.flush()
        run = s.inspect()["tables"][0]
        shown = s.inspect_table(run.run_id).collect()
        assert len(shown) == 32 and shown[0].deleted and shown[1].value_bytes == 200 and len(shown[1].value) == 128
        assert s.table_metadata().first().records == 40 and s.stats()["run_records"] == 40
        with pytest.raises(errors.InvalidConfig):
            s.inspect_table(99)


def test_threads_see_whole_batches(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        def write():
            for g in range(30):
                s.write_batch(WriteBatch().put(b"x", bytes([g])).put(b"y", bytes([g])))

        t = threading.Thread(target=write)
        t.start()
        for _ in range(20):
            with s.snapshot() as snap:
                assert snap.memory.get(b"x", (0, 0))[1] == snap.memory.get(b"y", (0, 0))[1]
        t.join()


def test_streaming_ingest(spark, tmp_path):
    from tidelog import streaming

    spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"), 1), (bytearray(b"b"), bytearray(b"2"), 2), (bytearray(b"a"), None, 3)], "key binary, value binary, seq long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key binary, value binary, seq long").parquet(str(tmp_path / "in"))
    with Store(spark, str(tmp_path / "s")) as s:
        streaming.to_store(stream, s, str(tmp_path / "check")).awaitTermination(60)
        assert content(s) == [(b"b", b"2")]
    q = streaming.newest(stream).writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {bytes(r.key): r.seq for r in spark.table("newest").collect()} == {b"a": 3, b"b": 2}


def test_lifecycle(spark, tmp_path):
    """Load, open again, read, update half, delete a quarter, compact, verify."""
    path, n = str(tmp_path / "s"), 400
    key = lambda i: struct.pack(">Q", 2 * i)
    with Store(spark, path, Options(memtable_size_limit=16 << 10)) as s:
        for lo in range(0, n, 50):
            b = WriteBatch()
            for i in range(lo, lo + 50):
                b.put(key(i), b"0" * 64)
            s.write_batch(b)
    with Store(spark, path) as s:
        assert s.seq == n and s.scan().count() == n and s.get(struct.pack(">Q", 7)) is None
        b = WriteBatch()
        for i in range(0, n, 2):
            b.put(key(i), b"1" * 64)
        for i in range(0, n, 4):
            b.delete(key(i))
        s.write_batch(b)
        s.compact()
        assert dict(content(s)) == {key(i): (b"0" if i % 2 else b"1") * 64 for i in range(n) if i % 4}
        assert len(s.manifest.runs) == 1 and s.write_amplification() > 0


def folders(s):
    return len(list((s.folder / "runs").iterdir()))


def test_runs_go_when_their_readers_have(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), Options(compaction_file_threshold=99)) as s:
        for i in range(3):
            s.put(b"%d" % i, b"v")
            s.flush()
            assert len(content(s)) == i + 1
            assert s.multi_get(spark.createDataFrame([(bytearray(b"0"),)], "key binary")).count() == 1
        s.compact()
        assert len(s.manifest.runs) == folders(s) == 1
        kept = s.scan().filter("key > x'30'")  # the plan is held, the scan's own DataFrame is not
        s.put(b"9", b"v")
        s.compact()
        assert folders(s) == 2 and sorted(bytes(r.key) for r in kept.collect()) == [b"1", b"2"]
        del kept
        s.put(b"8", b"v")
        s.compact()
        assert folders(s) == 1


def test_get_while_runs_are_merged(spark, tmp_path):
    wrong, stop = [], threading.Event()
    with Store(spark, str(tmp_path / "s"), Options(compaction_file_threshold=99)) as s:
        s.put(b"k", b"0")
        s.flush()

        def look():
            while not stop.is_set():
                try:
                    if not (s.get(b"k") or b"").isdigit():
                        wrong.append("gone")
                except Exception as e:
                    wrong.append(e)

        t = threading.Thread(target=look)
        t.start()
        for g in range(1, 5):
            s.put(b"k", b"%d" % g)
            s.compact()
        stop.set()
        t.join()
        assert not wrong and s.get(b"k") == b"4"


def test_writers_and_readers_go_on_while_a_run_is_written(spark, tmp_path):
    started, go = threading.Event(), threading.Event()

    def hold():
        started.set()
        assert go.wait(60)

    with Store(spark, str(tmp_path / "s")) as s:
        s.put(b"a", b"1")
        files.FAULTS["run.before_write"] = hold
        t = threading.Thread(target=s.flush)
        t.start()
        assert started.wait(60)
        s.put(b"a", b"2")
        s.put(b"b", b"3")
        assert s.get(b"a") == b"2" and content(s) == [(b"a", b"2"), (b"b", b"3")]
        go.set()
        t.join()
        files.FAULTS.clear()
        assert s.manifest.runs[0].records == 1 and len(s.active) == 2 and content(s) == [(b"a", b"2"), (b"b", b"3")]


@pytest.mark.parametrize("background", [False, True])
def test_many_writers(spark, tmp_path, background):
    path = str(tmp_path / "s")
    with Store(spark, path, Options(memtable_size_limit=2048, max_immutable_memtables=1, compaction_file_threshold=3), background=background) as s:
        def write(n):
            for i in range(60):
                s.write_batch(WriteBatch().put(b"%d-%d" % (n, i), b"x" * 50).put(b"same", b"%d" % n))

        threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert s.seq == 360 and s.scan().count() == 181 and len(s.frozen) <= 2
    with Store(spark, path) as s:
        assert s.seq == 360 and s.scan().count() == 181
        s.compact()
        assert s.manifest.runs[0].records == 181


def test_a_failure_in_the_background_is_told(spark, tmp_path):
    def fail():
        raise OSError("fault")

    files.FAULTS["run.before_write"] = fail
    s = Store(spark, str(tmp_path / "s"), Options(memtable_size_limit=1), background=True)
    with pytest.raises(errors.Background):
        for i in range(10_000):
            s.put(b"%d" % i, b"v")
    s.close()
    files.FAULTS.clear()
    with Store(spark, str(tmp_path / "s")) as s:
        assert s.get(b"0") == b"v"


def test_a_large_ingest_is_of_several_files(spark, tmp_path, monkeypatch):
    from tidelog.sources import runs

    monkeypatch.setattr(runs, "FILE_BYTES", 100_000)
    rows = spark.range(4000).select(F.lpad(F.col("id").cast("string"), 6, "0").cast("binary").alias("key"), F.lit(b"v" * 100).alias("value"), F.col("id").alias("ord"))
    with Store(spark, str(tmp_path / "s")) as s:
        s.ingest(rows)
        run = s.manifest.runs[0]
        assert run.bytes == 4000 * 123
        parts = sorted((s.folder / "runs" / f"{run.run_id:012d}").glob("*.parquet"))
        assert len(parts) == 5
        bounds = [(r.lo, r.hi) for r in spark.read.parquet(*map(str, parts)).groupBy(F.input_file_name()).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect()]
        assert all(bytes(a[1]) < bytes(b[0]) for a, b in zip(bounds, bounds[1:], strict=False))
        s.put(b"000007", b"new")
        assert s.get(b"000007") == b"new" and s.scan().count() == 4000 and s.seq == 4001


def test_writes_during_an_ingest_are_newer(spark, tmp_path):
    path, rows = str(tmp_path / "s"), spark.range(50).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(b"bulk").alias("value"), F.col("id").alias("ord"))
    with Store(spark, path) as s:
        s.put(b"3", b"before")
        files.FAULTS["run.before_write"] = lambda: s.put(b"7", b"meanwhile") if s.get(b"7") is None else None
        s.ingest(rows)
        files.FAULTS.clear()
        assert s.get(b"3") == b"bulk" and s.get(b"7") == b"meanwhile"
    with Store(spark, path) as s:
        assert s.get(b"3") == b"bulk" and s.get(b"7") == b"meanwhile" and s.scan().count() == 50


def test_a_bloom_filter_skips_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    with Store(spark, str(tmp_path / "s")) as s:
        s.ingest(spark.range(2000).select((F.col("id") * 2).cast("string").cast("binary").alias("key"), F.lit(b"v").alias("value"), F.col("id").alias("ord")))
        part = next((s.folder / "runs").rglob("*.parquet"))
        at = pq.read_metadata(part)
        assert at.num_rows == 2000 and part.stat().st_size > 2000
        assert s.get(b"1001") is None and s.get(b"1000") == b"v"
        read = runs_read(spark, s, b"1001")
        assert read == 0 and runs_read(spark, s, b"1000") > 0


def runs_read(spark, s, key):
    """Rows that the scan of a point read gives to its filter."""
    from tidelog.sources import runs as r

    df = r.read(spark, str(s.folder / "runs" / f"{s.manifest.runs[0].run_id:012d}")).filter(F.col("key") == F.lit(key))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()
