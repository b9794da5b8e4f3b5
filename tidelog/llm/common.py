"""What the corpus operators share: table access, shared scratch space, word splitting and hashing.

Word hashing works on whole Arrow buffers: eight bytes of every word at a time are
mixed into its state, so that no Python object is made for a word. It is a chain,
not a polynomial, so texts of a regular build do not collide; digests of whole
texts are cryptographic, and those of spans are taken in a prime field.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import shutil
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; texts are a few KB, so a batch is a few MB, and fewer rows where they are long. Rows that a scan decodes at once.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 1000, 2 << 20, 512


def ship(module: str) -> None:
    """Pickles the module's functions by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process."""
    return sys.modules.setdefault("_tidelog_worker", types.ModuleType("_tidelog_worker")).__dict__.setdefault("cache", {})


def make_room() -> None:
    """Drops the vocabularies and automata that earlier operators left in this worker; they are made again where needed."""
    cache = worker_cache()
    for k in [k for k in cache if isinstance(k, tuple) or str(k).startswith("automaton ")]:
        del cache[k]
    trim()


def trim() -> None:
    """Gives memory that Python, Arrow and the C library hold free back to the system; a worker is reused and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's only
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that long texts do not pile up in a worker, and those of scans, whose texts stand in one array."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Where that is unset: the context's checkpoint folder, a temporary folder in
    local mode, which goes with the process, and the (shared) warehouse on a cluster.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master == "local" or sc.master.startswith("local["):
            base = tempfile.mkdtemp(prefix="tidelog-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders of the tables that this process has cut.
TABLES: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, and lost executors cost a read."""
    path = f"{scratch(df.sparkSession)}/tidelog-{uuid.uuid4().hex}"
    TABLES.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has cut, and says how many; results that read them must have been written before."""
    n, hadoop = len(TABLES), spark._jvm.org.apache.hadoop.fs.Path
    while TABLES:
        path = hadoop(TABLES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Parts that the rows of a hot key are dealt to; a key is hot if it has more than one in so many of all rows.
SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, by: str) -> DataFrame:
    """The inner join of left with right, which has each key once and, in weight, the number of left's rows with it.

    Rows of left with a hot key (there are fewer than SALTS of these) are dealt
    over SALTS parts by a hash of their column by, and right's row goes to each
    part. Keys are known by a hash; one that shares a hot one's is dealt too. The
    key's columns have the same types on both sides. right is read twice: it
    should be cut.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = [r[0] for r in right.filter(F.col(weight) * SALTS > total).select(F.xxhash64(*on)).collect()]  # fewer than SALTS rows
    right = right.drop(weight)
    if not hot:
        return left.join(right, on)
    (salt,) = fresh([*left.columns, *right.columns], "salt")
    is_hot, parts = F.xxhash64(*on).isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    dealt = left.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    copied = right.withColumn(salt, F.explode(F.when(is_hot, parts).otherwise(F.array(F.lit(0).cast("long")))))
    return dealt.join(copied, [*on, salt]).drop(salt)


def fresh(columns, *names: str) -> list[str]:
    """The names, each with underscores in front until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


# --- words ---------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on unsigned 64-bit integers (its constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd numbers that depend on nothing but their place."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(seed)) | np.uint64(1)


#: The prime of the spans' digests, and their base.
PRIME, BASE = (1 << 61) - 1, 0x0DB4F0B9175AE2165 % ((1 << 61) - 1)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME; both are below it."""
    low, mid = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    m = ah * bl + al * bh
    r = ((ah * bh) << np.uint64(1)) + (m >> np.uint64(30)) + ((m & mid) << np.uint64(31)) + al * bl
    return reduced(r)


def reduced(r: np.ndarray) -> np.ndarray:
    r = (r & np.uint64(PRIME)) + (r >> np.uint64(61))
    return np.where(r >= np.uint64(PRIME), r - np.uint64(PRIME), r)


def powers(n: int, base: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, kept by the worker."""
    cache = worker_cache()
    got = cache.get(name)
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
        got = np.empty(size, np.uint64)
        got[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            got[done : done + step] = times(got[:step], np.full(step, pow(base, done, PRIME), np.uint64))
            done += step
        if size <= 1 << 24:
            cache[name] = got
    return got[:n]


def running(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The sums, modulo PRIME, of values * BASE**place before each place of the array; one more than values."""
    x = times(reduced(values), powers(int(place.max()) + 1, BASE, "base powers")[place]) if len(values) else values
    low, high = np.zeros(len(x) + 1, np.uint64), np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x & np.uint64((1 << 31) - 1), out=low[1:])
    np.cumsum(x >> np.uint64(31), out=high[1:])
    return reduced(times(reduced(high), np.full(len(high), 1 << 31, np.uint64)) + reduced(low))


def between(before: np.ndarray, after: np.ndarray, start: np.ndarray) -> np.ndarray:
    """From running sums before and behind a span, and its first place: its digest, wherever it stands."""
    back = powers(int(start.max()) + 1 if len(start) else 1, pow(BASE, -1, PRIME), "base inverses")[start]
    return times(reduced(after + np.uint64(PRIME) - before), back)


#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the (string) array, and each row's start, one more than rows; null is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    up = (data >= 0x41) & (data <= 0x5A)
    return data + (up.astype(np.uint8) << np.uint8(5))


def words(data: np.ndarray, rows: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each row its first word's number, one more than rows."""
    inside = ~apart[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = len(data) > 0 and inside[0]
    edge[-1] = len(data) > 0 and inside[-1]
    if len(data):
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = np.unique(rows[1:-1])  # a row's end also ends a word
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts - 1] & inside[cuts]] if len(cuts) else cuts
    at = np.flatnonzero(edge)
    if len(data) == 0:
        at = at[:0]
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, rows)


#: The first so many bytes of eight.
PART = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: its length, then eight bytes after eight are mixed in."""
    out = np.empty(len(starts), np.uint64)
    step, i = 1 << 20, 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            s, n = starts[i:j] - lo, ends[i:j] - starts[i:j]
            h = mix(n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
            short = np.flatnonzero(n <= LONG_WORD)
            if len(short):
                whole = np.zeros(-(-(hi - lo) // 8) + 2, np.uint64)
                whole.view(np.uint8)[: hi - lo] = data[lo:hi]
                at, left, rows = s[short], n[short], short
                while len(rows):
                    unit, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
                    x = (whole[unit] >> shift) | (whole[unit + 1] << np.uint64(1) << (np.uint64(63) - shift))
                    h[rows] = mix(h[rows] ^ (x & PART[np.minimum(left, 8)]))
                    more = np.flatnonzero(left > 8)
                    at, left, rows = at[more] + 8, left[more] - 8, rows[more]
            for k in np.flatnonzero(n > LONG_WORD):
                h[k] = int.from_bytes(hashlib.blake2b(data[lo + s[k] : lo + s[k] + n[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
            out[i:j] = h
            i = j
    return out


def hash_windows(words_: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; len(words_) - n + 1 of them, across row borders too."""
    m = len(words_) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k, a in enumerate(multipliers(n, n)):
            out += words_[k : k + m] * a
        return mix(out)
