"""Near-duplicate groups by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass over the texts makes, for each document, its number of distinct
   shingles, a 128-bit cryptographic key of its word sequence, BANDS band hashes
   over ROWS minima each, and the low BITS bits of all minima, packed.
2. Documents of one word sequence are a class; only its smallest id goes on, so
   thousands of exact copies cost one row each.
3. Members of a band bucket are paired with the bucket's smallest member (not
   with each other). Pairs whose collision-corrected estimate from the packed
   bits lies over six standard deviations below the threshold are dropped, the
   others are confirmed on their full sets, and confirmed links make components.
4. Only buckets whose members are still in several components are taken further:
   their pairs across components are confirmed too, if they share a rare shingle
   or can be alike without one, and their estimate allows it. So no link between
   components is lost that shares a bucket. Two documents that can be alike
   without a rare shingle are not both rich in rare ones, and only those that are
   not are paired in their buckets: a group that hangs together, or whose members
   have edits of their own, costs its size. Members of one bucket in different
   components whose edits are common ones (in over RARE of the sets) still cost
   the square of their number.

At a similarity of 0.85 two documents share no bucket with probability
(1 - 0.85 ** 5) ** 28, below 1e-7.
"""

from __future__ import annotations

import hashlib
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common, graph

common.ship(__name__)

SHINGLE, BANDS, ROWS, BITS = 5, 28, 5, 2
HASHES = BANDS * ROWS
PACKED = -(-HASHES // 32)  # longs of 32 fields of 2 bits
#: Sets that have a rare shingle, at most.
RARE = 8
#: Ids up to so many (16 bytes each) are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
FEATURES = "id long, n_shingles long, k1 long, k2 long, bands array<long>, packed array<long>"


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = common.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def shingles(data: np.ndarray, rows: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lower-cased bytes, and each row's first, one more than rows.

    A row of fewer than n words, but not none, has its whole sequence as one.
    """
    starts, ends, first = common.words(data, rows)
    hashed = common.hash_words(data, starts, ends)
    count = np.diff(first)
    window = common.hash_windows(hashed, n)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(int(at[-1]), np.uint64)
    row = np.repeat(np.arange(len(per)), per)
    where = first[:-1][row] + (np.arange(len(out)) - at[:-1][row])
    full = (count >= n)[row]
    out[full] = window[where[full]]
    for r in np.flatnonzero((count > 0) & (count < n)):
        out[at[r]] = common.hash_windows(np.concatenate([hashed[first[r] : first[r + 1]], np.array([count[r]], np.uint64)]), int(count[r]) + 1)[0]
    return out, at


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, rows = common.buffers(texts)
    return common.lower_ascii(data), rows


def _features(ids: pa.Array, texts: pa.Array, n: int) -> pa.RecordBatch:
    data, rows = _lowered(texts)
    sh, at = shingles(data, rows, n)
    size = len(at) - 1
    n_sh = np.array([len(np.unique(sh[at[r] : at[r + 1]])) for r in range(size)], np.int64)
    # bytes.split() parts at exactly 0x20 and 0x09 to 0x0D
    keys = np.array([np.frombuffer(hashlib.blake2b(b" ".join(data[lo:hi].tobytes().split()), digest_size=16).digest(), np.int64) for lo, hi in zip(rows[:-1], rows[1:], strict=True)], np.int64).reshape(size, 2)
    has = np.flatnonzero(np.diff(at) > 0)
    a, b = _seeds()
    minima = np.zeros((size, HASHES), np.uint32)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(has):  # some ten thousand shingles at a time stay in the CPU's cache
            j = max(i + 1, int(np.searchsorted(at[has], at[has[i]] + 30_000)))
            some = has[i:j]
            part, cuts = sh[at[some[0]] : at[some[-1] + 1]], at[some] - at[some[0]]
            for k in range(HASHES):
                minima[some, k] = (np.minimum.reduceat(part * a[k] + b[k], cuts) >> np.uint64(32)).astype(np.uint32)
            i = j
        m = minima.astype(np.uint64).reshape(size, BANDS, ROWS)
        h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (size, 1))
        for k in range(ROWS):
            h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, k])
        low = np.zeros((size, PACKED * 32), np.uint64)
        low[:, :HASHES] = minima & ((1 << BITS) - 1)
        packed = (low.reshape(size, PACKED, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)
    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.reshape(-1).view(np.int64)))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n_sh), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(h), lists(packed)], names=["id", "n_shingles", "k1", "k2", "bands", "packed"])


def features(docs: DataFrame, id_col: str, text: str, n: int = SHINGLE) -> DataFrame:
    common.prepare(docs.sparkSession)

    def run(batches):
        common.make_room()
        for batch in batches:
            yield _features(batch.column(0), batch.column(1), n)
        common.trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, FEATURES)


def shingle_sets(docs: DataFrame, id_col: str, text: str, n: int = SHINGLE) -> DataFrame:
    """id, shingles (array<long>, distinct)."""
    common.prepare(docs.sparkSession)

    def run(batches):
        common.make_room()
        for batch in batches:
            sh, at = shingles(*_lowered(batch.column(1)), n)
            sets = [np.unique(sh[at[r] : at[r + 1]]) for r in range(len(at) - 1)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "shingles"])
        common.trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, shingles array<long>")


def estimate(x: Column, y: Column) -> Column:
    """The collision-corrected similarity: fields that agree by chance, 2**-BITS of those that differ, are taken off."""
    differ = None
    for i in range(PACKED):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        d = F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = d if differ is None else differ + d
    chance = 2.0**-BITS
    return (1.0 - differ / F.lit(float(HASHES)) - chance) / (1.0 - chance)


def _least_estimate(threshold: float) -> float:
    p = 2.0**-BITS + (1 - 2.0**-BITS) * threshold
    return threshold - 6 * sqrt(p * (1 - p) / HASHES) / (1 - 2.0**-BITS)


def _sets_of(ids: DataFrame, docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """id, shingles of the documents in ids (id), cut."""
    ids = common.cut(ids)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    picked = picked.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")  # checked size
    return common.cut(shingle_sets(picked, "id", "t", n).dropDuplicates(["id"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
    return sized.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")


def _across(parts: DataFrame, sets: DataFrame, least: Column, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket in different components that can be linked.

    A shingle in RARE of the sets at most is rare. A pair shares one, and is
    found by it; or it shares none, and then its intersection is no larger than
    either set without its rare shingles, and its union no smaller than either
    set with the other's. Near copies with edits of their own fail that bound.
    """
    rows = sets.select(F.col("id").alias("v"), F.explode("shingles").alias("s"))
    rare = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= RARE)
    own = common.cut(rows.join(rare, "s"))
    member = parts.join(own.groupBy("v").agg(F.count(F.lit(1)).alias("rare")), "v", "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    member = common.cut(member.select("h", "v", "label", "n_shingles", "packed", "bands", "rare"))
    info = member.select("v", "label", "n_shingles", "packed").distinct()
    side = lambda df, x: df.select(*[F.col(c).alias(x + c) for c in df.columns])
    alike = (F.least("an_shingles", "bn_shingles") * 100 >= F.greatest("an_shingles", "bn_shingles") * percent) & (estimate(F.col("apacked"), F.col("bpacked")) >= least)
    # of a pair that passes the bound, the one with fewer rare shingles is poor in them
    poor = lambda x: (F.col(x + "n_shingles") - F.col(x + "rare")) * 100 >= (F.col(x + "n_shingles") + F.col(x + "rare")) * percent
    left, right = side(member, "a").filter(poor("a")), side(member, "b")
    inter = F.least(F.col("an_shingles") - F.col("arare"), F.col("bn_shingles") - F.col("brare"))
    union = F.greatest(F.col("an_shingles") + F.col("brare"), F.col("bn_shingles") + F.col("arare"))
    bound = inter * 100 >= union * percent
    first = F.get(F.filter(F.zip_with("abands", "bbands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), F.lit(0)) == F.col("ah")  # of their common buckets
    once = ~poor("b") | (F.col("av") < F.col("bv"))
    without = left.join(right, (F.col("ah") == F.col("bh")) & once & (F.col("alabel") != F.col("blabel")) & bound & alike & first)
    without = without.select(F.least("av", "bv").alias("a"), F.greatest("av", "bv").alias("b"))
    several = own.filter("df > 1").select("s", "v")
    sharing = side(several, "a").join(side(several, "b"), (F.col("as") == F.col("bs")) & (F.col("av") < F.col("bv"))).select("av", "bv").distinct()  # RARE members at most
    sharing = sharing.join(side(info, "a"), "av").join(side(info, "b"), "bv").filter((F.col("alabel") != F.col("blabel")) & alike)
    return without.union(sharing.select("av", "bv")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id, kept.

    Links: 100 * intersection >= percent * union of the sets of shingles of
    lower-cased (A-Z) words. A text of fewer words than a shingle is one
    shingle; one without words, or null, has none and links with nothing.
    component_id is the smallest id reachable; kept is id = component_id. Rows
    with the same id are one document. Rows without an id get no component and
    are not kept. Other columns are not carried. percent is 80 or more: bands
    are laid out for that.
    """
    if percent < 80:
        raise ValueError("the bands find similarities of 0.8 and more")
    all_ = common.cut(features(docs, id_col, text, shingle))
    usable = all_.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = common.cut(usable.groupBy("k1", "k2").agg(F.min("id").alias("v")))
    reps = common.cut(usable.join(classes, ["k1", "k2"]).filter("id = v").select("v", "n_shingles", "bands", "packed"))
    rows = reps.select("v", F.explode("bands").alias("h"))
    heads = common.cut(rows.groupBy("h").agg(F.min("v").alias("head"), F.max("v").alias("last"), F.count(F.lit(1)).alias("rows")).filter("last > head").select("h", "head", "rows"))
    members = common.cut(common.spread_join(rows, heads, ["h"], "rows", "v"))  # of buckets with several members
    slim = reps.select("v", "n_shingles", "packed")
    least = F.lit(_least_estimate(percent / 100))

    def likely(pairs: DataFrame) -> DataFrame:
        x = pairs.join(slim.select(F.col("v").alias("a"), F.col("n_shingles").alias("na"), F.col("packed").alias("pa")), "a")
        y = x.join(slim.select(F.col("v").alias("b"), F.col("n_shingles").alias("nb"), F.col("packed").alias("pb")), "b")
        return y.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate(F.col("pa"), F.col("pb")) >= least)).select("a", "b")

    stars = common.cut(likely(members.filter("v <> head").select(F.col("head").alias("a"), F.col("v").alias("b")).distinct()))
    ends = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    linked = common.cut(_confirmed(stars, _sets_of(ends, docs, id_col, text, shingle), percent))
    labels = graph.components(linked)
    # pairs across components, in buckets that still have several
    tagged = members.join(labels, "v", "left").select("h", "v", F.coalesce("label", "v").alias("label"))
    open_ = tagged.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h")
    parts = common.cut(tagged.join(open_, "h").join(reps, "v"))
    if parts.limit(1).count():
        sets = _sets_of(parts.select(F.col("v").alias("id")).distinct(), docs, id_col, text, shingle)
        more = common.cut(_across(parts, sets, least, percent).join(stars, ["a", "b"], "left_anti"))
        labels = graph.components(linked.union(common.cut(_confirmed(more, sets, percent))))
    whole = all_.select("id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").join(labels, "v", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "v")).otherwise(F.col("id"))
    return whole.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op10_bbit_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM d, range(1, greatest(len(w) - 4, 1) + 1) g(k) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
few AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
shared AS MATERIALIZED (SELECT doc_id, s FROM sh SEMI JOIN few USING (s)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shared x JOIN shared y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS label FROM d UNION SELECT b, label FROM reach JOIN ways ON a = v WHERE label < b),
comp AS (SELECT v, min(label) AS c FROM reach GROUP BY v)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp ON v = doc_id"""
