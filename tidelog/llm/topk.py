"""Exact top-k inner-product search with a pivot-distance index.

Inner products become distances: with one more coordinate sqrt(M - |v|^2), M the
largest squared norm, every vector has the squared norm M, and the squared
distance of a query (whose own extra coordinate is 0) is |q|^2 + M - 2 q.v.
Each vector is keyed by its nearest pivot and the distance to it; the index is
sorted by that key over range partitions, so that a pivot with many vectors
spans many of them. A task cuts its sorted rows into annuli and expands them
outwards from the query's own distance: by the triangle inequality an annulus
[lo, hi] of a pivot holds no vector nearer than max(lo - d, d - hi), and the
expansion stops for a query when that bound falls behind its k-th best score,
and altogether when it does so for all. Pivots and first thresholds come from a
sample of SAMPLE rows; results do not depend on it. Queries are dealt to blocks of
QUERY_BLOCK rows and QUERY_BYTES, one broadcast each; with several blocks the
index is written once and read for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

common.ship(__name__)

PIVOTS, SAMPLE, QUERY_BLOCK, QUERY_BYTES, ANNULUS, CHUNK = 64, 2048, 16_384, 32 << 20, 256, 16_384
#: Scores from here on need not fit a long, and are compared as Python integers; LOWEST is under all of them.
WIDE, LOWEST, DIGITS = 2.0**62, -(10**700), 701
INDEXED = "vec_id long, pivot int, dist double, v binary"


def _integers(batch_column: pa.Array) -> list[np.ndarray | None]:
    """floor(256 x) of each vector, as doubles; None for one that takes no part: null, or 256 x null or not finite."""
    out = []
    for x in batch_column:
        if not x.is_valid:
            out.append(None)
            continue
        values = x.values
        a = None if values.null_count else np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            out.append(None if a is None or not np.isfinite(a * 256.0).all() else np.floor(a * 256.0))
    return out


def vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (binary: 64-bit floats with integer values), dims, norm2; vectors that take no part are left out."""
    def run(batches):
        for batch in batches:
            np.seterr(over="ignore")  # a squared norm may be infinite
            ints = _integers(batch.column(1))
            keep = [i for i, a in enumerate(ints) if a is not None and batch.column(0)[i].is_valid]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())), pa.array([ints[i].tobytes() for i in keep], pa.binary()),
                pa.array([len(ints[i]) for i in keep], pa.int32()), pa.array([float(ints[i] @ ints[i]) for i in keep], pa.float64()),
            ], names=["vec_id", "v", "dims", "norm2"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).mapInArrow(run, "vec_id long, v binary, dims int, norm2 double")


def _matrix(rows: list[bytes], dims: int) -> np.ndarray:
    """One row each; shorter vectors are filled up with zeros."""
    if all(len(r) == 8 * dims for r in rows):
        return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), dims)
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, np.float64)
    return out


def _scores(q: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products, of which none is over most: in doubles while every partial sum is below 2**53, else in Python integers."""
    if most < 2.0**53:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q], object).reshape(len(q), len(v))
    return exact.astype(np.int64) if most < WIDE else exact


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Of the sample, each time the one farthest from those before it."""
    chosen, far = [0], np.full(len(sample), np.inf)
    for _ in range(min(count, len(sample)) - 1):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


class Best:
    """The k best (score, id) of each query; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, thresholds: np.ndarray, k: int):
        self.own, self.k = ids, k
        self.floor, self.worst = thresholds.copy(), np.full(len(ids), np.iinfo(np.int64).max)
        self.kept: list[list[tuple[int, int]]] = [[] for _ in ids]

    def floors(self) -> np.ndarray:
        """The k-th best scores as doubles, which bounds are compared with; infinite beyond them."""
        if self.floor.dtype != object:
            return self.floor
        return np.array([float(x) if abs(x) < 10**300 else np.copysign(np.inf, x > 0 or -1) for x in self.floor])

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        floor, worst = self.floor[which, None], self.worst[which, None]
        good = (((scores > floor) | ((scores == floor) & (ids[None, :] < worst))) & (ids[None, :] != self.own[which, None])).astype(bool)
        for r in np.flatnonzero(good.any(1)):
            at, q = np.flatnonzero(good[r]), int(which[r])
            if len(at) > self.k:
                at = np.array(sorted(at, key=lambda x, r=r: (-scores[r, x], ids[x]))[: self.k]) if scores.dtype == object else at[np.lexsort((ids[at], -scores[r, at]))[: self.k]]
            kept = sorted([*self.kept[q], *((-int(s), int(i)) for s, i in zip(scores[r, at], ids[at], strict=True))])[: self.k]
            self.kept[q] = kept
            if len(kept) == self.k:
                self.floor[q], self.worst[q] = max(self.floor[q], -kept[-1][0]), kept[-1][1] if -kept[-1][0] >= self.floor[q] else self.worst[q]


def search(df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of df with the highest inner products for each row of queries.

    Vectors are scaled to floor(256 x); vectors that are null or hold a null or
    non-finite component (before or after the scaling), and rows without an id,
    take no part. A row is no candidate for a query with its own id. Ties go to
    the smaller id. Ranks are by the exact integers; a score that a long cannot
    hold is shown as the nearest long. Shorter vectors are filled up with zeros.
    Fewer candidates give fewer ranks, and empty tables no rows. Repeated query
    rows each give their ranks. Other columns are not carried.
    """
    spark = df.sparkSession
    common.prepare(spark)
    rows = vectors(df, vec_id, embedding)
    all_queries = vectors(queries, vec_id, embedding)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shape = rows.select("dims", "norm2", F.lit(0).alias("q")).union(all_queries.select("dims", "norm2", F.lit(1).alias("q")))
    dims, most, top, n_queries = shape.agg(F.max("dims"), F.max("norm2"), F.max(F.when(F.col("q") == 0, F.col("norm2"))), F.sum("q")).first()
    if top is None or not n_queries:
        return empty
    query_block = max(1, min(query_block, query_bytes // max(1, 8 * dims)))
    bounded, wide = most < 1e300, most >= WIDE  # beyond, distances are no numbers: every annulus is searched
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    sample_v, sample_ids = _matrix([r.v for r in seen], dims), np.array([r.vec_id for r in seen], np.int64)
    lift = lambda m: np.hstack([m, np.sqrt(np.maximum(0.0, top - (m * m).sum(1)))[:, None]])
    centres = spark.sparkContext.broadcast(pick_pivots(lift(sample_v), pivots) if bounded else np.zeros((1, dims + 1)))  # pivots x dims
    slack = 1e-6 * (1.0 + top + most)

    def key(batches):
        c = centres.value
        for batch in batches:
            v = _matrix(batch.column(1).to_pylist(), dims)
            if not bounded:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(v), np.int32)), pa.array(np.zeros(len(v))), batch.column(1)], names=["vec_id", "pivot", "dist", "v"])
                continue
            full = np.hstack([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(1)))[:, None]]) if len(v) else np.zeros((0, dims + 1))
            d2 = np.maximum(0.0, (full * full).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * full @ c.T)
            near = d2.argmin(1) if len(v) else np.zeros(0, np.int64)
            exact = np.sqrt(((full - c[near]) ** 2).sum(1)) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(exact), batch.column(1)], names=["vec_id", "pivot", "dist", "v"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = rows.select("vec_id", "v").mapInArrow(key, INDEXED).repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    if n_queries > query_block:
        index = common.cut(index)

    def block_search(given):
        def run(batches):
            ids, q, floor = given.value
            c = centres.value
            np.seterr(over="ignore", invalid="ignore")
            qq = (q * q).sum(1)
            to = np.sqrt(np.maximum(0.0, qq[:, None] + (c * c).sum(1)[None, :] - 2 * q @ c[:, :-1].T))  # the query's extra coordinate is 0
            best = Best(ids, floor, k)

            def part(rows_):
                vec, piv, dist = (np.concatenate([r[i] for r in rows_]) for i in range(3))
                v = np.vstack([r[3] for r in rows_])
                edges = np.flatnonzero(np.diff(piv)) + 1
                edges = np.unique(np.concatenate([[0], edges, np.arange(0, len(piv), ANNULUS), [len(piv)]]))
                # rows of several files may stand in a chunk, each in its own order
                lo, hi, of = np.minimum.reduceat(dist, edges[:-1]), np.maximum.reduceat(dist, edges[:-1]), piv[edges[:-1]]
                gap = np.maximum(0.0, np.maximum(lo[:, None] - to[:, of].T, to[:, of].T - hi[:, None]) - 1e-6 * (1 + hi[:, None]))
                bound = (qq[None, :] + top - gap * gap) / 2 + slack if bounded else np.full(gap.shape, np.inf)  # the highest score in the annulus
                for a in np.argsort(-bound.max(1), kind="stable"):  # outwards
                    floors = best.floors()
                    if bound[a].max() < floors.min():
                        break
                    which = np.flatnonzero(bound[a] >= floors)
                    if len(which):
                        s = slice(edges[a], edges[a + 1])
                        best.add(which, _scores(q[which], v[s], most), vec[s])

            held, n = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3).to_pylist(), dims)))
                    n += batch.num_rows
                if n >= CHUNK:
                    part(held)
                    held, n = [], 0
            if n:
                part(held)
            flat = [(i, v, max(-(2**63), min(2**63 - 1, -s)), str(-s - LOWEST).zfill(DIGITS) if wide else None) for i, kept in enumerate(best.kept) for s, v in kept]
            columns = [list(c) for c in zip(*flat, strict=True)] if flat else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["q", "vec_id", "score", "exact"])

        return run

    def answer(block: list) -> DataFrame:
        ids, q = np.array([r.vec_id for r in block], np.int64), _matrix([r.v for r in block], dims)
        lowest = LOWEST if wide else np.iinfo(np.int64).min
        floor = np.full(len(block), lowest, object if wide else np.int64)
        for lo in range(0, len(block), 512):  # k-th best of the sample: no query's own k-th best is lower
            s = _scores(q[lo : lo + 512], sample_v, most)
            s[ids[lo : lo + 512, None] == sample_ids[None, :]] = lowest
            if s.shape[1] >= k:
                floor[lo : lo + 512] = np.sort(s, axis=1)[:, s.shape[1] - k]
        found = index.mapInArrow(block_search(spark.sparkContext.broadcast((ids, q, floor))), "q int, vec_id long, score long, exact string")  # QUERY_BLOCK x dims, QUERY_BYTES at most
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("exact"), F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q int, query_id long")
        return ranked.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")

    out, block = [], []
    for r in all_queries.select("vec_id", "v").toLocalIterator():
        block.append(r)
        if len(block) == query_block:
            out.append(common.cut(answer(block)))
            block = []
    if block:
        out.append(answer(block) if not out else common.cut(answer(block)))
    result = out[0] if out else empty
    for more in out[1:]:
        result = result.union(more)
    return result


def op3_pivot_topk(spark, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all others."""
    e = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(e, e.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
