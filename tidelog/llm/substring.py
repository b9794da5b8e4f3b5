"""Removal of repeated passages by De Bruijn compaction.

Words are tokens, windows of K words are edges between nodes of K - 1 words.

1. Exact copies are found by a digest of the text; only the smallest id goes on.
2. Every window has a minimizer (its smallest GRAM-word hash), which depends on
   its words only. A document sends its distinct minimizers, in buckets; those
   that a second document has come back. Windows with another one are unique.
3. The windows left are edges. Each of their nodes goes to its bucket with a hash
   of the words before and behind it; a node where these differ between
   occurrences, or end, is branching, and only branching nodes that occur more
   than once come back. What lies between two of them in a document is a
   nonbranching path: one row, whatever its length. (Where a node that occurs
   once lies between, the row is no path, but has no equal either.)
4. Paths are joined on first node, length, last node and a digest of the words
   between, taken from the source coordinates in a prime field over a second word
   hash; so a path is matched with its smallest document only where the whole
   span is equal.
5. Words under a path that a smaller document has are removed.

A minimizer sends one row for each Arrow batch, not for each document, where the
batch alone shows that it repeats. Nodes that are hot (there are HOT_NODES for a
document's windows at most; they have a hot minimizer) are judged before by a sum
that is made on the map side: those that are surely nonbranching are not sent at
all, the others are dealt evenly and break paths. Buckets are read one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

common.ship(__name__)

K, GRAM = 13, 5
#: Documents whose removals are broadcast, and spans in them; more are joined by a shuffle.
BROADCAST_DOCS, BROADCAST_SPANS = 300_000, 2_000_000
#: A node is hot with more occurrences than one in so many documents, and than the least; half as many make a minimizer hot.
HOT_NODES, LEAST_HOT = 64, 64


def _hashed(texts: pa.Array, seeds: tuple[int, ...] = (1,)) -> tuple[np.ndarray, ...]:
    """The word hashes of each seed, and each row's first word, one more than rows."""
    data, rows = common.buffers(texts)
    starts, ends, first = common.words(data, rows)
    return *(common.hash_words(data, starts, ends, seed) for seed in seeds), first


def minimizers(words: np.ndarray, first: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of k words inside a row: its first word, and its minimizer."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = common.hash_windows(words, gram)
    best = g[:m].copy()
    for j in range(1, k - gram + 1):
        np.minimum(best, g[j : j + m], out=best)
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    at = np.flatnonzero(row[:m] == row[k - 1 :])
    return at, best[at]


def _blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> list[pa.Array]:
    """The columns' values of each bucket as one binary value each; bucket must be in order.

    All first bytes of the values stand together, then all second ones, so that
    the shuffle's codec can take out those that hardly change.
    """
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cut, len(bucket))
    out = [pa.array(bucket[cut].astype(np.int32))]
    for c in columns:
        raw = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize)
        out.append(pa.array([raw[lo:hi].T.tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
    return out


def _values(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _by_bucket(batches, dtypes):
    """(bucket, arrays) one bucket after another, from rows sorted by bucket."""
    held, at = [], None
    for batch in batches:
        for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and bucket != at:
                yield at, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            at = bucket
            held.append([_values(b, d) for b, d in zip(blobs, dtypes, strict=True)])
    if held:
        yield at, [np.concatenate(x) for x in zip(*held, strict=True)]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each begins."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _spread(flags: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(flags, np.diff(np.append(begins, n)))


def repeated_minimizers(docs: DataFrame, k: int, gram: int, parts: int, hot: int) -> DataFrame:
    """doc, m (the minimizer): those that another document has too. Without a doc: those that hot documents or more have."""
    buckets = 2 * parts

    def send(batches):
        for batch in batches:
            words, first = _hashed(batch.column(1))
            at, best = minimizers(words, first, k, gram)
            row = np.searchsorted(first, at, "right") - 1
            new = np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, bool)
            best, row = best[new] >> np.uint64(16), row[new]
            order = np.lexsort((row, best))
            best, row = best[order], row[order]
            new = np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]) if len(best) else np.zeros(0, bool)
            best, row = best[new], row[new]
            doc = batch.column(0).to_numpy()[row]
            begins = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]])) if len(best) else np.zeros(0, np.int64)
            several = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins) if len(best) else np.zeros(0, bool)
            known = _spread(several, begins, len(best))
            lead = np.zeros(len(best), bool)
            lead[begins] = True
            # known ones are dealt evenly; one of each goes to the minimizer's bucket, to tell the others
            own = (best % np.uint64(buckets)).astype(np.int64)
            even = (common.mix(doc.astype(np.uint64) ^ best) % np.uint64(buckets)).astype(np.int64)
            tell = known & lead
            bucket = np.concatenate([np.where(known, even, own), own[tell]])
            kind = np.concatenate([known.astype(np.uint8), np.full(tell.sum(), 2, np.uint8)])
            sizes = np.diff(np.append(begins, len(best)))[several]  # told in place of a document
            best, doc = np.concatenate([best, best[tell]]), np.concatenate([doc, sizes])
            order = np.argsort(bucket, kind="stable")
            yield pa.RecordBatch.from_arrays(_blobs(bucket[order], [best[order], doc[order], kind[order]]), names=["bucket", "m", "doc", "kind"])

    def answer(batches):
        for _, (m, doc, kind) in _by_bucket(batches, (np.uint64, np.int64, np.uint8)):
            sure = kind == 1
            rest_m, rest_doc, rest_kind = m[~sure], doc[~sure], kind[~sure]
            order, begins = _groups(rest_m)
            if len(begins):
                d = rest_doc[order]
                several = (np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)) | (np.maximum.reduceat(rest_kind[order], begins) == 2)
                back = order[_spread(several, begins, len(order))]
                back = back[rest_kind[back] == 0]
                often = rest_m[order][begins][np.add.reduceat(np.where(rest_kind[order] == 2, d, 1), begins) >= hot]
            else:
                back, often = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            docs_ = np.concatenate([doc[sure], rest_doc[back], np.zeros(len(often), np.int64)])
            nobody = np.arange(len(docs_)) >= len(docs_) - len(often)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, mask=nobody), pa.array(np.concatenate([m[sure], rest_m[back], often]).astype(np.int64))], names=["doc", "m"])

    sent = docs.mapInArrow(send, "bucket int, m binary, doc binary, kind binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "doc long, m long")


#: What a node's neighbours are told by: below KNOWN a neighbour is missing, from there to FULL the node is hot; odd where a window starts.
KNOWN, FULL = 2, 4


def _neighbours(words: np.ndarray, at: np.ndarray, k: int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A number for the words before and behind the nodes at these places; below KNOWN where a window before or after is missing."""
    if not len(words):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        both = common.mix(words[np.maximum(at - 1, 0)] + common.mix(words[np.minimum(at + k - 1, len(words) - 1)]))
    return np.where(before & after, both | np.uint64(FULL + 1), after.astype(np.uint64))


def hot_nodes(docs: DataFrame, often: np.ndarray, k: int, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes whose smallest gram is in often (hot minimizers): those with so many occurrences (in order), and whether each may be branching.

    A window counts only if its minimizer is in often too: of the others it is
    not known here whether they are repeated. Reads the texts of docs (doc, t).
    """
    given, top = docs.sparkSession.sparkContext.broadcast(np.sort(often)), np.uint64(1 << 63)  # 2 x HOT_NODES for a document's minimizers at most

    def run(batches):
        for batch in batches:
            words, first = _hashed(batch.column(1))
            window = np.zeros(len(words) + 1, bool)
            at, best = minimizers(words, first, k, gram)
            window[at[np.isin(best >> np.uint64(16), given.value)]] = True
            at, best = minimizers(words, first, k - 1, gram)
            at = at[np.isin(best >> np.uint64(16), given.value)]
            side = _neighbours(words, at, k, (at > 0) & window[np.maximum(at - 1, 0)], window[at])
            node = common.hash_windows(words, k - 1)[at]
            order, begins = _groups(node)
            x = (side ^ top).view(np.int64)[order]  # in the order of unsigned numbers
            lo, hi = (np.minimum.reduceat(x, begins), np.maximum.reduceat(x, begins)) if len(begins) else (x, x)
            yield pa.RecordBatch.from_arrays([pa.array(node[order][begins].view(np.int64)), pa.array(np.diff(np.append(begins, len(order)))), pa.array(lo), pa.array(hi)], names=["node", "n", "lo", "hi"])

    found = docs.mapInArrow(run, "node long, n long, lo long, hi long").groupBy("node").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = found.filter(F.col("n") >= least).collect()  # HOT_NODES for a document's windows at most
    rows.sort(key=lambda r: r.node % (1 << 64))
    return np.array([r.node for r in rows], np.int64).view(np.uint64), np.array([r.lo != r.hi or r.lo < FULL - (1 << 63) for r in rows], bool)


def paths(marked: DataFrame, k: int, gram: int, parts: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, last, doc, start, length, digest: the nonbranching paths of marked (doc, text, marks: its repeated minimizers); hot: hot_nodes()."""
    buckets = 2 * parts
    given = marked.sparkSession.sparkContext.broadcast(hot)  # HOT_NODES for a document's windows at most

    def send(batches):
        hot_node, is_branching = given.value
        for batch in batches:
            words, other, first = _hashed(batch.column(1), (1, 2))
            at, best = minimizers(words, first, k, gram)
            row = np.searchsorted(first, at, "right") - 1
            marks = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            of = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            salted = lambda r, m: common.mix(m + common.mix(r.astype(np.uint64) + np.uint64(1)))
            with np.errstate(over="ignore"):
                edge = np.zeros(len(words) + 1, bool)
                edge[at[np.isin(salted(row, best >> np.uint64(16)), salted(of, marks.flatten().to_numpy().astype(np.uint64)))]] = True
            before = np.concatenate([[False], edge[:-1]])
            at = np.flatnonzero(edge | before)
            at = at[at + k - 1 <= len(words)]
            node = common.hash_windows(words, k - 1)[at]
            side = _neighbours(words, at, k, before[at], edge[at])
            bucket = (node % np.uint64(buckets)).astype(np.int64)
            row = np.searchsorted(first, at, "right") - 1
            doc = batch.column(0).to_numpy()[row]
            if len(hot_node):
                i = np.minimum(np.searchsorted(hot_node, node), len(hot_node) - 1)
                known = hot_node[i] == node
                sure = known & is_branching[i]
                side = np.where(sure, (side & np.uint64(1)) | np.uint64(KNOWN), side)
                bucket = np.where(sure, (common.mix(doc.astype(np.uint64) ^ node) % np.uint64(buckets)).astype(np.int64), bucket)
                keep = np.flatnonzero(~known | sure)
                at, node, side, bucket, row, doc = (x[keep] for x in (at, node, side, bucket, row, doc))
            place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
            prefix = _since(common.running(other, place), at, first[row])
            local = (at - first[row]).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            yield pa.RecordBatch.from_arrays(_blobs(bucket[order], [x[order] for x in (node, side, doc, local, prefix)]), names=["bucket", "node", "side", "doc", "pos", "prefix"])

    def branching(batches):
        for _, (node, side, doc, pos, prefix) in _by_bucket(batches, (np.uint64, np.uint64, np.int64, np.int32, np.uint64)):
            order, begins = _groups(node)
            x, size = side[order], np.diff(np.append(begins, len(order)))
            least = np.minimum.reduceat(x, begins)
            branch = (least != np.maximum.reduceat(x, begins)) | (least < FULL)
            back = order[_spread(branch & ((size > 1) | ((least >= KNOWN) & (least < FULL))), begins, len(order))]
            yield pa.RecordBatch.from_arrays([pa.array(doc[back]), pa.array(pos[back]), pa.array(node[back].view(np.int64)), pa.array((side[back] & np.uint64(1)).astype(bool)), pa.array(prefix[back].view(np.int64))], names=["doc", "pos", "node", "goes", "prefix"])

    def between(batches):
        last = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if last is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(last, cols, strict=True)]
            if len(cols[0]):
                last = [x[-1:] for x in cols]
            doc, pos, node, goes, prefix = cols
            i = np.flatnonzero((doc[1:] == doc[:-1]) & goes[:-1] & (pos[1:] > pos[:-1]))
            digest = common.between(prefix[i].view(np.uint64), prefix[i + 1].view(np.uint64), pos[i])
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[i + 1]), pa.array(doc[i]), pa.array(pos[i]), pa.array(pos[i + 1] - pos[i]), pa.array(digest.view(np.int64))], names=["node", "last", "doc", "start", "length", "digest"])

    sent = marked.mapInArrow(send, "bucket int, node binary, side binary, doc binary, pos binary, prefix binary")
    back = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(branching, "doc long, pos int, node long, goes boolean, prefix long")
    return back.repartition(parts, "doc").sortWithinPartitions("doc", "pos").mapInArrow(between, "node long, last long, doc long, start int, length int, digest long")


def _since(sums: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums from a row's first word on, modulo the digests' prime."""
    return common.reduced(sums[at] + np.uint64(common.PRIME) - sums[first])


def _together(batches):
    """Overlapping and touching spans of a document as one, within a batch; rows come by document and start."""
    for batch in batches:
        doc, start, end = (batch.column(i).to_numpy() for i in range(3))
        if not len(doc):
            yield batch
            continue
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        nth = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(doc)))).astype(np.int64) << 32
        reach = np.maximum.accumulate(nth + end)  # a later document's numbers are all larger
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (nth[1:] + start[1:] > reach[:-1])])
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(start[at]), pa.array((np.maximum.reduceat(reach, at) - nth[at]).astype(np.int32))], names=["doc", "start", "end"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, k: int = K, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: the id, n_words, n_removed, kept_text, removed (array<struct<start, end>>, words).

    Words are runs without white space (0x20, 0x09 to 0x0D). A word is removed
    if a window of k words over it also starts in a document with a smaller id;
    windows are judged on the input. kept_text has the other words, one space
    between. Null texts have no words. Rows without an id are neither a source
    nor shortened. Repeated rows are one document; rows that share an id must
    share the text. Other columns are not carried.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    keyed = given.filter("doc is not null").select("doc", F.sha2("t", 256).alias("key"))
    heads = common.cut(keyed.groupBy("key").agg(F.min("doc").alias("head"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).filter("last > head").select("key", "head", "n"))
    copies = common.cut(common.spread_join(keyed, heads, ["key"], "n", "doc").filter("doc > head").select("doc").distinct())
    n_copies = copies.count()
    small = F.broadcast(copies) if n_copies <= BROADCAST_DOCS else copies  # checked size
    distinct = given.filter("doc is not null").join(small, "doc", "left_anti")
    hot = max(LEAST_HOT, given.count() // HOT_NODES)
    marks = common.cut(repeated_minimizers(distinct, k, gram, parts, hot // 2).groupBy("doc").agg(F.collect_set("m").alias("marks")))
    often = [r.m for r in marks.filter("doc is null").select(F.explode("marks").alias("m")).collect()]  # 2 x HOT_NODES for a document's minimizers at most
    marked = distinct.join(marks.filter("doc is not null"), "doc").select("doc", "t", "marks")
    none = (np.zeros(0, np.uint64), np.zeros(0, bool))
    found = common.cut(paths(marked, k, gram, parts, hot_nodes(given, np.array(often, np.int64).view(np.uint64), k, gram, hot) if often else none))
    key = ["node", "last", "length", "digest"]
    source = found.groupBy(*key).agg(F.min("doc").alias("source"), F.max("doc").alias("latest"), F.count(F.lit(1)).alias("n")).filter("latest > source").select(*key, "source", "n")
    spans = common.spread_join(found, common.cut(source), key, "n", "doc").filter("doc > source").select("doc", "start", (F.col("start") + F.col("length") + (k - 1)).alias("end"))
    spans = spans.repartition(parts, "doc").sortWithinPartitions("doc", "start").mapInArrow(_together, "doc long, start int, end int").select("doc", F.struct("start", "end").alias("span"))
    whole = copies.select("doc", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(True).alias("copy"))
    gone = common.cut(spans.groupBy("doc").agg(F.collect_list("span").cast("array<struct<start:int,end:int>>").alias("spans")).withColumn("copy", F.lit(False)).union(whole))
    size = gone.agg(F.count(F.lit(1)), F.sum(F.size("spans"))).first()
    joined = given.join(F.broadcast(gone) if size[0] <= BROADCAST_DOCS and (size[1] or 0) <= BROADCAST_SPANS else gone, "doc", "left")  # checked size
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])

    def cut_out(batches):
        for batch in batches:
            n_words, n_gone, kept, merged = [], [], [], []
            for t, spans_, copy in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), batch.column("copy").to_pylist(), strict=True):
                words = t.encode().split()  # bytes.split() parts at exactly 0x20 and 0x09 to 0x0D
                ranges = [(0, len(words))] if copy and len(words) >= k else sorted((s["start"], s["end"]) for s in spans_ or [])
                out, own, at = [], [], 0
                for lo, hi in ranges:
                    if own and lo <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], hi)
                    else:
                        own.append({"start": lo, "end": hi})
                for r in own:
                    out += words[at : r["start"]]
                    at = r["end"]
                out += words[at:]
                n_words.append(len(words))
                n_gone.append(len(words) - len(out))
                kept.append(b" ".join(out).decode())
                merged.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[f.name for f in schema.fields])

    return joined.select("doc", "t", "spans", "copy").mapInArrow(cut_out, schema)


def op4_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages that smaller documents have."""
    return remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT rid, doc_id, k, array_to_string(w[k:k + {K - 1}], ' ') AS s FROM d, range(1, len(w) - {K} + 2) g(k)),
src AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, k + j AS i FROM win JOIN src USING (s), range(0, {K}) g(j) WHERE first < doc_id),
n AS (SELECT rid, list(i) AS gone FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(n.gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: n.gone IS NULL OR NOT list_contains(n.gone, i)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid)"""
