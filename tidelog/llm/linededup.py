"""Line deduplication by pairwise alignment.

Documents that overlap are found by block keys: hashes of so many adjacent lines
that a block needs, or of fewer with enough characters, blank lines between them
counted. Each document is paired with the smallest document that has one of its
keys: each block that any earlier document shares is made of such keys. A key of
any frequency makes a pair for each document that has it, never one for each two
of them. Pairs are aligned with patience diff on their line hashes, and the
common blocks of enough lines or characters are deleted from the later document,
those too that the alignment leaves out since they are moved or repeated. Exact
copies are found by a hash of all lines and lose all of them.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

common.ship(__name__)

BLOCK_LINES, BLOCK_CHARS = 2, 100
#: Documents whose deletions are broadcast, and ranges in them (8 bytes each); more are joined by a shuffle.
BROADCAST_DOCS, BROADCAST_RANGES = 300_000, 2_000_000


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of a and b: common ends, then lines unique on both sides in their longest common order, and again between those."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict = {}
        for i in range(a0, a1):
            once[a[i]] = None if a[i] in once else i
        other: dict = {}
        for j in range(b0, b1):
            if b[j] in once:
                other[b[j]] = None if b[j] in other else j
        found = sorted((i, other[x]) for x, i in once.items() if i is not None and other.get(x) is not None)
        if not found:
            continue
        ends, piles, back = [], [], [-1] * len(found)  # longest increasing run of the second positions
        for n, (_, j) in enumerate(found):
            k = bisect_left(ends, j)
            if k == len(ends):
                ends.append(j)
                piles.append(n)
            else:
                ends[k], piles[k] = j, n
            back[n] = piles[k - 1] if k else -1
        n, run = piles[-1], []
        while n >= 0:
            run.append(found[n])
            n = back[n]
        low = (a0, b0)
        for i, j in reversed(run):
            out.append((i, j))
            todo.append((low[0], i, low[1], j))
            low = (i + 1, j + 1)
        todo.append((low[0], a1, low[1], b1))
    return sorted(out)


def common_blocks(a: list, b: list, sizes: list[int], lines: int, chars: int) -> list[tuple[int, int]]:
    """[start, end) of b's lines in blocks that stand together in both, of enough lines or characters. Blank lines (None) match, and count for neither."""
    out, run = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            full = [y for _, y in run if b[y][0] is not None]
            if len(full) >= lines or sum(sizes[y] for y in full) >= chars:
                out.append((run[0][1], run[-1][1] + 1))
            run = []
        run.append((i, j))
    return out


def windows(a: list, sizes: list[int], lines: int, chars: int):
    """(key, start, end) of each run of lines that are not blank, or have blank ones between, of so many lines or of fewer with enough characters."""
    full = [i for i, x in enumerate(a) if x[0] is not None]
    for k in range(len(full)):
        size = 0
        for w in range(1, min(lines, len(full) - k) + 1):
            size += sizes[full[k + w - 1]]
            if w == lines or size >= chars:
                yield tuple(a[full[k] : full[k + w - 1] + 1]), full[k], full[k + w - 1] + 1


def moved_blocks(a: list, b: list, sizes: list[int], taken: list[tuple[int, int]], lines: int, chars: int) -> list[tuple[int, int]]:
    """[start, end) of b's windows that stand anywhere in a and not in a block already taken."""
    block = [-1] * len(b)
    for k, (lo, hi) in enumerate(taken):
        block[lo:hi] = [k] * (hi - lo)
    left = [(x, s, e) for x, s, e in windows(b, sizes, lines, chars) if block[s] < 0 or block[s] != block[e - 1]]
    if not left:
        return []
    known = dict(zip(b, sizes, strict=True))  # windows of a with other lines match nothing
    there = {x for x, _, _ in windows(a, [known.get(x, 0) for x in a], lines, chars)}
    return [(s, e) for x, s, e in left if x in there]


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc, a, b (two hashes of each trimmed line, null of a blank one), n (its characters) from doc and t."""
    lines = docs.select("doc", F.transform(F.split("t", "\n", -1), lambda x: F.trim(F.translate(x, "\t\r", "  "))).alias("l"))
    blank = lambda x, h: F.when(x != "", h)
    return lines.select("doc", F.transform("l", lambda x: blank(x, F.xxhash64(x))).alias("a"), F.transform("l", lambda x: blank(x, F.xxhash64(F.lit("line"), x))).alias("b"), F.transform("l", F.length).alias("n"))


def block_keys(hashed: DataFrame, lines: int, chars: int) -> DataFrame:
    """doc, k1, k2 (two hashes) of each of windows(): its lines and how far they stand from the first."""
    full = hashed.select("doc", F.filter(F.transform("a", lambda x, i: F.struct(i.alias("i"), x.alias("a"), F.get("b", i).alias("b"), F.get("n", i).alias("n"))), lambda x: x["a"].isNotNull()).alias("l"))

    def of(w: int) -> Column:
        def key(s: Column) -> Column:
            x = [F.get("l", s + k) for k in range(w)]
            size = sum((y["n"] for y in x[1:]), x[0]["n"])
            apart = [y["i"] - x[0]["i"] for y in x[1:]]
            out = F.struct(F.xxhash64(*[y["a"] for y in x], *apart).alias("k1"), F.xxhash64(*[y["b"] for y in x], *apart).alias("k2"))
            return out if w == lines else F.when(size >= chars, out)

        found = F.transform(F.sequence(F.lit(0), F.size("l") - w), key)
        return F.filter(F.when(F.size("l") >= w, found).otherwise(F.array().cast("array<struct<k1:bigint,k2:bigint>>")), lambda x: x.isNotNull())

    keys = full.select("doc", F.explode(F.concat(*[of(w) for w in range(1, lines + 1)])).alias("k"))
    return keys.select("doc", "k.k1", "k.k2")


def deletions(docs: DataFrame, *, block_lines: int = BLOCK_LINES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc, ranges (array<struct<start, end>> of lines; null: all lines, of a copy), from doc and t; documents without a deletion are left out."""
    common.prepare(docs.sparkSession)
    hashed = common.cut(line_hashes(docs.filter("doc is not null")).dropDuplicates(["doc"]))
    keyed = hashed.filter(F.exists("a", lambda x: x.isNotNull())).select("doc", F.xxhash64("a").alias("k1"), F.xxhash64("b", "n").alias("k2"))
    heads = common.cut(keyed.groupBy("k1", "k2").agg(F.min("doc").alias("head"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("rows")).filter("last > head").drop("last"))
    copies = common.cut(common.spread_join(keyed, heads, ["k1", "k2"], "rows", "doc").filter("doc > head").select("doc"))
    own = hashed.join(copies, "doc", "left_anti")
    keys = block_keys(own, block_lines, block_chars)
    first = common.cut(keys.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("rows")).filter("last > first").drop("last"))
    pairs = common.cut(common.spread_join(keys, first, ["k1", "k2"], "rows", "doc").filter("doc > first").select("first", "doc").distinct())
    firsts = common.cut(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("rows")))
    later = own.select("doc", F.col("a").alias("da"), F.col("b").alias("db"), "n")
    earlier = own.select(F.col("doc").alias("first"), F.col("a").alias("fa"), F.col("b").alias("fb"))
    earlier = common.cut(earlier.join(firsts, "first"))
    both = common.spread_join(pairs.join(later, "doc"), earlier, ["first"], "rows", "doc").select("doc", "fa", "fb", "da", "db", "n")

    def align(batches):
        for batch in batches:
            docs_, starts, ends = [], [], []
            for doc, fa, fb, da, db, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = list(zip(fa, fb, strict=True)), list(zip(da, db, strict=True))
                blocks = common_blocks(x, y, n, block_lines, block_chars)
                for lo, hi in blocks + moved_blocks(x, y, n, blocks, block_lines, block_chars):
                    docs_.append(doc)
                    starts.append(lo)
                    ends.append(hi)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc", "start", "end"])

    found = both.mapInArrow(align, "doc long, start int, end int").distinct()
    ranges = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return common.cut(ranges.select("doc", F.col("ranges").cast("array<struct<start:int,end:int>>").alias("ranges")).union(copies.select("doc", F.lit(None).cast("array<struct<start:int,end:int>>").alias("ranges"))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, block_lines: int = BLOCK_LINES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with the text shortened, and: n_lines, n_removed (long).

    Lines are what stands between line feeds, compared without white space at
    their ends. Earlier is the smaller id. Lines are judged on the input. A text
    without a deletion is unchanged; null stays null and has no lines, an empty
    text one. Rows without an id are unchanged. Repeated rows are one document;
    rows that share an id must share the text. Columns of docs called n_lines or
    n_removed are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone_doc, ranges, lines = common.fresh(docs.columns, "gone_doc", "ranges", "lines")
    found = deletions(docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t")), block_lines=block_lines, block_chars=block_chars)
    found = found.select(F.col("doc").alias(gone_doc), F.col("ranges").alias(ranges))
    size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(ranges)), F.lit(0))).first()
    small = F.broadcast(found) if size[0] <= BROADCAST_DOCS and size[1] <= BROADCAST_RANGES else found  # checked size
    out = docs.select(*names).join(small, F.col(id_col).cast("long") == F.col(gone_doc), "left")
    hit = F.col(gone_doc).isNotNull() & F.col(text).isNotNull()
    out = out.withColumn(lines, F.when(hit, F.filter(F.split(text, "\n", -1), lambda _, i: F.col(ranges).isNotNull() & ~F.exists(ranges, lambda r: (r["start"] <= i) & (i < r["end"])))))
    n = F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")) + 1, F.lit(0)).cast("long")
    return out.select(
        *[F.when(hit, F.array_join(lines, "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in names],
        n.alias("n_lines"), F.when(hit, n - F.size(lines)).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the blocks of lines that earlier documents have."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
