"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Normalising lower-cases A-Z and takes the words (0-9, a-z, everything beyond
ASCII), one space before and behind each. The windows of the items, so written,
are the automaton's patterns; a text is scanned once, and what is found is
mapped back from spaces to word numbers and from those to the original's
characters. Items are cut into patterns by tasks; PATTERN_CHARS, ids counted too,
bounds what the driver holds and broadcasts at once. Larger sets are dealt to
blocks by a hash, each with an automaton of its own: a worker holds those of
PASS_CHARS, and the texts are written between two such passes.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

common.ship(__name__)

WINDOW = 10
#: Characters of patterns and ids in one automaton (about 40 bytes of memory each), and in all of a worker.
PATTERN_CHARS, PASS_CHARS = 3_000_000, 6_000_000

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if WORD_BYTE[b] else 0x20 for b in range(256))


#: Bytes of a word beyond which its digest stands for it: an automaton is as deep as its longest pattern, and is freed recursively.
LONG_WORD = 100


def normalise(text: str) -> list[bytes]:
    """The words; instead of a long one a mark that no word has, and its digest."""
    words = text.encode().translate(FOLD).split()
    if max(map(len, words), default=0) > LONG_WORD:
        return [w if len(w) <= LONG_WORD else b"#" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words]
    return words


def windows(words: list[bytes], n: int = WINDOW) -> list[tuple[int, str]]:
    """(words, pattern) of each n consecutive words, or of all where there are fewer."""
    return [(len(w), f" {b' '.join(w).decode()} ") for w in (words[k : k + n] for k in range(max(1, len(words) - n + 1)))] if words else []


def patterns(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """size, pattern, item of the windows of all items, each once; a null id is the empty one, a null text has none."""
    def run(batches):
        for batch in batches:
            rows = [(size, p, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for size, p in windows(normalise(t), n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string()))], names=["size", "pattern", "item"])

    given = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return given.mapInArrow(run, "size int, pattern string, item string").distinct()


def pattern_blocks(items: DataFrame, item_id: str, text: str, n: int, most: int = PATTERN_CHARS):
    """The number of blocks, one at least, and a function from a block's number to its windows with the ids that have them."""
    rows = common.cut(patterns(items, item_id, text, n))
    chars, count = rows.agg(F.coalesce(F.sum(F.length("pattern") + F.length("item")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, min(count, -(-chars // most)))

    def block(k: int) -> dict[str, tuple[int, list[str]]]:
        out: dict[str, tuple[int, list[str]]] = {}
        for r in rows.filter(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == k).toLocalIterator():  # most characters, about
            out.setdefault(r.pattern, (r.size, []))[1].append(r.item)
        return out

    return blocks, chars, block


def _automaton(key: str, others: list[str], given: dict):
    """The automaton of a broadcast block, kept in the worker with the others of its pass."""
    import ahocorasick

    cache = common.worker_cache()
    if key not in cache:
        for old in [k for k in cache if isinstance(k, tuple) or (str(k).startswith("automaton ") and k not in others)]:  # vocabularies, and automata of other passes
            del cache[old]
        common.trim()
        a = ahocorasick.Automaton()
        for p, (size, ids) in given.items():
            a.add_word(p, (size, ids))
        if given:
            a.make_automaton()
        cache[key] = a
    return cache[key]


def _merged(ranges: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(ranges[0::2], ranges[1::2], strict=True)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _char_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """The original's characters of ranges of words."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = common.words(data, np.array([0, len(data)]), ~WORD_BYTE)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": int(before[starts[lo]]), "end": int(before[ends[hi - 1]])} for lo, hi in ranges]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", *, n: int = WINDOW, pattern_chars: int = PATTERN_CHARS) -> DataFrame:
    """docs and: n_words, n_hit (long), hit_items (array of ids as strings, sorted), hit_spans (array<struct<start, end>>, characters of the text).

    A word inside any occurrence of an item's window is hit; touching hits make
    one span. Null texts have no words. Equal item rows count once, and a null
    item id is the empty id. A column of
    docs with one of these names is replaced. With no items nothing is hit.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    out = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
    df = docs.drop(*(f.name for f in out if f.name != text))
    base = list(df.schema.fields)
    at = df.columns.index(text)
    ranges_name, ids_name = common.fresh(df.columns, "ranges", "ids")
    state = [T.StructField(ranges_name, T.ArrayType(T.IntegerType())), T.StructField(ids_name, T.ArrayType(T.StringType()))]
    blocks, chars, block = pattern_blocks(items, item_id, item_text, n, pattern_chars)
    per_pass = max(1, PASS_CHARS * blocks // max(chars, 1))

    def stage(given: list, first: bool, last: bool):
        names = [f.name for f in [*base, *(out if last else state)]]
        keys = [f"automaton {uuid.uuid4().hex}" for _ in given]

        def one(words: list[bytes], ranges: list[int], ids: set) -> None:
            hay, spaces = f" {b' '.join(words).decode()} ", None
            for key, b in zip(keys, given, strict=True):
                a = common.worker_cache().get(key) or _automaton(key, keys, b.value)
                if not len(a):
                    continue
                for end, (size, items_) in a.iter(hay):
                    if spaces is None:
                        spaces = np.flatnonzero(np.frombuffer(hay.encode("utf-32-le"), np.uint32) == 32)
                    word = int(np.searchsorted(spaces, end))
                    if len(ranges) >= 2 and ranges[-2] <= word - size <= ranges[-1]:  # the usual case: the next window
                        ranges[-1] = max(ranges[-1], word)
                    else:
                        ranges += [word - size, word]
                    ids.update(items_)

        def run(batches):
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                found = [([], set()) for _ in texts] if first else [(r, set(i)) for r, i in zip(batch.column(len(base)).to_pylist(), batch.column(len(base) + 1).to_pylist(), strict=True)]
                counts = []
                for t, (ranges, ids) in zip(texts, found, strict=True):
                    words = normalise(t)
                    counts.append(len(words))
                    if words:
                        one(words, ranges, ids)
                columns = batch.columns[: len(base)]
                if last:
                    merged = [_merged(r) for r, _ in found]
                    new = [
                        pa.array(counts, pa.int64()),
                        pa.array([sum(hi - lo for lo, hi in m) for m in merged], pa.int64()),
                        pa.array([sorted(i) for _, i in found], pa.list_(pa.string())),
                        pa.array([_char_spans(t, m) if m else [] for t, m in zip(texts, merged, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ]
                else:
                    new = [pa.array([r for r, _ in found], pa.list_(pa.int32())), pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=names)
            common.trim()

        return run

    for lo in range(0, blocks, per_pass):
        last = lo + per_pass >= blocks
        given = [spark.sparkContext.broadcast(block(k)) for k in range(lo, min(blocks, lo + per_pass))]  # PATTERN_CHARS bounds each, PASS_CHARS all
        df = df.mapInArrow(stage(given, lo == 0, last), T.StructType([*base, *(out if last else state)]))
        df = df if last else common.cut(df)
    return df


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, common.table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + {WINDOW} - 1], ' ') AS s FROM b, range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1) g(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
placed AS (SELECT rid, k, sizes.n, array_to_string(w[k:k + sizes.n - 1], ' ') AS s FROM d, sizes, range(1, len(w) + 1) g(k) WHERE k + sizes.n - 1 <= len(w)),
hits AS MATERIALIZED (SELECT rid, k, placed.n, item_id FROM placed JOIN p USING (n, s)),
covered AS (SELECT rid, count(DISTINCT k + j) AS n_hit FROM hits, range(0, n) g(j) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""
