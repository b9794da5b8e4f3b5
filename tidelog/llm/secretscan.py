"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

Only DataFrame functions. Spark has no function for the places of matches, so a
lazily matched gap is put before each pattern: gap and match lengths, summed up,
are the places (in code points); the text's end matches too, or the search would
begin again at each place behind the last match. A cheap test on the text comes first; the
expensive part runs on texts with a candidate only.

Entropy: for the strings of a character class, the counts of the characters in
a window of fixed width are kept in a map and changed by the character that
comes in and the one that goes out, and with them the sum of c * log2(c); the
span goes from the first to the last window whose entropy reaches the class's
threshold. Allow-listed candidates are suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

VALUE = "[A-Za-z0-9+/_.=-]"
KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: kind, a cheap test, the pattern (its last group is measured), the least length of that.
BASE = [
    ("assign", f"(?:{KEYWORD})[\"']?\\x20*[:=]", f"(({KEYWORD})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE}+))", 4, 12),
    ("access", "AKIA[A-Z0-9]{14}", "(AKIA[A-Z0-9]+)", 2, 18),
    ("hex", "[0-9a-f]{16}", "([0-9a-f]{16,})", 2, 16),
]


@dataclass(frozen=True)
class EntropyClass:
    """Strings of the characters, at least width long, whose window entropy reaches threshold bits and that match need."""

    kind: str
    chars: str
    width: int
    threshold: float
    need: str


CLASSES = (
    EntropyClass("entropy_hex", "[0-9A-Fa-f]", 24, 3.0, "[0-9]"),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_=-]", 20, 3.9, "[0-9]"),
)
#: Candidates with these are placeholders, not secrets.
ALLOWED = ("EXAMPLE", "(?:[Xx]{6}|0{8}|1{8})", "0123456789", "[Aa][Bb][Cc][Dd][Ee][Ff][Gg]", "[Pp]laceholder", "[Cc]hange_?me")
#: Prefix sums of long lists are made in blocks of so many.
BLOCK = 256


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once: a lambda's argument is bound, a Column is written out at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of the first 1, 2, ... elements, in about n * BLOCK + (n / BLOCK) ** 2 steps."""
    def of(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + _sum(x))))
        return _let(before, lambda sums: F.flatten(F.transform(blocks, lambda x, b: F.transform(x, lambda _, i: F.get(sums, b) + _sum(F.slice(x, F.lit(1), i + 1))))))

    def blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.call_function("div", F.size(a) - 1, F.lit(BLOCK)).cast("int"))
        return F.when(F.size(a) > 0, F.transform(starts, lambda b: F.slice(a, b * BLOCK + 1, BLOCK))).otherwise(F.array().cast("array<array<bigint>>"))

    return _let(_let(lengths, blocks), of)


SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _lengths(a: Column) -> Column:
    return F.transform(a, lambda x: F.length(x).cast("long"))


def _f(x: Column) -> Column:
    return x * F.log2(F.greatest(x, F.lit(1)).cast("double"))


def _hot(candidate: Column, c: EntropyClass) -> Column:
    """struct(first, last): starts of the first and the last hot window, null without one."""
    least = F.lit(float(c.width)) * F.log2(F.lit(float(c.width))) - (c.threshold - 1e-9) * c.width

    def moves(chars: Column) -> Column:
        """For each character the one that leaves the window as it comes in, or null."""
        return F.zip_with(chars, F.concat(F.array_repeat(F.lit(None).cast("string"), c.width), chars), lambda x, y: F.struct(x.alias("came"), y.alias("went")))

    def step(s: Column, x: Column) -> Column:
        came, went = x["came"], x["went"]

        def moved(n: Column) -> Column:
            """n: counts of the two before; counts and sum after."""
            return F.struct(
                F.when(came.eqNullSafe(went), s["counts"]).otherwise(F.transform_values(s["counts"], lambda k, v: v + F.when(k == came, 1).otherwise(0) - F.when(k == went, 1).otherwise(0))).alias("counts"),
                F.when(came.eqNullSafe(went), s["s"]).otherwise(s["s"] + _f(n["a"] + 1) - _f(n["a"]) + _f(F.greatest(n["z"] - 1, F.lit(0))) - _f(n["z"])).alias("s"),
            )

        def seen(m: Column) -> Column:
            hot = (s["i"] >= c.width) & (m["s"] <= least)
            return F.struct(
                m["counts"].alias("counts"), m["s"].alias("s"), (s["i"] + 1).alias("i"),
                F.when(hot, F.coalesce(s["first"], s["i"] - c.width)).otherwise(s["first"]).alias("first"),
                F.when(hot, s["i"] - c.width).otherwise(s["last"]).alias("last"),
            )

        counts = F.struct(F.coalesce(s["counts"][came], F.lit(0)).alias("a"), F.coalesce(s["counts"][went], F.lit(0)).alias("z"))
        return _let(_let(counts, moved), seen)

    def of(chars: Column) -> Column:
        zeros = _let(F.array_distinct(chars), lambda d: F.map_from_arrays(d, F.transform(d, lambda _: F.lit(0))))
        start = F.struct(zeros.alias("counts"), F.lit(0.0).alias("s"), F.lit(1).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
        return F.aggregate(F.slice(moves(chars), F.lit(1), F.size(chars)), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return _let(F.split(candidate, ""), of)


def scan(df: DataFrame, text: str = "text", *, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """df and: secrets, array<struct<start, rank, end, kind>> in order of start and kind; start and end are code points, end exclusive.

    Null counts as an empty text, which has none. A column of df that is called
    secrets is replaced. An allow-list entry suppresses entropy spans only.
    """
    names = df.columns
    t, *work = common.fresh(names, "t", *(f"{k}_{i}" for k in ("base", "cand") for i in range(max(len(BASE), len(classes)) * 2)))
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    found = []
    chunk_cols = {}

    def matches(test: str, pattern: str, **groups: int) -> Column:
        """Of each gap and match: lengths and texts by group; the text is tested once."""
        gapped = F.lit(f"(?s)(.*?)(?:{pattern}|\\z)")
        got = {n: F.regexp_extract_all(F.col(t), gapped, F.lit(g)) for n, g in groups.items()}
        zipped = F.arrays_zip(*(a.alias(n) if n == "text" else _lengths(a).alias(n) for n, a in got.items()))
        return F.when(F.col(t).rlike(test), zipped)

    for k, (kind, test, pattern, group, least) in enumerate(BASE):
        chunk_cols[work[k]] = matches(test, pattern, w=0, m=2, v=group)
    for k, c in enumerate(classes):
        chunk_cols[work[len(BASE) + k]] = matches(f"{c.chars}{{{c.width}}}", f"({c.chars}{{{c.width},}})", w=0, text=2)
    out = out.withColumns(chunk_cols)
    for k, (kind, _, _, _, least) in enumerate(BASE):
        a = F.col(work[k])
        ends = _running(F.transform(a, lambda x: x["w"]))
        spans = F.filter(F.arrays_zip(a.alias("a"), ends.alias("e")), lambda x: x["a"]["v"] >= least)
        found.append(F.transform(spans, lambda x: F.struct((x["e"] - x["a"]["m"]).alias("start"), F.lit(k).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"))))
    for k, c in enumerate(classes):
        a = F.col(work[len(BASE) + k])
        ends = _running(F.transform(a, lambda x: x["w"]))
        kept = F.filter(F.arrays_zip(a.alias("a"), ends.alias("e")), lambda x: x["a"]["text"].rlike(c.need) & ~x["a"]["text"].rlike("|".join(allowed) if allowed else "(?!)"))
        hot = F.transform(kept, lambda x: F.struct((x["e"] - F.length(x["a"]["text"])).alias("at"), _hot(x["a"]["text"], c).alias("h")))
        hot = F.filter(hot, lambda x: x["h"]["first"].isNotNull())
        found.append(F.transform(hot, lambda x: F.struct((x["at"] + x["h"]["first"]).alias("start"), F.lit(len(BASE) + k).alias("rank"), (x["at"] + x["h"]["last"] + c.width).alias("end"), F.lit(c.kind).alias("kind"))))
    out = out.withColumn("secrets", F.when(F.greatest(*(F.col(c).isNotNull() for c in chunk_cols)), F.array_sort(F.concat(*(F.coalesce(f.cast(SPANS), F.array().cast(SPANS)) for f in found)))).otherwise(F.array().cast(SPANS)))
    return out.drop(t, *chunk_cols)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("secrets")
    count = {k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k, *_ in BASE}  # noqa: B023
    return scan(docs).select("doc_id", *count.values(), F.sha2(_joined(F.filter(s, lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"), _joined(s).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, (kind, _, pattern, group, least) in enumerate(BASE):
        p = f"(?s)(.*?){pattern}".replace("'", "''")
        parts.append(f"""SELECT rid, list_sum(lens[1:i]) - length(m[i]) AS s, {k} AS rank, list_sum(lens[1:i]) AS e, '{kind}' AS kind FROM (
    SELECT rid, list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS lens, regexp_extract_all(t, '{p}', 2) AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d), range(1, len(lens) + 1) g(i) WHERE length(v[i]) >= {least}""")
    for k, c in enumerate(CLASSES):
        p = f"(?s)(.*?)({c.chars}{{{c.width},}})"
        parts.append(f"""SELECT rid, min(at_ + j) AS s, {len(BASE) + k} AS rank, max(at_ + j) + {c.width} AS e, '{c.kind}' AS kind FROM (
    SELECT rid, at_, j, -sum(n / {c.width}.0 * log2(n / {c.width}.0)) AS h FROM (
      SELECT rid, at_, j, ch, count(*) AS n FROM (
        SELECT rid, at_, j, substr(x, (j + q)::INT, 1) AS ch FROM (
          SELECT rid, list_sum(lens[1:i]) - length(m[i]) AS at_, m[i] AS x FROM (
            SELECT rid, list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS lens, regexp_extract_all(t, '{p}', 2) AS m FROM d), range(1, len(lens) + 1) g(i)
          WHERE regexp_matches(m[i], '{c.need}') AND NOT regexp_matches(m[i], '{"|".join(ALLOWED)}')), range(0, length(x) - {c.width} + 1) w(j), range(1, {c.width} + 1) z(q)) GROUP BY ALL) GROUP BY ALL)
  WHERE h >= {c.threshold} - 1e-9 GROUP BY rid, at_""")
    joined = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
per AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in BASE)}, {joined} FILTER (rank < {len(BASE)}) AS base, {joined} AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k, *_ in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (rid)"""


ORACLE = _oracle()
