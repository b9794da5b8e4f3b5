"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Only DataFrame functions. Rows are numbered without a global sort: equal rows
(same id, size and checksum) are counted before the shuffle, dealt to a fixed
number of buckets by portable arithmetic, numbered inside their bucket, and
moved up by the rows of the buckets before. The permutation works on the two
digits of the row number in radixes a x b >= N; a result of N or more is put
through it again. Shard and slot are the remainder and the quotient of the new
number by the shard count, so shards differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

#: The moduli of the round function, and the rounds' multipliers and addends, made by a rule from a seed.
P1, P2 = 2_147_483_647, 2_147_483_629
ROUNDS, BUCKETS, WALKS = 6, 4096, 64


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    x, out = (seed * 48271 + 12345) % P1, []
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            x = (x * 48271 + 11) % P1
            key.append(x % (1 << 30) + 1)
        out.append((key[0], key[1], key[2]))
    return out


def radixes(total: int) -> tuple[int, int]:
    a = max(1, -int(-(total**0.5) // 1))
    return a, -(-total // a)


def permute(row: int, total: int, seed: int = 0) -> int:
    """The new number of a row; what the Column form computes."""
    a, b = radixes(total)
    x = row
    while True:
        left, right, ma, mb = x // b, x % b, a, b
        for k in round_keys(seed):
            left, right, ma, mb = right, (left + (right * k[0] + k[1]) % P1 * k[2] % P2) % ma, mb, ma
        x = left * b + right
        if x < total:
            return x


def row_at(shard: int, slot: int, total: int, shards: int = 16, seed: int = 0) -> int:
    """The row number that has this shard and slot: the permutation backwards."""
    a, b = radixes(total)
    x = slot * shards + shard
    while True:
        left, right, ma, mb = x // b, x % b, a, b
        for k in reversed(round_keys(seed)):
            # one round made (l, r) to (r, (l + F(r)) % ma)
            ma, mb = mb, ma
            left, right = (right - (left * k[0] + k[1]) % P1 * k[2] % P2) % ma, left
        x = left * b + right
        if x < total:
            return x


def permuted(row: Column, total: Column, seed: int = 0) -> Column:
    """permute() as a Column; raises where the walk is longer than WALKS, whose chance is below sqrt(N) ** -WALKS."""
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    b = F.call_function("div", total + a - 1, a)
    keys = F.array(*[F.struct(F.lit(x).cast("long").alias("m"), F.lit(y).cast("long").alias("c"), F.lit(z).cast("long").alias("n")) for x, y, z in round_keys(seed)])

    def step(s: Column, k: Column) -> Column:
        f = (s["r"] * k["m"] + k["c"]) % P1 * k["n"] % P2
        return F.struct(s["r"].alias("l"), ((s["l"] + f) % s["ma"]).alias("r"), s["mb"].alias("ma"), s["ma"].alias("mb"))

    def once(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r"), a.alias("ma"), b.alias("mb"))
        return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), once(row), lambda x, _: F.when(x < total, x).otherwise(once(x)))
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def manifest(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, shards: int = 16, seed: int = 0) -> DataFrame:
    """One row for each row of df: the id, size, text_crc32, row_number, n_rows, shard, slot.

    size is the text's UTF-8 bytes plus 1; null counts as empty. Equal rows are
    interchangeable and get consecutive row numbers; a null id is an id like any
    other. An empty df gives no rows. Other columns of df are not carried.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"))
    rows = rows.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    number = F.pmod(F.coalesce(F.col("id").cast("long"), F.lit(0)), F.lit(P1).cast("long"))
    mixed = (number * 742_938_285 + F.col("crc") % P1 * 68_718_951 + F.col("size") % 65_536 * 4_099) % P1
    rows = common.cut(rows.withColumn("bucket", mixed * 950_706_376 % P2 % BUCKETS))  # the texts are read once
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows at most
    counts = rows.groupBy("bucket").agg(F.sum("n").alias("n"))
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("n_rows"))
    own = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("id"), "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("first", F.coalesce(F.sum("n").over(own), F.lit(0)))
    placed = first.join(F.broadcast(offsets), "bucket")  # BUCKETS rows at most
    part = 10_000
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(part).cast("long")))))
    placed = placed.withColumn("i", F.explode(F.sequence(F.col("part") * part, F.least(F.col("n"), (F.col("part") + 1) * part) - 1)))
    placed = placed.withColumn("row_number", F.col("base") + F.col("first") + F.col("i"))
    placed = placed.withColumn("new", permuted(F.col("row_number"), F.col("n_rows"), seed))
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "row_number", "n_rows",
        (F.col("new") % shards).cast("int").alias("shard"), F.call_function("div", F.col("new"), F.lit(shards).cast("long")).alias("slot"),
    )


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15, whose counts are at most one apart."""
    return manifest(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def _oracle(shards: int = 16, seed: int = 0) -> str:
    rounds = []
    for i, (m, c, n) in enumerate(round_keys(seed)):
        rounds.append(f"r{i} AS MATERIALIZED (SELECT x, a, b, total, mb AS ma, ma AS mb, r AS l, (l + (r * {m} + {c}) % {P1} * {n} % {P2}) % ma AS r FROM {'s0' if i == 0 else f'r{i - 1}'})")
    return f"""
WITH RECURSIVE poly AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) g(i))),
bytes AS (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (SELECT rid, doc_id, size, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, size), lambda i: ('0x' || substr(h, (2 * i - 1)::INT, 2))::UBIGINT),
    lambda c, x: xor(c >> 8, poly.t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc FROM bytes, poly),
numbered AS (SELECT doc_id, size, crc, (((coalesce(doc_id, 0) % {P1} + {P1}) % {P1}) * 742938285 + crc % {P1} * 68718951 + size % 65536 * 4099) % {P1} * 950706376 % {P2} % {BUCKETS} AS bucket FROM crcs),
ranked AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, crc) - 1 AS n, count(*) OVER () AS total FROM numbered),
sized AS (SELECT *, ceil(sqrt(total::DOUBLE))::BIGINT AS a FROM ranked),
every AS (SELECT x, a, (total + a - 1) // a AS b, total FROM (SELECT DISTINCT a, total FROM sized) q, range((q.total + q.a)) g(x)),
s0 AS (SELECT x, a, b, total, a AS ma, b AS mb, x // b AS l, x % b AS r FROM every WHERE x < a * b),
{", ".join(rounds)},
perm AS MATERIALIZED (SELECT x, l * b + r AS y, total FROM r{ROUNDS - 1}),
walk AS (SELECT x, y, total FROM perm WHERE x < total UNION ALL SELECT w.x, p.y, w.total FROM walk w JOIN perm p ON p.x = w.y WHERE w.y >= w.total),
placed AS (SELECT x, y FROM walk WHERE y < total)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (y % {shards})::INT AS shard, (y // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM sized JOIN placed ON placed.x = sized.n"""


ORACLE = _oracle()
