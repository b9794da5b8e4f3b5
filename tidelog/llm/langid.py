"""Language identification by Bayesian evidence fusion.

Text: a multinomial model of byte trigrams (hashed to BUCKETS), fitted on at
most TRAIN_DOCS labelled documents a language; its log likelihood counts as that
of EFFECTIVE trigrams at most, since those of a text are not independent.
Declared markup language and address suffix: how often each language's texts
come with each declaration, counted over all rows. Host priors: languages by
host, smoothed towards the domain's, smoothed towards the corpus's, from grouped
sums. A row's own text is taken off all these counts. The posterior is the
normalised product. A text whose words an even distribution over all trigrams
explains better than any of the languages is in none of them, whatever its
posterior; numbers, addresses and the like do not count in that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

common.ship(__name__)

BUCKETS, TRAIN_DOCS, EFFECTIVE, MAX_LANGUAGES = 1 << 16, 1000, 40.0, 64
#: Bytes of texts that are scored at once.
STEP = 1 << 19
#: How many times train_docs rows of a language are ranked.
DRAWN = 4
#: Texts of fewer trigrams of letters and spaces are not tested for being in none of the languages.
TESTED = 60
#: Weight of the level above in host and domain priors, and of an even share in the declarations' table.
ALPHA, BETA = 5.0, 1.0
#: A row is rejected under this posterior (that of four languages in doubt is 0.25), or without a letter.
LEAST = 0.3
DOMAIN = r"([^.]+\.[^.]+)$"
#: Hosts whose priors are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Address suffixes that speak for a language (fixed values: ISO 3166 country codes and ISO 639 languages).
SUFFIX_LANGUAGE = {"at": "de", "au": "en", "ca": "en", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "nz": "en", "uk": "en", "us": "en"}


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # BUCKETS x languages


def trigrams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the lower-cased bytes, each row's first, one more than rows, and where each starts. None crosses a row's end."""
    low = common.lower_ascii(data).astype(np.uint32)
    n = max(0, len(low) - 2)
    h = ((low[:n] * np.uint32(0x9E3779B1)) ^ (low[1 : n + 1] * np.uint32(0x85EBCA6B)) ^ (low[2 : n + 2] * np.uint32(0xC2B2AE35))) if n else np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    size = np.maximum(0, np.diff(rows) - 2)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(rows[:-1] - first[:-1], size)
    return h[at], first, at


def fit(labelled: DataFrame, id_col: str, text: str, language: str, *, train_docs: int = TRAIN_DOCS) -> TextModel:
    """The text model; of each language the train_docs rows with the smallest hash of id and then of text are read.

    Rows without a text or a language are left out; a null id is an id. Hashes
    are ranked without the texts, and only those so small that about DRAWN times
    train_docs of a language are: the number of rows that meet in a task does not
    grow with the corpus. More than MAX_LANGUAGES languages are an error.
    """
    common.prepare(labelled.sparkSession)
    counts = labelled.filter(F.col(language).isNotNull()).groupBy(F.col(language).alias("l")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    own = labelled.select(F.xxhash64(F.col(id_col)).alias("h"), F.xxhash64(F.col(text)).alias("x"), F.col(language).alias("language"), F.col(text).alias("t")).filter("t is not null and language is not null")
    place = F.row_number().over(Window.partitionBy("language").orderBy("h", "x"))

    def smallest(rows: DataFrame) -> DataFrame:
        ranked = rows.select("language", "h", "x").withColumn("n", place).filter(F.col("n") <= train_docs)
        return common.cut(ranked.select("language", "h", "x").distinct())

    # of a language with few rows all are drawn
    below = {r.l: -(1 << 63) + (DRAWN * train_docs << 64) // r["count"] for r in counts if r["count"] > DRAWN * train_docs}
    drawn = F.lit(True)
    for name, least in below.items():
        drawn = drawn & ((F.col("language") != name) | (F.col("h") < least))
    first = smallest(own.filter(drawn))
    got = {r.language: r["count"] for r in first.groupBy("language").count().collect()}
    if few := [name for name in below if got.get(name, 0) < train_docs]:  # ids or texts that repeat, or are null
        first = smallest(own.filter(F.col("language").isin(few))).union(first.filter(~F.col("language").isin(few)))
    taken = own.join(F.broadcast(first), ["language", "h", "x"], "left_semi")  # MAX_LANGUAGES x train_docs at most
    taken = taken.withColumn("n", place).filter(F.col("n") <= train_docs)  # repeated rows may be more

    def count(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            data, rows = common.buffers(batch.column(1))
            totals = {lang: np.zeros(BUCKETS, np.int64) for lang in names}
            for lang, lo, hi in zip(names, rows[:-1], rows[1:], strict=True):
                totals[lang] += np.bincount(trigrams(data[lo:hi], np.array([0, hi - lo]))[0], minlength=BUCKETS)
            for lang in sorted(totals):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([totals[lang].tobytes()], pa.binary())], names=["language", "counts"])
        common.trim()

    languages: dict[str, np.ndarray] = {}
    for r in taken.select("language", "t").mapInArrow(count, "language string, counts binary").toLocalIterator():  # MAX_LANGUAGES x train_docs / batch rows
        languages[r.language] = languages.get(r.language, 0) + np.frombuffer(r.counts, np.int64)
    names = sorted(languages)
    if not names:
        return TextModel([], np.zeros((BUCKETS, 0), np.float32))
    table = np.stack([languages[x] for x in names], 1) + 0.1
    return TextModel(names, np.log(table / table.sum(0)).astype(np.float32))


def strip_markup(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->|<[^>]*>", " ")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def declared_of(html: Column) -> Column:
    """The main language in the lang attribute of the html element, or of a content-language declaration; empty without one."""
    attribute = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)
    return F.lower(F.when(attribute != "", attribute).otherwise(meta))


def evidence(df: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """keys, host, domain, declared, suffix (class numbers), ll, best, gain: what is left of df (keys, text, host, declared) once the text is read.

    gain is the best language's mean log likelihood of a trigram of letters and
    spaces over that of an even distribution; null of a text with fewer than
    TESTED of these.
    """
    spark = df.sparkSession
    common.prepare(spark)
    names, size = model.languages, len(model.languages)
    given = spark.sparkContext.broadcast(model.logs)  # BUCKETS x MAX_LANGUAGES at most
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("host", T.StringType()), T.StructField("declared", T.StringType()), T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("best", T.IntegerType()), T.StructField("gain", T.DoubleType())])
    n = len(keys)

    def score(data: np.ndarray, rows: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of each row: whether it has a letter, its trigrams, those of letters and spaces, and both kinds' log likelihoods by language."""
        letters = (((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)) | (data >= 0x80)
        plain = letters | (data == 0x20)
        has = np.concatenate([[0], np.cumsum(letters)])
        h, first, at = trigrams(data, rows)
        count = np.diff(first)
        worded, total, prose = np.zeros(len(count), np.int64), np.zeros((len(count), size)), np.zeros((len(count), size))
        full = np.flatnonzero(count > 0)
        if len(full):
            own = (plain[at] & plain[at + 1] & plain[at + 2]).astype(np.float64)
            worded[full] = np.add.reduceat(own, first[full])
            for j, c in enumerate(columns):
                x = c[h]
                total[full, j] = np.add.reduceat(x, first[full])
                x *= own
                prose[full, j] = np.add.reduceat(x, first[full])
        return has[rows[1:]] > has[rows[:-1]], count, worded, total, prose

    def run(batches):
        common.make_room()
        columns = [np.ascontiguousarray(given.value[:, j], np.float64) for j in range(size)]
        for batch in batches:
            data, rows = common.buffers(batch.column(n))
            parts, i, last = [], 0, len(rows) - 1
            while i < last or not parts:  # some rows at a time: what is made of them is fifty times as large
                j = min(last, max(i + 1, int(np.searchsorted(rows, rows[i] + STEP, "right")) - 1))
                parts.append(score(data[rows[i] : rows[j]], rows[i : j + 1] - rows[i], columns))
                i = j
            has, count, worded, total, prose = (np.concatenate(x) for x in zip(*parts, strict=True))
            scaled = total * np.minimum(1.0, EFFECTIVE / np.maximum(count, 1))[:, None]
            best = scaled.argmax(1) if size else np.zeros(len(count), np.int64)
            known = has & bool(size)  # a text too short for a trigram has its priors
            gain = prose[np.arange(len(count)), best] / np.maximum(worded, 1) + np.log(BUCKETS) if size else np.zeros(len(count))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:n], batch.column(n + 1), batch.column(n + 2),
                pa.array([x if k else None for x, k in zip(scaled, known, strict=True)], pa.list_(pa.float64())), pa.array(best.astype(np.int32), mask=~(known & (count > 0))),
                pa.array(gain, mask=~(known & (worded >= TESTED))),
            ], names=[f.name for f in schema.fields])
        common.trim()

    out = df.select(*keys, "text", "host", "declared").mapInArrow(run, schema)
    number = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)]) if names else None
    suffix = F.regexp_extract("host", r"\.([a-z]{2,})$", 1)
    of_suffix = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    as_class = lambda c: F.when(c.isNull() | (c == ""), -1).otherwise(F.coalesce(number[c], F.lit(size))) if names else F.lit(-1)
    return out.select(*keys, "host", F.regexp_extract("host", DOMAIN, 1).alias("domain"), as_class(F.col("declared")).alias("declared"), as_class(of_suffix[suffix]).alias("suffix"), "ll", "best", "gain")


def _counted(df: DataFrame, key: str, size: int) -> DataFrame:
    """key, own: the rows of each language under a key."""
    return df.filter(F.col("best").isNotNull()).groupBy(key).agg(F.array(*[F.sum((F.col("best") == i).cast("double")) for i in range(size)]).alias("own"))


def _own(i: Column) -> Column:
    """What a row adds to the count of language i."""
    return F.when(i == F.col("best"), 1.0).otherwise(0.0)


def _smoothed(counts: Column, above: Column) -> Column:
    """The shares of the languages; the row itself does not count."""
    others = F.transform(counts, lambda n, i: F.greatest(F.lit(0.0), n - _own(i)))
    total = F.aggregate(others, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(others, above, lambda n, p: (n + ALPHA * p) / (total + ALPHA))


def _numbers(rows) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def fuse(seen: DataFrame, model: TextModel, keys: list[str], *, least: float = LEAST) -> DataFrame:
    """keys, language, posterior, gain, kept, from evidence(). seen is read several times: it should be cut."""
    size = len(model.languages)
    if not size:
        return seen.select(*keys, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), "gain", F.lit(False).alias("kept"))
    # (languages + 2) x languages numbers each
    declared, suffix = np.zeros((size + 2, size)), np.zeros((size + 2, size))
    for r in seen.filter("best is not null").groupBy("declared", "suffix", "best").count().collect():
        declared[r.declared, r.best] += r["count"]
        suffix[r.suffix, r.best] += r["count"]
    corpus = F.array(*[F.lit(float(x)) for x in declared.sum(0)])

    def given_language(table: np.ndarray, at: Column) -> Column:
        """log P(class | language) for each language; no declaration says nothing."""
        counts, totals = _numbers(table[: size + 1]), F.array(*[F.lit(float(x)) for x in table[: size + 1].sum(0)])
        logs = F.transform(F.get(counts, at), lambda n, i: F.ln((n - _own(i) + BETA) / (F.get(totals, i) - _own(i) + BETA * (size + 1))))
        return F.when(at >= 0, logs).otherwise(F.array(*[F.lit(0.0)] * size))

    domains = _counted(seen.filter("domain <> ''"), "domain", size).select("domain", F.col("own").alias("domain_own"))
    hosts = _counted(seen.filter("host <> ''"), "host", size).withColumn("domain", F.regexp_extract("host", DOMAIN, 1))
    hosts = common.cut(hosts.join(domains, "domain", "left").select("host", F.col("own").alias("host_own"), "domain_own"))
    # rows without a host have nothing to look up, and are not dealt by a common key
    somewhere = seen.filter("host <> ''").join(F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts, "host", "left")  # checked size
    nowhere = seen.filter("host is null or host = ''")
    for c in ("host_own", "domain_own"):
        nowhere = nowhere.withColumn(c, F.lit(None).cast("array<double>"))
    joined = somewhere.unionByName(nowhere)
    none = F.array(*[F.lit(0.0)] * size)
    total = float(declared.sum())
    top = F.transform(corpus, lambda n, i: (n - _own(i) + BETA) / (total - F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0) + BETA * size))
    above = F.when(F.col("domain_own").isNull(), F.col("top")).otherwise(_smoothed(F.col("domain_own"), F.col("top")))
    prior = _smoothed(F.coalesce("host_own", none), F.col("above"))
    both = F.zip_with(given_language(declared, F.col("declared")), given_language(suffix, F.col("suffix")), lambda x, y: x + y)
    logs = F.zip_with(F.zip_with(F.col("ll"), F.transform(F.col("prior"), lambda p: F.ln(p)), lambda x, y: x + y), both, lambda x, y: x + y)
    scored = joined.withColumn("top", top).withColumn("above", above).withColumn("prior", prior).withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    posterior = 1.0 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    names = F.array(*[F.lit(x) for x in model.languages])
    out = scored.select(*keys, F.get(names, (F.array_position("logs", F.col("most")) - 1).cast("int")).alias("language"), F.coalesce(posterior, F.lit(0.0)).alias("posterior"), "gain")
    return out.withColumn("kept", F.col("language").isNotNull() & (F.col("posterior") >= least) & (F.coalesce("gain", F.lit(0.0)) >= 0))


def identify(df: DataFrame, model: TextModel, keys: list[str], *, text: Column, host: Column | None = None, declared: Column | None = None, least: float = LEAST) -> DataFrame:
    """keys, language, posterior, gain, kept: one row for each row of df.

    text, host and declared are columns made of df's. Null and empty texts and
    those without a letter have no language, posterior 0, and are not kept; a
    null or empty host has the corpus's prior, and a missing declaration says
    nothing. Repeated rows each count. Without labelled rows nothing is kept,
    nor is a text that none of the languages explains (gain under 0). keys may
    have any name; one called language, posterior, gain or kept is replaced.
    """
    nothing = F.lit(None).cast("string")
    own = [k for k in keys if k.lower() not in ("language", "posterior", "gain", "kept")]
    rows = df.select(F.struct(*own).alias("key"), text.alias("text"), (host if host is not None else nothing).alias("host"), (declared if declared is not None else nothing).alias("declared"))
    found = fuse(common.cut(evidence(rows, model, ["key"])), model, ["key"], least=least)
    return found.select(*[F.col("key")[k].alias(k) for k in own], "language", "posterior", "gain", "kept")


def op5_language(spark, sf_dir: str) -> DataFrame:
    """The language of every page and, by text and source, of every document."""
    docs, pages = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "pages")
    model = fit(docs, "doc_id", "text", "lang")
    of_pages = identify(pages, model, ["page_id"], text=strip_markup(F.col("html")), host=host_of(F.col("url")), declared=declared_of(F.col("html")))
    of_docs = identify(docs, model, ["doc_id"], text=F.col("text"), host=F.col("source"))
    missing = F.lit(None).cast("long")
    columns = ["collection", "doc_id", "page_id", "language", "posterior", "gain", "kept"]
    return (
        of_docs.withColumns({"collection": F.lit("documents"), "page_id": missing}).select(columns)
        .unionByName(of_pages.withColumns({"collection": F.lit("pages"), "doc_id": missing}).select(columns))
    )
