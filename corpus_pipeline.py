"""The corpus pipeline: language, lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
as Parquet into the shared folder and reads it again for the next. All but the
last return the columns of documents; the last adds token ids and their decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, common, decontam, langid, linededup, minhash

#: Ids up to so many (8 bytes each) are broadcast to pick rows; more are joined by a shuffle.
BROADCAST_IDS = 300_000
#: Least similarity of near-duplicates, in percent.
PERCENT = 80


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df  # checked size


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone; rows without an id stay."""
    return docs.join(_small(common.cut(gone.select("doc_id").distinct())), "doc_id", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, *, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Documents whose language can be told, and is one of wanted if that names some.

    Texts without a letter, null ones, those in doubt between all languages and
    those that none of the labelled languages explains go. A row is judged by
    its text and source alone: it may lack an id, and equal ones fare alike. A
    missing lang becomes the language found; the other columns stay.
    """
    model = langid.fit(common.table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    text, source, unnamed = keys = common.fresh(docs.columns, "text_key", "source_key", "unnamed")
    keyed = docs.withColumns({text: F.xxhash64(F.coalesce("text", F.lit(""))), source: F.xxhash64(F.coalesce("source", F.lit(""))), unnamed: F.col("lang").isNull()})
    found = langid.identify(keyed, model, keys, text=F.col("text"), host=F.col("source"))
    right = F.col("kept") & (F.col("language").isin(*wanted) if wanted else F.lit(True))
    judged = common.cut(found.filter(~right | F.col(unnamed)).select(text, source, "language", right.alias("right")).distinct())
    out = keyed.join(_small(judged.filter("not right").select(text, source)), [text, source], "left_anti")
    names = judged.filter("right")
    if not names.isEmpty():
        out = out.join(_small(names.select(text, source, F.col("language").alias(unnamed + "_language"))), [text, source], "left")
        out = out.withColumn("lang", F.coalesce("lang", unnamed + "_language"))
    return out.select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that earlier documents have; documents with nothing left go. Null texts and rows without an id stay as they are."""
    out = linededup.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\t\r\n", "   ")) != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8: the one with the smallest id. Texts without words, null ones and rows without an id stay."""
    found = minhash.near_duplicates(docs, percent=PERCENT)
    return _without(docs, found.filter("not kept")).select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null texts and rows without an id have none, or are judged like others."""
    found = decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text. Null and empty texts have no ids; columns of docs called so are replaced."""
    out = bpe.encode(docs, decoded=True)
    return out.withColumn("decodes", F.col("decoded_bytes") == F.coalesce("text", F.lit("")).cast("binary")).drop("decoded_bytes")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages leave of documents."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs


#: The language model and the alignment are not expressible in SQL.
ORACLE_SQL = None
