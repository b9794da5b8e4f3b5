"""Hot keys, many blocks, wide numbers, foreign languages and clashing names."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import BASE, ODD, frame, local, prose

from conftest import SMALL
from tidelog.llm import bpe, common, decontam, langid, linededup, minhash, queries, secretscan, shard, substring, tokencount, topk

FOREIGN = {
    "fi": "Aamulla satoi vettä ja tuuli puhalsi kylmästi järven yli. Kalastaja istui laiturilla, joi kuumaa kahvia ja odotti, että pilvet väistyisivät ennen iltaa.",
    "pl": "Rano padał deszcz, a zimny wiatr wiał od jeziora. Rybak siedział na pomoście, pił gorącą kawę i czekał, aż chmury rozejdą się przed wieczorem.",
    "ru": "Утром шёл дождь, и холодный ветер дул с озера. Рыбак сидел на причале, пил горячий кофе и ждал, когда к вечеру разойдутся тучи.",
    "zh": "早上下着雨，冷风从湖面吹来。渔夫坐在码头上，喝着热咖啡，等着乌云在傍晚之前散去。",
    "none": "xqzvk jwpfh bgtmz kqxvw zzpqj hvkxw qjzxp vbkwq xzjqk wvpzx kqjxz",
}


# --- joins ---


def test_a_hot_key_is_dealt_over_many_parts(spark):
    rows = [(7 if i % 3 == 0 else i, i, "x") for i in range(900)] + [(None, -1, "x")]
    left = spark.createDataFrame(rows, "k long, doc long, salt string")
    right = common.cut(left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least")))
    got = common.spread_join(left, right, ["k"], "n", "doc")
    assert sorted(got.columns) == ["doc", "k", "least", "salt"]
    least = {}
    for k, doc, _ in rows:
        least[k] = min(doc, least.get(k, doc))
    assert sorted((r.doc, r.k, r.least, r.salt) for r in got.collect()) == sorted((doc, k, least[k], x) for k, doc, x in rows if k is not None)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "explode" in plan
    few = common.spread_join(left.limit(0), right.limit(0), ["k"], "n", "doc")
    assert few.collect() == []


def test_cut_tables_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(common, "TABLES", [])
    df = common.cut(spark.range(5))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and common.clear(spark) == 1 and common.clear(spark) == 0
    assert not os.path.exists(folder)


# --- 1 ---


def test_items_beyond_one_pass(spark, monkeypatch):
    rng = random.Random(4)
    words = prose(60, 400)
    items = spark.createDataFrame([(i, " ".join(words[s : s + rng.randrange(3, 30)])) for i, s in enumerate(rng.choices(range(380), k=25))] + [(None, "q q"), (3, None), (3, "q q")], "item_id long, text string")
    docs = frame(spark, [(i, " ".join(words[s : s + 60] + prose(70 + i, 5) + ["Q", "q"])) for i, s in enumerate(range(0, 340, 20))] + [(99, None)])
    rows = lambda df: sorted(local(df), key=lambda r: r["doc_id"])
    one = rows(decontam.decontaminate(docs, items))
    monkeypatch.setattr(decontam, "PASS_CHARS", 2500)
    assert rows(decontam.decontaminate(docs, items, pattern_chars=900)) == one
    assert all({"", "3"} <= set(r["hit_items"]) for r in one if r["doc_id"] != 99) and sum(len(r["hit_items"]) for r in one) > 60
    blocks, _, block = decontam.pattern_blocks(items, "item_id", "text", 10, 900)
    assert blocks > 8 and max(sum(len(p) + sum(map(len, ids)) for p, (_, ids) in block(k).items()) for k in range(blocks)) < 2500


# --- 3 ---


def exact_ranks(vectors, queries_, k=5):
    scaled = {i: [int(256 * x) if float(x).is_integer() else int(np.floor(256.0 * x)) for x in v] for i, v in vectors.items()}
    score = lambda a, b: sum(x * y for x, y in zip(scaled[a], scaled[b], strict=False))
    return {(q, n + 1): i for q in queries_ for n, i in enumerate(sorted((i for i in scaled if i != q), key=lambda i: (-score(q, i), i))[:k])}


def test_scores_beyond_a_long_are_still_ranked(spark):
    vectors = {0: [3e38, 1.0], 1: [3.1e38, -4.0], 2: [3e38, 2.0], 3: [-3e38, 0.0], 4: [1.0, 3e38], 50: [2.0, -3e38], 6: [0.5, 0.25], 7: [2.9e38, 5.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = topk.search(df, df.filter("vec_id % 50 = 0")).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in got} == exact_ranks(vectors, [0, 50])
    assert {r.score for r in got if r.query_id == 0 and r.rank == 1} == {2**63 - 1} and min(r.score for r in got) == -(2**63)


def test_components_that_the_scaling_makes_infinite_take_no_part(spark):
    df = spark.createDataFrame([(0, [1e308, 1.0]), (50, [1e200, 2.0]), (2, [3.0, 1.0]), (3, [1e200, -2.0]), (4, [])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in topk.search(df, df.filter("vec_id % 50 = 0")).collect()}
    assert got == {(50, 1): 3, (50, 2): 2, (50, 3): 4}


def test_the_index_is_made_once_for_all_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (300, 4)))], "vec_id long, embedding array<double>")
    written, real = [], common.cut
    monkeypatch.setattr(common, "cut", lambda d: written.append(d.columns) or real(d))
    many = topk.search(df, df.filter("vec_id % 10 = 0"), query_block=7).collect()
    assert written.count(["vec_id", "pivot", "dist", "v"]) == 1
    assert sorted(many) == sorted(topk.search(df, df.filter("vec_id % 10 = 0")).collect())
    by_bytes = topk.search(df, df.filter("vec_id % 10 = 0"), query_bytes=200).collect()
    assert sorted(by_bytes) == sorted(many)


# --- 5 ---


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id", "text", "lang")


def test_texts_in_no_labelled_language_are_rejected(spark, model):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = langid.identify(d, model, ["doc_id"], text=F.col("text"), host=F.col("source")).collect()
    assert all(r.kept for r in own)
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(FOREIGN.items()), "doc_id string, text string"), model, ["doc_id"], text=F.col("text")).collect()}
    assert not any(r.kept for r in got.values()) and all(r.gain < 0 and r.language for r in got.values())


def test_keys_of_any_name(spark, model):
    df = spark.createDataFrame([(1, "the other thing", "a.de", "b", "c", "d", 2, 3.0, True)], "text long, t string, host string, best string, domain string, declared string, suffix int, ll double, kept boolean")
    keys = ["text", "host", "best", "domain", "declared", "suffix", "ll", "kept"]
    r = langid.identify(df, model, keys, text=F.col("t"), host=F.col("host"), declared=F.col("declared")).first()
    assert (r.text, r.host, r.best, r.domain, r.declared, r.suffix, r.ll) == (1, "a.de", "b", "c", "d", 2, 3.0) and r.language


def test_training_rows_are_bounded_whatever_their_ids(spark):
    rows = [(None, f"text number {i % 7}", "en") for i in range(60)] + [(1, "ein anderer text", "de")] * 30 + [(2, None, "de"), (3, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df, "doc_id", "text", "lang", train_docs=5)
    assert m.languages == ["de", "en"]
    total = np.exp(m.logs.astype(float)).sum(0)
    assert np.allclose(total, 1, atol=1e-3)
    assert langid.fit(df.limit(0), "doc_id", "text", "lang").languages == []
    # the rows drawn do not matter: the same smallest hashes are found, and all rows where too few are drawn
    plain = spark.createDataFrame([(i, f"text {i}", "en" if i % 3 else "de") for i in range(900)] + [(i % 2, "same", "fr") for i in range(300)], "doc_id long, text string, lang string")
    models = []
    for factor in (2, 10**6):
        langid.DRAWN, was = factor, langid.DRAWN
        models.append(langid.fit(plain, "doc_id", "text", "lang", train_docs=9))
        langid.DRAWN = was
    assert models[0].languages == models[1].languages == ["de", "en", "fr"] and (models[0].logs == models[1].logs).all()
    many = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(langid.MAX_LANGUAGES + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(many, "doc_id", "text", "lang")


def test_rows_without_a_host_fare_as_with_a_new_one(spark, model):
    df = spark.createDataFrame([(1, "the other thing", None), (2, "the other thing", ""), (3, "the other thing", "new.example")], "doc_id long, text string, host string")
    for most in (langid.BROADCAST_HOSTS, 0):
        langid.BROADCAST_HOSTS, was = most, langid.BROADCAST_HOSTS
        got = langid.identify(df, model, ["doc_id"], text=F.col("text"), host=F.col("host")).collect()
        langid.BROADCAST_HOSTS = was
        assert len({(r.language, round(r.posterior, 12)) for r in got}) == 1 and len(got) == 3


# --- 8 ---


def test_most_of_a_token_by_hand():
    rng = random.Random(6)
    for _ in range(300):
        ends = np.cumsum([rng.randrange(1, 6) for _ in range(rng.randrange(1, 20))])
        first, last = np.concatenate([[0], ends[:-1]]), ends
        sections = np.array([sorted((rng.randrange(ends[-1] + 3), rng.randrange(ends[-1] + 3))) for _ in range(rng.randrange(1, 8))])
        want = [0] * len(sections)
        for a, b in zip(first, last, strict=True):
            whole = [n for n, (lo, hi) in enumerate(sections) if lo <= a and b <= hi]
            shared = [max(0, min(b, hi) - max(a, lo)) for lo, hi in sections]
            for n in whole or ([shared.index(max(shared))] if max(shared) else []):
                want[n] += 1
        assert tokencount.allot(first, last, sections, "most")[0].tolist() == want


# --- long words and texts ---


def test_a_word_and_a_text_of_megabytes(spark):
    long, sep = "k" * 2_500_000, " ".join(prose(80, 12))
    texts = [(1, long), (2, f"{sep} {long}"), (3, f"{sep} {long}"), (4, f"{sep} {long}x"), (5, "a1b2 " * 500_000)]
    df = frame(spark, texts)
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == {1: (1, 1), 2: (9, 2), 3: (9, 2), 4: (9, 4), 5: (1, 5)}
    items = spark.createDataFrame([(1, f"{sep} {long}")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.decontaminate(df, items).collect()} == {1: 0, 2: 13, 3: 13, 4: 12, 5: 0}
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    assert all(bytes(r.decoded_bytes).decode() == r.text for r in bpe.encode(df, decoded=True).collect())
    assert {r.doc_id for r in tokencount.section_tokens(df).collect()} == {1, 2, 3, 4, 5}
    assert {r.doc_id: r.size for r in shard.manifest(df, shards=2).collect()}[5] == 2_500_001
    assert {r.doc_id: len(r.secrets) for r in secretscan.scan(df).collect()}[1] == 0


# --- pipeline ---


PIPELINE = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, token_ids long, n_tokens string, decodes string, kept string, language string, text_key string"


def test_pipeline_on_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    english = spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(9).collect()
    rows = [(i if i else None, r.text, "en" if i % 2 else None, "s" if i % 3 else None, 1, *["own"] * 1, 5, *["own"] * 5) for i, r in enumerate(english)]
    rows += [(200, FOREIGN["pl"], None, "s", 1, "own", 5, *["own"] * 5), (201, None, None, None, None, None, None, *[None] * 5), (202, "", "en", "s", 0, "own", 5, *["own"] * 5)]
    for name, n in (("some", None), ("none", 0)):
        d = str(tmp_path / name)
        df = spark.createDataFrame(rows, PIPELINE)
        (df if n is None else df.limit(0)).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES:
            out = common.cut(stage(spark, docs, d))
            if stage_name != "tokens":
                assert out.columns == docs.columns, stage_name
                docs = out
            got = out.collect()
            assert bool(got) == (n is None), stage_name
            if n is None and stage_name == "language":
                assert {r.doc_id for r in got} == {None, *range(1, 9)}  # a row without an id is as good as others
                assert {r.doc_id: r.lang for r in got} == {None if not i else i: "en" for i in range(9)}
    # without labels in documents nothing can be told
    only = corpus_pipeline.language(spark, spark.read.parquet(f"{tmp_path}/some/documents.parquet"), f"{tmp_path}/some", wanted=("de",))
    assert only.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_texts_alone(spark, tmp_path, name):
    """Every query on odd texts, each row several times."""
    texts = [(i, t) for i, t in enumerate(ODD + [" ".join(BASE)]) for _ in range(2)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    if "doc_id" in got.columns and name not in ("op8_section_tokens",):
        assert {r.doc_id for r in got.select("doc_id").collect()} >= set(range(len(ODD) + 1))
