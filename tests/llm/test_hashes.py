"""Words and texts of a regular build, on which polynomial hashes modulo a power of two collide."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_corpus_operators import frame, groups_by_hand, prose, repeats_by_hand

from tidelog.llm import common, minhash, substring


def thue_morse(n, one="a", two="b"):
    return [one if i.bit_count() % 2 else two for i in range(n)]


def spread(texts):
    data, rows = common.buffers(pa.array(texts))
    return common.hash_words(data, *common.words(data, rows)[:2])


def test_hashes_of_words_of_any_length():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in [*range(1, 40), 255, 256, 257, 300] for _ in range(9)]
    words = sorted({*words, *("é" * n for n in range(1, 30)), *("x" * n for n in range(1, 600)), "z" * 3_000_000})
    rng.shuffle(words)
    one = spread([" ".join(words)])
    assert len(set(one.tolist())) == len(words) and (one == np.concatenate([spread([w]) for w in words])).all()
    for n in (64, 1024, 2048, 4096):
        x, y = "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))
        assert len(set(spread([f"{x} {y} {x.upper()} {y.upper()}"]).tolist())) == 4


def test_digests_of_spans():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    words[300:340] = words[20:60]
    place = np.concatenate([np.arange(250), np.arange(150)])
    sums = common.running(words, place)
    at = lambda lo, hi, row: common.between(*(np.array([(int(sums[i]) - int(sums[row])) % common.PRIME], np.uint64) for i in (lo, hi)), np.array([lo - row]))
    assert at(20, 60, 0) == at(300, 340, 250) != at(21, 61, 0)
    by_hand = sum(int(w) % common.PRIME * pow(common.BASE, i, common.PRIME) for i, w in enumerate(words[20:60])) % common.PRIME
    assert int(at(20, 60, 0)[0]) == by_hand
    big = np.array([common.PRIME - 1, 1, 0], np.uint64)
    assert [int(x) for x in common.times(big, big)] == [1, 1, 0]


@pytest.mark.parametrize("n", [1024, 2048])
def test_regular_words_are_told_apart(spark, n):
    x, y = "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))
    head = " ".join(prose(5, 12))
    texts = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"q {x}"), (4, f"q {y}"), (5, f"{head} {x}")]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(frame(spark, texts)).collect()} == repeats_by_hand(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts)).collect()} == groups_by_hand(texts)


def test_regular_sequences_are_told_apart(spark):
    for n in (1024, 2048):
        texts = [(1, " ".join(thue_morse(n))), (2, " ".join(thue_morse(n, "b", "a"))), (3, " ".join(["c", *thue_morse(n)]))]
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(frame(spark, texts)).collect()} == repeats_by_hand(texts)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts)).collect()} == groups_by_hand(texts)


def test_words_behind_a_passage_are_told_apart_whole(spark):
    """Every pair shares 25 words and goes on with two words whose hashes are equal in 31 of their bits; those come from a search."""
    names = [f"v{i}" for i in range(400_000)]
    hashes = spread([" ".join(names)])
    found = []
    for shift in (0, 16, 32):
        codes = (hashes >> np.uint64(shift)) & np.uint64(0xFFFFFFFE)
        order = np.argsort(codes)
        found += [(names[order[i]], names[order[i + 1]]) for i in np.flatnonzero(codes[order][1:] == codes[order][:-1])[:12]]
    assert len(found) >= 20
    texts = []
    for i, (x, y) in enumerate(found):
        shared = " ".join(prose(4000 + i, 25))
        texts += [(2 * i, f"{shared} {x} {' '.join(prose(6000 + i, 8))}"), (2 * i + 1, f"{shared} {y} {' '.join(prose(8000 + i, 8))}")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(frame(spark, texts)).collect()}
    assert got == repeats_by_hand(texts) and all(got[2 * i + 1][1] == 25 for i in range(len(found)))


def test_a_family_under_the_threshold_makes_few_pairs(spark, monkeypatch):
    base, seen = prose(900, 120), []

    def member(i):
        rng = random.Random(i)
        w = list(base)
        for at in (10, 40, 70, 100):
            w[at] = f"own{rng.randrange(10**9)}"
        return " ".join(w)

    texts = [(i, member(i)) for i in range(300)]
    real = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda *a: seen.append(common.cut(real(*a))) or seen[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == groups_by_hand(texts) and {c for _, c in got.values()} == set(range(300))
    assert sum(x.count() for x in seen) == 0
