"""What an operator would leave undone on rows that the small tables do not have."""

import itertools
import random

import pytest

from conftest import SMALL
from tidelog.llm import linededup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], SCHEMA)


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(3))


def prose(seed, n):
    rng = random.Random(seed)
    return [word(rng.randrange(16_000)) for _ in range(n)]


def edited(words, n):
    """words with n of them changed, each in a shingle of its own."""
    return [word(16_000 + i) if i % (len(words) // n) == 20 and i // (len(words) // n) < n else w for i, w in enumerate(words)]


def test_pipeline_takes_near_copies_from_four_fifths_on(spark):
    import corpus_pipeline

    base = prose(41, 200)
    near, far = edited(base, 4), edited(base, 5)
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in (base, near, far)]
    assert 0.8 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.83 and 0.76 < len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.8
    one = frame(spark, [(1, " ".join(base)), (2, " ".join(near))])
    two = frame(spark, [(1, " ".join(base)), (3, " ".join(far))])
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, one, SMALL).collect()] == [1]
    assert corpus_pipeline.near_duplicates(spark, two, SMALL).count() == 2


def test_a_block_of_many_documents_goes_as_one_of_few_does(spark):
    one, two = " ".join(prose(1, 4)), " ".join(prose(2, 4))
    texts = [(0, two), (1, f"{one}\n{two}")] + [(i, f"{one}\n{two}\n{' '.join(prose(100 + i, 6))}") for i in range(2, 70)]
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {i: 2 if i > 1 else 0 for i in range(70)}


def blocks_by_hand(texts, lines=2, chars=100):
    """What is left when each later document is compared with all earlier ones, at every two of their lines."""
    split = {i: [x.strip(" \t\r") for x in t.split("\n")] for i, t in texts.items()}
    gone = {i: set() for i in texts}
    for a, b in itertools.combinations(sorted(split), 2):
        x, y = split[a], split[b]
        if x == y and any(x):
            gone[b] |= set(range(len(y)))
        for i, j in itertools.product(range(len(x)), range(len(y))):
            if x[i] != y[j] or (i and j and x[i - 1] == y[j - 1]):
                continue
            n = next(k for k in itertools.count() if i + k == len(x) or j + k == len(y) or x[i + k] != y[j + k])
            full = [z for z in y[j : j + n] if z]
            if len(full) >= lines or sum(map(len, full)) >= chars:
                gone[b] |= set(range(j, j + n))
    return {i: [z for n, z in enumerate(y) if z and n not in gone[i]] for i, y in split.items()}


def left(rows):
    """The lines that are not blank: of a blank one at a block's end it does not matter which earlier document had it."""
    return {r.doc_id: [x.strip(" \t\r") for x in r.text.split("\n") if x.strip(" \t\r")] for r in rows}


def test_a_block_is_found_in_any_earlier_document(spark):
    one, two, long = " ".join(prose(1, 4)), " ".join(prose(2, 4)), " ".join(prose(3, 30))
    texts = {0: one, 1: two, 2: f"{one}\n{two}", 3: f"x\n{one}\n{two}\ny", 4: f"{one}\n\n{two}", 5: f"p\n{one}\n\n{two}\nq", 6: f"{two}\nr\n{one}"}
    texts |= {7: f"a\n{long}\nb", 8: f"{one}\nc\n{long}", 9: f"s\nt\n{one}\n{two}\nu\nv", 10: f"u\nv\nw\ns\nt\nz\nu\nv"}
    got = left(linededup.dedup_lines(frame(spark, list(texts.items()))).collect())
    assert got[3] == ["x", "y"] and got[4] == [one, two] and got[5] == ["p", "q"] and got[8] == [one, "c"] and got[10] == ["w", "z"]
    assert got == blocks_by_hand(texts)


@pytest.mark.parametrize("lines, chars", [(2, 100), (3, 45), (1, 1000)])
def test_lines_equal_a_comparison_with_all_earlier_documents(spark, lines, chars):
    rng = random.Random(8)
    pool = [" ".join(prose(200 + i, 4)) for i in range(24)] + ["", "short", " ".join(prose(300, 40))]
    parts = lambda i: [pool[s : s + rng.randrange(1, 4)] if rng.random() < 0.6 else [" ".join(prose(900 + 9 * i + j, 6))] for j, s in enumerate(rng.choices(range(27), k=rng.randrange(1, 8)))]
    texts = {i: "\n".join(itertools.chain.from_iterable(parts(i))) for i in range(90)}
    texts[95] = texts[3]
    got = linededup.dedup_lines(frame(spark, list(texts.items())).repartition(5), block_lines=lines, block_chars=chars).collect()
    assert left(got) == blocks_by_hand(texts, lines, chars)


def test_numbers_at_any_depth(spark):
    import json

    from tidelog.operators import report

    deep = 1.5
    for k in "gfedcba":
        deep = {k: deep, "n": True}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"x": 2}'), (3, None)], "id int, j string")
    assert {(r.id, r.path, r.number) for r in report.flatten(rows, "j", ["id"]).collect()} == {(1, "a.b.c.d.e.f.g", 1.5), (2, "x", 2.0)}
