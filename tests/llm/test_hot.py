"""Passages that a third of all documents have, whole and with other words around and inside."""

import random

import pytest
from test_corpus_operators import frame, prose, repeats_by_hand

from tidelog.llm import substring


@pytest.mark.parametrize("least", [2, 8, 64])
def test_hot_passages_equal_brute_force(spark, monkeypatch, least):
    rng, hot = random.Random(least), prose(70, 40)
    monkeypatch.setattr(substring, "LEAST_HOT", least)
    seen, real = [], substring.hot_nodes
    monkeypatch.setattr(substring, "hot_nodes", lambda *a: seen.append(real(*a)) or seen[-1])
    texts = []
    for i in range(240):
        own = prose(1000 + i, rng.randrange(5, 40))
        if i % 3 == 0:
            passage = hot[rng.choice([0, 0, 0, 9]) : rng.choice([40, 40, 40, 30, 22])]
            if i % 30 == 0:
                passage = [*passage[:14], "other", *passage[15:]]
            own = own + passage + prose(5000 + i, rng.randrange(0, 20)) + (passage if i % 7 == 0 else [])
        texts.append((1000 - i, " ".join(own)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(frame(spark, texts).repartition(6)).collect()}
    assert got == repeats_by_hand(texts)
    nodes, branching = seen[0]
    assert len(nodes) and branching.any() and not branching.all() and (nodes[1:] > nodes[:-1]).all()
