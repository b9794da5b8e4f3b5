"""The queries without SQL over whole small tables, against plain Python that shares nothing with the operators."""

import itertools
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pytest
from test_corpus_operators import groups_by_hand, tiktoken_codec
from test_whole import blocks_by_hand, left

from conftest import SMALL
from tidelog.llm import langid, linededup, queries

SUFFIXES = {"at": "de", "au": "en", "ca": "en", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "nz": "en", "uk": "en", "us": "en"}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()


# --- 5 ---


def buckets(text):
    """A text's trigrams of bytes, lower-cased, as numbers below 65536."""
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    out = []
    for x, y, z in zip(b, b[1:], b[2:], strict=False):
        h = (x * 0x9E3779B1 ^ y * 0x85EBCA6B ^ z * 0xC2B2AE35) & 0xFFFFFFFF
        out.append((((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 16)
    return out


def languages_by_hand(model, rows):
    """rows: (id, text, host, declared); id to (language, posterior, kept)."""
    names = sorted(model)
    seen = []
    for i, text, host, declared in rows:
        t = buckets(text)
        has = any(c.isascii() and c.isalpha() or not c.isascii() for c in text or "")
        ll = [sum(math.log((model[n][x] + 0.1) / (model[n].total() + 0.1 * 65536)) for x in t) for n in names]
        scale = min(1.0, 40 / max(len(t), 1))
        known = has and bool(names)
        best = ll.index(max(ll)) if known and t else None
        suffix = SUFFIXES.get((re.search(r"\.([a-z]{2,})$", host or "") or [None, None])[1])
        as_class = lambda c: -1 if not c else names.index(c) if c in names else len(names)
        domain = (re.search(r"([^.]+\.[^.]+)$", host or "") or [None, ""])[1]
        b = (text or "").encode()
        plain = [x >= 0x80 or x == 0x20 or chr(x).isalpha() for x in b]
        prose = [x for n, x in enumerate(t) if all(plain[n : n + 3])]
        chosen = model[names[best]] if best is not None else None
        gain = sum(math.log((chosen[x] + 0.1) / (chosen.total() + 0.1 * 65536)) for x in prose) / len(prose) + math.log(65536) if chosen and len(prose) >= 60 else None
        seen.append((i, [x * scale for x in ll] if known else None, best, host or "", domain, as_class(declared), as_class(suffix), gain))
    votes = [r for r in seen if r[2] is not None]
    tables = {k: Counter((r[k], r[2]) for r in votes) for k in (3, 4, 5, 6)}
    totals, out = Counter(r[2] for r in votes), {}
    for i, ll, best, host, domain, declared, suffix, gain in seen:
        if ll is None:
            out[i] = (None, 0.0, False)
            continue
        own = [1 if j == best else 0 for j in range(len(names))]
        top = [(totals[j] - own[j] + 1) / (sum(totals.values()) - sum(own) + len(names)) for j in range(len(names))]

        def smoothed(k, at, above, own=own):
            counts = [max(0, tables[k][at, j] - own[j]) for j in range(len(names))]
            return [(c + 5 * p) / (sum(counts) + 5) for c, p in zip(counts, above, strict=True)]

        prior = smoothed(4, domain, top) if domain and any(tables[4][domain, j] for j in range(len(names))) else top
        prior = smoothed(3, host, prior)
        logs = []
        for j in range(len(names)):
            x = ll[j] + math.log(prior[j])
            for k, c in ((5, declared), (6, suffix)):
                if c >= 0:
                    column = sum(tables[k][d, j] for d in range(len(names) + 1))
                    x += math.log((tables[k][c, j] - own[j] + 1) / (column - own[j] + len(names) + 1))
            logs.append(x)
        posterior = 1 / sum(math.exp(x - max(logs)) for x in logs)
        out[i] = (names[logs.index(max(logs))], posterior, posterior >= 0.3 and (gain is None or gain >= 0))
    return out


def test_languages_of_all_documents_and_pages(spark, documents):
    model = defaultdict(Counter)
    for r in documents:
        if r.text is not None and r.lang is not None:
            model[r.lang].update(buckets(r.text))
    pages = []
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        text = re.sub(r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->|<[^>]*>", " ", r.html)
        attribute = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", r.html)
        meta = re.search(r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})\b", r.html)
        declared = (attribute or meta or [None, ""])[1].lower()
        host = (re.search(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", r.url) or [None, ""])[1].lower()
        pages.append((r.page_id, text, host, declared))
    want = {("documents", i): x for i, x in languages_by_hand(model, [(r.doc_id, r.text, r.source, None) for r in documents]).items()}
    want |= {("pages", i): x for i, x in languages_by_hand(model, pages).items()}
    got = {(r.collection, r.doc_id if r.collection == "documents" else r.page_id): r for r in queries.QUERIES["op5_language"](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for k, (language, posterior, kept) in want.items():
        assert (got[k].language, got[k].kept) == (language, kept) and math.isclose(got[k].posterior, posterior, rel_tol=1e-3, abs_tol=1e-6), (k, got[k], want[k])


# --- 7 ---


def test_lines_of_all_documents(spark, documents):
    got = linededup.dedup_lines(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    texts = {r.doc_id: r.text or "" for r in documents}
    assert left(r for r in got if r.text is not None) == {i: x for i, x in blocks_by_hand(texts).items() if next(r for r in documents if r.doc_id == i).text is not None}
    shas = queries.QUERIES["op7_line_dedup"](spark, SMALL).collect()
    assert {r.doc_id: r.n_removed for r in shas} == {r.doc_id: r.n_removed for r in got} and sum(r.n_removed for r in got) > 0


# --- 8 ---


def test_tokens_of_all_lines(spark, documents):
    codec, want = tiktoken_codec(), []
    for r in documents:
        text = r.text or ""
        at, raw = 0, text.encode()
        chars = list(itertools.accumulate((b & 0xC0 != 0x80 for b in raw), initial=0))
        spans = []
        for piece in map(codec.decode_single_token_bytes, codec.encode_ordinary(text)):
            spans.append((chars[at + 1] - 1, chars[at + len(piece)]))
            at += len(piece)
        starts = [m.span() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        held = Counter()
        crossing = Counter()
        ends = [e for _, e in starts]
        for a, b in spans:
            first = bisect_right(ends, a)
            last = first
            while ends[last] < b:
                last += 1
            held[first] += 1
            for n in range(first, last + 1) if last > first else ():
                crossing[n] += 1
        want += [(r.doc_id, n, s, e, held[n], crossing[n]) for n, (s, e) in enumerate(starts)]
    got = queries.QUERIES["op8_section_tokens"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in got) == sorted(want)


# --- pipeline ---


def test_pipeline_on_all_documents(spark, documents):
    import corpus_pipeline

    model = defaultdict(Counter)
    for r in documents:
        if r.text is not None and r.lang is not None:
            model[r.lang].update(buckets(r.text))
    kept = languages_by_hand(model, [(r.doc_id, r.text, r.source, None) for r in documents])
    texts = {r.doc_id: r.text for r in documents if kept[r.doc_id][2]}
    lines = blocks_by_hand(texts)
    words = {i: " ".join(x for y in lines[i] for x in y.split()) for i in texts}
    texts = {i: w for i, w in words.items() if w}
    group = groups_by_hand(list(texts.items()), percent=80)
    texts = {i: t for i, t in texts.items() if group[i][1] == i}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if (w := split(r.text)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    want = {i: t for i, t in texts.items() if not hit(split(t))}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.text for r in got}.keys() == want.keys()
    assert all(r.decodes for r in got) and len(got) == len(want) < len(documents)
    assert langid.TESTED == 60
