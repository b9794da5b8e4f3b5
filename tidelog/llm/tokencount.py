"""Token counts of sections: whole documents are encoded once, and the tokens' character spans are joined to the sections.

A text's tokens are in order, so the interval join is two binary searches a
section. A token that crosses a section's border goes by an explicit rule:
"first" (to sections that hold its first character), "last" (its last), "most"
(the one section that holds most of its characters, the earlier one in a tie).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import bpe, common

common.ship(__name__)

RULES = ("first", "last", "most")


def line_sections(text: str) -> np.ndarray:
    """(start, end) of each line with its line feed; an empty text has none."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    if len(text) and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], 1) if len(ends) else np.zeros((0, 2), np.int64)


def _ranges(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of each range [lo, hi), and what the range is of."""
    size = np.maximum(0, hi - lo)
    return np.repeat(of, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def allot(first: np.ndarray, last: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many tokens cross a border of it. Token i touches characters [first, last)."""
    lo, hi = sections[:, 0], sections[:, 1]
    touch_lo, touch_hi = np.searchsorted(last, lo, "right"), np.searchsorted(first, hi, "left")
    in_lo, in_hi = np.searchsorted(first, lo, "left"), np.searchsorted(last, hi, "right")
    full = hi > lo
    crossing = np.where(full, np.maximum(0, touch_hi - touch_lo) - np.maximum(0, in_hi - in_lo), 0)
    if rule == "first":
        counts = np.where(full, touch_hi - in_lo, 0)
    elif rule == "last":
        counts = np.where(full, in_hi - touch_lo, 0)
    elif rule == "most":
        counts = np.where(full, np.maximum(0, in_hi - in_lo), 0)
        held = np.flatnonzero(counts)
        inside = np.zeros(len(first) + 1, np.int64)
        np.add.at(inside, in_lo[held], 1)
        np.add.at(inside, in_hi[held], -1)
        over = np.flatnonzero(crossing)
        pairs = [_ranges(over, touch_lo[over], np.minimum(in_lo, touch_hi)[over]), _ranges(over, np.maximum(in_hi, touch_lo)[over], touch_hi[over])]
        s, t = (np.concatenate(x) for x in zip(*pairs, strict=True))
        some = np.cumsum(inside)[t] == 0
        s, t = s[some], t[some]
        shared = np.minimum(hi[s], last[t]) - np.maximum(lo[s], first[t])
        order = np.lexsort((s, -shared, t))
        order = order[shared[order] > 0]
        best = order[np.concatenate([[True], t[order][1:] != t[order][:-1]])] if len(order) else order
        counts = counts + np.bincount(s[best], minlength=len(counts))
    else:
        raise ValueError(f"rule is one of {RULES}")
    return np.maximum(0, counts), crossing


def section_tokens(df: DataFrame, text: str = "text", sections: str | None = None, *, rule: str = "first", ranks: str | None = None, merges: str | None = None, pattern: str | None = None) -> DataFrame:
    """df without the text and the sections, and: section (from 0), start, end, n_tokens, n_crossing; a row for each section.

    sections names a column array<struct<start:int, end:int>> of characters;
    without it each line with its line feed is a section. Sections may leave
    gaps or overlap: under "first" and "last" a token counts in each that holds
    the character; under "most" in each that it lies in, or else in the first of
    those that hold most of it. Null and empty texts, and null or empty section lists, give no
    rows; a null section counts as empty. Columns of df with these names are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    added = [T.StructField("section", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType())]
    common.prepare(df.sparkSession)
    drop = {f.name for f in added} | {text} | ({sections} if sections else set())
    keep = [c for c in df.columns if c not in drop]
    given = df.select(*keep, F.col(text), *([F.col(sections)] if sections else []))
    schema = T.StructType([*(f for f in df.schema.fields if f.name in keep), *added])
    n = len(keep)

    def run(batches):
        c = bpe.codec(ranks, merges, pattern)
        for batch in batches:
            texts = batch.column(n).to_pylist()
            lists = batch.column(n + 1).to_pylist() if sections else [None] * len(texts)
            rows, parts = [], []
            for i, (t, own) in enumerate(zip(texts, lists, strict=True)):
                if not t:
                    continue
                s = line_sections(t) if not sections else np.array([(x["start"] or 0, x["end"] or 0) if x else (0, 0) for x in own or []], np.int64).reshape(-1, 2)
                if len(s):
                    first, last = bpe.char_spans(t.encode(), c.byte_ends(c.encode(t)))
                    parts.append(np.stack([np.arange(len(s)), s[:, 0], s[:, 1], *allot(first, last, s, rule)], 1))
                    rows += [i] * len(s)
            new = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(x.take(take) for x in batch.columns[:n]), *(pa.array(new[:, k].astype(np.int32 if k < 3 else np.int64)) for k in range(5))], names=[f.name for f in schema.fields])

    return given.mapInArrow(run, schema)


def op8_section_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document."""
    return section_tokens(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
