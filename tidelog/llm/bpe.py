"""Byte-level BPE encoding and decoding over Arrow batches.

A text is split by the public pattern; every distinct piece is encoded once per
worker by the tokenizers library and its ids are kept (the table of kept pieces
is emptied when full, which costs time and changes nothing). A text's ids are
the pieces' ids in a row. Decoding reverses the byte table of byte-level BPE.
"""

from __future__ import annotations

import base64
import os
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

common.ship(__name__)

RANKS, MERGES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Pieces kept by a worker, and characters of the longest that are kept.
KEPT_PIECES, KEPT_CHARS = 200_000, 64
#: Texts beyond so many characters are split piecewise, so that their pieces never are all in memory.
LONG = 2_000_000


def byte_table() -> dict[str, int]:
    """Byte-level BPE's characters and the bytes that they stand for: printable bytes stand for themselves, the others for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes texts to ids and ids to bytes with one vocabulary."""

    def __init__(self, ranks: str | None = None, merges: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(merges or public_tokenizers.path(MERGES))
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = byte_table()
        special = {str(t) for t in self.tokenizer.get_added_tokens_decoder().values()} | {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.token_bytes = {i: bytes(back[c] for c in token) for token, i in self.tokenizer.get_vocab().items() if token not in special}
        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            given = {int(i): base64.b64decode(token) for token, i in map(bytes.split, f)}
        if given != self.token_bytes:
            raise ValueError("the ranks and the merges are of different vocabularies")
        self.lengths = np.array([len(given[i]) for i in range(len(given))], np.int64)
        self.split = regex.compile(pattern or public_tokenizers.PATTERN)
        self.kept: dict[str, bytes] = {}

    def _pieces(self, text: str):
        if len(text) <= LONG:
            yield self.split.findall(text)
        else:
            found = (m.group() for m in self.split.finditer(text))
            while part := list(islice(found, 200_000)):
                yield part

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for pieces in self._pieces(text):
            kept = self.kept
            if missing := set(pieces).difference(kept):
                if len(kept) + len(missing) > KEPT_PIECES:
                    kept.clear()
                    missing = set(pieces)
                missing = list(missing)
                new = dict(zip(missing, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)), strict=True))
                kept.update((p, ids) for p, ids in new.items() if len(p) <= KEPT_CHARS)
                if any(len(p) > KEPT_CHARS for p in new):
                    out.append(b"".join([kept[p] if p in kept else new[p] for p in pieces]))
                    continue
            out.append(b"".join(map(kept.__getitem__, pieces)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens; a character may be split over tokens, so text is made of all bytes only."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def byte_ends(self, ids: bytes) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])


def char_spans(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters [start, end) that each token touches; tokens that share a split character both have it."""
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # characters begun before each byte
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    first = before[np.minimum(starts + 1, len(text))] - 1
    return first, before[ends]


def codec(ranks: str | None, merges: str | None, pattern: str | None) -> Codec:
    cache, key = common.worker_cache(), ("codec", ranks, merges, pattern)
    if key not in cache:
        common.make_room()
        cache[key] = Codec(ranks, merges, pattern)
        common.trim()  # what the files were read into
    return cache[key]


def encode(df: DataFrame, text: str = "text", *, ranks: str | None = None, merges: str | None = None, pattern: str | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """df and: n_tokens, token_ids (binary: little-endian unsigned 32-bit ids).

    offsets adds token_starts and token_ends (array<int>, characters of the
    text); decoded adds decoded_bytes, decoded from the ids. Null counts as an
    empty text, which has no tokens. Columns of df with these names are replaced.
    The paths and the pattern are parameters; nothing is copied.
    """
    spark = df.sparkSession
    common.prepare(spark)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    if offsets:
        added += [T.StructField("token_starts", T.ArrayType(T.IntegerType())), T.StructField("token_ends", T.ArrayType(T.IntegerType()))]
    if decoded:
        added += [T.StructField("decoded_bytes", T.BinaryType())]
    df = df.drop(*(f.name for f in added if f.name != text))
    schema = T.StructType([*df.schema.fields, *added])
    at = df.columns.index(text)

    def run(batches):
        c = codec(ranks, merges, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = [c.encode(t) for t in texts]
            new = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if offsets:
                spans = [char_spans(t.encode(), c.byte_ends(i)) for t, i in zip(texts, ids, strict=True)]
                new += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            if decoded:
                new.append(pa.array([c.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in schema.fields])
        common.trim()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "token_ids", *, ranks: str | None = None, merges: str | None = None) -> DataFrame:
    """df and: decoded_bytes (binary) and decoded_text (null where the bytes are not UTF-8, as with half a character)."""
    df = df.drop("decoded_bytes", "decoded_text")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded_bytes", T.BinaryType()), T.StructField("decoded_text", T.StringType())])
    common.prepare(df.sparkSession)
    at = df.columns.index(ids)

    def text_of(b: bytes):
        try:
            return b.decode()
        except UnicodeDecodeError:
            return None

    def run(batches):
        c = codec(ranks, merges, None)
        for batch in batches:
            out = [c.decode(i or b"") for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(map(text_of, out), pa.string())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded, as digests."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded=True).select(
        "doc_id", "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded_bytes", 256).alias("decoded_sha256"),
    )
