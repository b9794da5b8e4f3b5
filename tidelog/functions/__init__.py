"""Column and scalar functions of the key-value model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import BATCH_ENVELOPE, ENTRY_CHARGE, RECORD_HEADER


def ordered_key(number: Column) -> Column:
    """A non-negative long as 8 big-endian bytes, whose byte order is the numbers'."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def size_class(size: Column) -> Column:
    """The integer logarithm to base 2 of a size, 1 at least. Counted in digits: a logarithm of doubles is one too high just below 2 ** 48."""
    return (F.length(F.bin(F.greatest(size.cast("long"), F.lit(1)))) - 1).cast("int")


def size_class_of(size: int) -> int:
    return max(size, 1).bit_length() - 1


def length_or_zero(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def logical_bytes(key: Column, value: Column) -> Column:
    """Key and value of a put, the key alone of a deletion."""
    return length_or_zero(key) + length_or_zero(value)


def record_bytes(key: Column, value: Column) -> Column:
    return logical_bytes(key, value) + RECORD_HEADER


def batch_bytes(records: Column) -> Column:
    """Of a sum of record_bytes()."""
    return records + BATCH_ENVELOPE


def entry_charge(key: Column, value: Column) -> Column:
    """What an entry counts towards the memtable's limit."""
    return logical_bytes(key, value) + ENTRY_CHARGE


def frame_checksums(payload: Column) -> list[Column]:
    """Of a frame: the checksum of its length and of its payload."""
    length = F.octet_length(payload)
    little = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(length, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(4)])
    return [F.crc32(little).alias("length_crc32"), F.crc32(payload).alias("payload_crc32")]


def nearest_rank(count: Column, percent: Column | int) -> Column:
    """The place from 0 of a percentile in ascending order: (count - 1) * percent div 100."""
    return F.call_function("div", (count - 1) * percent, F.lit(100).cast("long"))


# --- Bloom filter arithmetic ----------------------------------------------

#: Fixed values of the filters: least and most bytes; probes for a bit of each key, and most of them.
LEAST_FILTER, MOST_FILTER, PROBES_PER_BIT, MOST_PROBES = 8, 8 << 20, 0.69, 20


def bloom_bytes(keys: Column, bits_per_key: int) -> Column:
    """Bytes of a filter: bits over 8, rounded up, within the bounds."""
    wanted = F.call_function("div", keys * bits_per_key + 7, F.lit(8).cast("long"))
    return F.least(F.greatest(wanted, F.lit(LEAST_FILTER).cast("long")), F.lit(MOST_FILTER).cast("long"))


def bloom_probes(bits_per_key: int) -> int:
    return min(MOST_PROBES, max(1, int(PROBES_PER_BIT * bits_per_key)))


#: Offset basis and prime of the public FNV-1a hash (64 bits), and the factor of the public murmur3 finaliser.
FNV_OFFSET, FNV_PRIME, FINAL = 0xCBF29CE484222325, 0x100000001B3, 0xFF51AFD7ED558CCD


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def bloom_hash(data: bytes) -> int:
    """What a Bloom filter uses: FNV-1a, whose high bits are then mixed into the low ones."""
    h = fnv1a(data)
    h = (h ^ h >> 33) * FINAL & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 33


def _fnv(keys: pd.Series) -> np.ndarray:
    present = keys.map(lambda k: bytes(k) if k is not None else b"")
    lengths = present.map(len).to_numpy()
    out = np.full(len(present), FNV_OFFSET, np.uint64)
    data = np.frombuffer(b"".join(present), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else lengths
    with np.errstate(over="ignore"):
        for i in range(int(lengths.max()) if len(lengths) else 0):
            on = lengths > i
            out[on] = (out[on] ^ data[starts[on] + i]) * np.uint64(FNV_PRIME)
    return out


@F.pandas_udf(T.LongType())
def fnv1a_hash(keys: pd.Series) -> pd.Series:
    """FNV-1a of binary keys, as a signed long: multiplication that wraps is an error in ANSI SQL, so this is Arrow-batched Python."""
    return pd.Series(_fnv(keys).view(np.int64))


@F.pandas_udf(T.LongType())
def bloom_hashes(keys: pd.Series) -> pd.Series:
    """bloom_hash() of binary keys, as a signed long."""
    h = _fnv(keys)
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(33)) * np.uint64(FINAL)
    return pd.Series((h ^ h >> np.uint64(33)).view(np.int64))


class XorShift:
    """The public xorshift64 generator with shifts 13, 7 and 17."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFFFFFFFFFF or 1

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= x << 17 & 0xFFFFFFFFFFFFFFFF
        self.state = x
        return x

    def below(self, n: int) -> int:
        return self.next() % n
