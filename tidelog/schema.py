"""Schemas, limits and options of the versioned key-value model.

A log has one row for each mutation: the key, a sequence number (unique, from 1
on, strictly increasing) and a value; a null value is a tombstone, an empty one
is a value. A run is a log with one row for each key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tidelog.errors import InvalidConfig

#: Fixed values of the model: bytes of a record's header, of a batch's envelope and of a memtable entry; the largest record and frame; the largest sequence number of a signed long.
RECORD_HEADER = 17
BATCH_ENVELOPE = 16
ENTRY_CHARGE = 48
MAX_RECORD = 32 << 20
MAX_FRAME = 64 << 20
MAX_SEQUENCE = (1 << 63) - 1

LOG = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("value", T.BinaryType(), True)])
LIVE = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
META = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType()),
    T.StructField("min_key", T.BinaryType()), T.StructField("max_key", T.BinaryType()), T.StructField("max_seq", T.LongType()),
])


@dataclass(frozen=True)
class Options:
    """What a store is opened with; checked by validate()."""

    memtable_size_limit: int = 4 << 20
    max_immutable_memtables: int = 2
    block_size: int = 16 << 10
    block_cache_capacity: int = 8 << 20
    bloom_filter_bits_per_key: int = 10
    compaction_style: str = "size_tiered"
    compaction_file_threshold: int = 4
    max_key_size: int = 1 << 20
    max_value_size: int = 16 << 20

    def validate(self) -> Options:
        rules = {
            "memtable_size_limit is positive": self.memtable_size_limit > 0,
            "max_immutable_memtables is positive": self.max_immutable_memtables > 0,
            "block_size is from 64 bytes to 32 MiB": 64 <= self.block_size <= MAX_RECORD,
            "block_cache_capacity is not negative": self.block_cache_capacity >= 0,
            "bloom_filter_bits_per_key is from 1 to 30": 1 <= self.bloom_filter_bits_per_key <= 30,
            "compaction_style is size_tiered or full": self.compaction_style in ("size_tiered", "full"),
            "compaction_file_threshold is 2 or more": self.compaction_file_threshold >= 2,
            "the sizes of key and value are not negative": self.max_key_size >= 0 and self.max_value_size >= 0,
            "a key and a value fit a record": self.max_key_size + self.max_value_size + RECORD_HEADER <= MAX_RECORD,
        }
        for rule, holds in rules.items():
            if not holds:
                raise InvalidConfig(rule)
        return self
