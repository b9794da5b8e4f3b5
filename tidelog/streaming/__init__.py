"""Streaming ingest of a log (an extension: the model has no clock, order is the sequence number alone)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.engine import Store, WriteBatch


def newest(stream: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """The newest version of each key so far (update mode). Late rows need no watermark: the number decides; the state has a row for each key."""
    return stream.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def to_store(stream: DataFrame, store: Store, checkpoint: str, rows: int = 10_000) -> StreamingQuery:
    """Writes (key, value, seq) to a store, each micro-batch in order of seq in batches of rows; a batch that is repeated after a failure writes the same values."""
    def write(batch: DataFrame, _: int) -> None:
        pending = WriteBatch()
        for r in batch.orderBy("seq").toLocalIterator():
            pending.delete(r.key) if r.value is None else pending.put(r.key, r.value)
            if len(pending) >= rows:
                store.write_batch(pending)
                pending = WriteBatch()
        store.write_batch(pending)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
