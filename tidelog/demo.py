"""The calls that a demo of the store offers, as functions; what serves them is left to the caller."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import SparkSession

from tidelog.engine import Store, WriteBatch
from tidelog.functions import size_class_of
from tidelog.schema import Options

#: Keys and bytes of values that a step of the comparison writes.
STEP_KEYS, STEP_VALUE = 64, 32


class Demo:
    """One store, which can be looked at, changed, reset and opened again, and a comparison of both compaction policies."""

    def __init__(self, spark: SparkSession, folder: str, options: Options = Options()):
        self.spark, self.folder, self.options = spark, Path(folder), options
        self.compared: dict[str, Store] = {}
        self.store = self._open("store", options)

    def _open(self, name: str, options: Options) -> Store:
        return Store(self.spark, str(self.folder / name), options)

    def __enter__(self) -> Demo:
        return self

    def __exit__(self, *_) -> None:
        for s in (self.store, *self.compared.values()):
            s.close()

    def put(self, key: bytes, value: bytes) -> None:
        self.store.put(key, value)

    def get(self, key: bytes) -> bytes | None:
        return self.store.get(key)

    def delete(self, key: bytes) -> None:
        self.store.delete(key)

    def batch(self, entries: list[tuple[bytes, bytes | None]]) -> None:
        b = WriteBatch()
        for k, v in entries:
            b.delete(k) if v is None else b.put(k, v)
        self.store.write_batch(b)

    def flush(self) -> None:
        self.store.flush()

    def compact(self) -> None:
        self.store.compact()

    def reopen(self) -> None:
        self.store.close()
        self.store = self._open("store", self.options)

    def reset(self) -> None:
        """An empty store."""
        self.store.close()
        shutil.rmtree(self.folder / "store")
        self.store = self._open("store", self.options)

    def state(self) -> dict:
        """inspect() and the counters; of each run its size class too."""
        seen = self.store.inspect()
        tables = [{"id": r.run_id, "bytes": r.bytes, "records": r.records, "max_seq": r.max_seq, "tier": size_class_of(r.bytes)} for r in seen["tables"]]
        return {**seen, "tables": tables, "stats": self.store.activity_stats()}

    def table(self, run_id: int) -> list[dict]:
        """The first records of a run."""
        return [r.asDict() for r in self.store.inspect_table(run_id).collect()]  # PREVIEW_ROWS at most

    def compare_start(self) -> None:
        """Two empty stores that differ in their policy."""
        for s in self.compared.values():
            s.close()
        shutil.rmtree(self.folder / "compared", ignore_errors=True)
        self.compared = {style: self._open(f"compared/{style}", Options(compaction_style=style)) for style in ("full", "size_tiered")}
        self.step = 0

    def compare_step(self) -> dict:
        """The same writes and a flush in both; what each has written so far."""
        out: dict = {"step": self.step + 1}
        for style, s in self.compared.items():
            b = WriteBatch()
            for i in range(STEP_KEYS):
                b.put((self.step * STEP_KEYS // 2 + i).to_bytes(8, "big"), bytes([self.step % 256]) * STEP_VALUE)
            s.write_batch(b)
            s.flush()
            out[style] = {"runs": len(s.manifest.runs), "write_amplification": s.write_amplification(), **{k: s.activity_stats()[k] for k in ("compactions", "run_records", "run_bytes")}}
        self.step += 1
        return out


