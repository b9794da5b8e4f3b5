import ast
import subprocess
import sys
from pathlib import Path

import pytest

from conftest import SMALL, same
from tidelog.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same(catalogue.QUERIES[name](spark, SMALL), duck.sql(catalogue.ORACLES[name]))


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_checksums_and_hashes(spark):
    import zlib

    from tidelog.functions import fnv1a

    for r, e in zip(catalogue.kv_crc32_frame(spark, SMALL).orderBy("event_id").collect(), spark.read.parquet(f"{SMALL}/events.parquet").orderBy("event_id").collect(), strict=True):
        assert r.payload_crc32 == zlib.crc32(e.props.encode())
        assert r.length_crc32 == zlib.crc32(len(e.props.encode()).to_bytes(4, "little"))
    for r in catalogue.kv_fnv_hash(spark, SMALL).limit(20).collect():
        kind = spark.read.parquet(f"{SMALL}/events.parquet").filter(f"event_id = {r.event_id}").first().event_type
        assert r.hash % 2**64 == fnv1a(kind.encode())


def test_nothing_imports_the_corpus_operators():
    for p in (ROOT / "tidelog").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p


def test_entry_works_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tidelog", tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(catalogue.QUERIES)
