"""The driver's entry points."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_the_other_tests_pass_without_the_corpus_operators(tmp_path):
    import os
    import shutil

    for name in ("gridloom", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    chosen = "grid_edges or quarters or every_sql"
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", chosen], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-2000:]


def test_files_and_trees_against_sql(spark):
    import duckdb

    from gridloom.plans import catalogue

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found, sql = catalogue.queries(), catalogue.oracle_sql()
    for name in ("file_metis", "file_octree", "file_pe_tree", "memory_sizes", "multisection_4", "quadtree_graph"):
        rows = found[name](spark, d)
        want = c.sql(sql[name])
        assert sorted(want.columns) == sorted(rows.columns)
        assert sorted(map(repr, (tuple(r[x] for x in want.columns) for r in rows.collect()))) == sorted(map(repr, want.fetchall())), name


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "gridloom").parts:
            assert "gridloom.llm" not in p.read_text()
