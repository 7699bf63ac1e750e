"""The driver's contract, with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_parts(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", ".git", "inkwell"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "inkwell").mkdir()
    for p in (ROOT / "inkwell").iterdir():
        if p.name != "llm":
            (tmp_path / "inkwell" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0
