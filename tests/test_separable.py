"""The library works without its optional part: a copy without those folders imports and still has all other queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_without_the_optional_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print('NAMES', *sorted(q))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    names = run.stdout.rpartition("NAMES")[2].split()
    import __spark_entry__ as entry

    assert sorted(names) == sorted(x for module in entry._PLANS for x in module.Q)
    assert not [x for x in names if x.startswith("op") or x == "pipeline"]
