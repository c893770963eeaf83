"""The driver's contract in fresh processes: no session at import, and no training-data folders at all."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print('NAMES', *sorted(q))"


def names(root: str) -> set[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return set(done.stdout.rpartition("NAMES")[2].split())


def test_loads_without_a_session():
    found = names(ROOT)
    assert "magnetic_signed_laplacian" in found
    if os.path.isdir(os.path.join(ROOT, "signet", "llm")):
        assert "pipeline" in found and all(any(x.startswith(f"op{n}_") for x in found) for n in range(1, 11))


def test_loads_without_the_training_data_folders(tmp_path):
    for name in ("signet", "__spark_entry__.py"):
        at = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(at) else {}))
    found = names(str(tmp_path))
    assert "magnetic_signed_laplacian" in found and "pipeline" not in found and not any(x.startswith("op") for x in found)
    assert subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode == 0
