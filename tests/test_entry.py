"""The entry with and without the optional packages."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("gone", [[], ["corpus_pipeline.py"], ["adfacts/llm"], ["adfacts/llm", "corpus_pipeline.py"]])
def test_import_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    # Left out rather than deleted; a folder of caches alone may stay behind.
    skipped = {str(ROOT / name) for name in gone}
    shutil.copytree(
        ROOT, copy,
        ignore=lambda folder, names: [
            n for n in names
            if f"{folder}/{n}" in skipped or n in (".git", "tests", "__pycache__") or n.endswith(".json")
        ],
    )
    if "adfacts/llm" in gone:
        (copy / "adfacts/llm/__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, checks, pipeline = said.stdout.split()
    if "adfacts/llm" in gone:
        assert n == checks and pipeline == "False" and int(n) >= 115
    else:
        assert int(n) > int(checks) and pipeline == str("corpus_pipeline.py" not in gone)
