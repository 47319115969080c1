import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("left_out", [["packwright/llm"], ["packwright/llm", "corpus_pipeline.py"], ["packwright/llm/queries.py"]])
def test_entry_without_the_training_data_operators(tmp_path, left_out):
    """A copy of the repository without them has all other queries."""
    skipped = {os.path.join(ROOT, name) for name in left_out}
    for name in ("packwright", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if source in skipped or not os.path.exists(source):
            continue
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=lambda d, names: [n for n in names if os.path.join(d, n) in skipped])
        else:
            shutil.copy(source, target)
    run = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert "pack_chat" in run.stdout and "op1_" not in run.stdout and "pipeline" not in run.stdout
