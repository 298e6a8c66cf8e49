"""The driver's contract, with and without the numbered operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    found = e.entry(spark)
    assert found.count() == 8 and "similarity" in found.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_numbered_operators(tmp_path):
    """A copy without them imports and registers the rest; a copy with one that cannot be imported does not hide it."""
    copy = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "tarn"), copy / "tarn", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy / name)
    env = {**os.environ, "PYTHONPATH": ""}
    if (copy / "corpus_pipeline.py").exists():
        (copy / "corpus_pipeline.py").write_text("import no_such_module")
        assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=env, capture_output=True).returncode != 0
        (copy / "corpus_pipeline.py").unlink()
    shutil.rmtree(copy / "tarn" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e\nassert 'vec_cosine_topk' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\n"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env).returncode == 0
