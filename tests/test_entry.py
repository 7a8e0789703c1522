import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(q.startswith('op1_') for q in e.queries()))"


def said(folder):
    found = subprocess.run([sys.executable, "-c", SAY], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    return found.stdout.split()


def test_entry_without_the_training_data_parts(tmp_path):
    """The rest imports with the subpackage and the pipeline gone, together or one of them."""
    for k, gone in enumerate([["graphlens/llm"], ["corpus_pipeline.py"], ["graphlens/llm", "corpus_pipeline.py"]]):
        folder = tmp_path / str(k)
        os.mkdir(folder)
        shutil.copytree(f"{ROOT}/graphlens", folder / "graphlens", ignore=lambda d, names: [n for n in names if n == "__pycache__" or f"{os.path.relpath(d, ROOT)}/{n}" in gone])
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if name not in gone and os.path.exists(f"{ROOT}/{name}"):
                shutil.copy(f"{ROOT}/{name}", folder)
        n, n_sql, pipeline, ops = said(folder)
        assert int(n) > 90 and int(n_sql) > 90 and pipeline == "False"
        assert ops == "False" or "graphlens/llm" not in gone
