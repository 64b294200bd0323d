"""The rest imports and registers its queries without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/anchora", tmp_path / "anchora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    for pipeline in (True, False):
        if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        elif os.path.exists(tmp_path / "corpus_pipeline.py"):
            os.remove(tmp_path / "corpus_pipeline.py")
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'find_claims' in q, set(e.oracle_sql()) <= set(q), any(k.startswith('op1_') for k in q))"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
        assert int(said[0]) > 40 and said[1:] == ["True", "True", "False"]
