"""The entry file in a copy of the repository that has no llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_folders(tmp_path):
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py")
    for name, pipeline in (("neither", False), ("pipeline_left", True)):
        copy = tmp_path / name
        shutil.copytree(ROOT, copy, ignore=gone)
        if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/corpus_pipeline.py", copy)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not [x for x in q if x.startswith('op')] and set(o) <= set(q); print(len(q))"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(copy)})
        assert done.returncode == 0 and int(done.stdout) > 50, done.stderr
