"""The entry module with and without the llm subpackage and the pipeline."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    env = os.environ | {"PYTHONPATH": root}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_imports_without_llm(tmp_path):
    (tmp_path / "foliant").mkdir()
    os.symlink(f"{ROOT}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    for p in os.listdir(f"{ROOT}/foliant"):
        if p not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/foliant/{p}", tmp_path / "foliant" / p)
    found = names(str(tmp_path))
    assert "e01_keyword_search" in found
    assert "pipeline" not in found
    assert not any(x.startswith("op") for x in found)


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
