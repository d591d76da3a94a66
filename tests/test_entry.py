"""The driver contract, and independence from the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_llm_folder(tmp_path):
    """A copy of the repository without cadenza/llm still imports, with corpus_pipeline.py and without."""
    import shutil

    shutil.copytree(f"{ROOT}/cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'work_index' in q and 'pipeline' not in q and not any(x.startswith('op1_') for x in q); e.oracle_sql()"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
        if os.path.exists(f"{ROOT}/corpus_pipeline.py"):  # it may be gone along with the folders
            shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)


def test_imports_without_a_package_that_llm_needs(tmp_path):
    (tmp_path / "xxhash.py").write_text("raise ImportError('absent')")
    code = "import __spark_entry__ as e; assert 'work_index' in e.queries() and not any(x.startswith('op1_') for x in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}, timeout=120)


def test_nothing_else_imports_llm():
    for top, _, names in os.walk(f"{ROOT}/cadenza"):
        if "/llm" in top:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{top}/{n}", encoding="utf-8") as f:
                    assert "cadenza.llm" not in f.read().replace('"""', "")
