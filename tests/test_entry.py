import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LLM = importlib.util.find_spec("tessella.llm") is not None


def test_flagship_has_rows_and_a_stable_schema(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.dtypes == [("customer_nation", "string"), ("metric_value", "double")] and frame.count() == 2


def test_sql_names_are_query_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if LLM:
        assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}


def test_the_rest_works_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; e.oracle_sql()"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr


def test_nothing_else_imports_the_llm_package():
    for path in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tessella.llm" not in path.read_text(encoding="utf-8"), path
