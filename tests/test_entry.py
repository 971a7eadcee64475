import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry_and_pairs_of_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "quillspark"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    target = tmp_path / "quillspark"
    target.mkdir()
    for p in (REPO / "quillspark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (target / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, check=True)
