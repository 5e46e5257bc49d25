import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_part(tmp_path):
    """With the optional subpackage away, the entry point still offers everything else."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for f in (ROOT / "threadloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            to = tmp_path / f.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr


def test_nothing_in_the_library_imports_it():
    for f in (ROOT / "threadloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f
