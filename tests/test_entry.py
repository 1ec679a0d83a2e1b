import subprocess
import sys

ROOT = __file__.rsplit("/", 2)[0]


def test_entry_imports_without_the_training_data_subpackage(tmp_path):
    script = f"""
import os, shutil, sys
shutil.copytree({ROOT!r}, {str(tmp_path / 'r')!r}, ignore=shutil.ignore_patterns('.git', 'llm', 'corpus_pipeline.py', '__pycache__'))
os.chdir({str(tmp_path / 'r')!r}); sys.path.insert(0, '.')
import __spark_entry__ as e
assert 'coupling_strength' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=tmp_path)


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150
