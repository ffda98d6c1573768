import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, cwd=ROOT):
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})


def test_the_rest_stands_without_the_llm_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/evidelta", tmp_path / "evidelta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    out = run("import __spark_entry__ as e; print('p4_found' in e.queries(), 'p6_ids' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))", tmp_path)
    assert out.stdout.split() == ["True", "False", "True"], out.stderr


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/evidelta/llm"), reason="without the llm subpackage")
def test_a_missing_package_is_an_error():
    out = run("import sys; sys.modules['regex'] = None; import __spark_entry__")
    assert out.returncode != 0 and "regex" in out.stderr
