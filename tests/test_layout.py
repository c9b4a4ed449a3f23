"""The optional subpackage stays optional."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_optional_subpackage():
    for d, _, names in os.walk(os.path.join(ROOT, "quillgraph")):
        if os.path.basename(d) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(d, n)) as f:
                    assert not re.search(r"^\s*(from|import)\s+\S*llm", f.read(), re.M), n


def test_entry_imports_without_it(tmp_path):
    subprocess.run(["cp", "-r", os.path.join(ROOT, "quillgraph"), os.path.join(ROOT, "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quillgraph" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) > 100
