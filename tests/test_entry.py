import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout


def test_without_the_optional_subpackage():
    code = "import sys; sys.modules['weftgraph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n[:2] == 'op' and n[2].isdigit() for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    n, some, subset = run(code).split()
    assert int(n) > 70 and some == "False" and subset == "True"


def test_nothing_else_imports_it():
    code = "import sys, pkgutil, importlib, weftgraph; [importlib.import_module(m.name) for m in pkgutil.walk_packages(weftgraph.__path__, 'weftgraph.') if not m.name.startswith('weftgraph.llm')]; print(any(m.startswith('weftgraph.llm.') for m in sys.modules))"
    assert run(code).strip() == "False"


def test_flagship(spark):
    from weftgraph.plans import catalogue

    assert catalogue.flagship(spark, "/root/testdata/sf0.001").columns == ["c", "n", "x"]
