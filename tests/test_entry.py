"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("fieldrail.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(sorted(n for n in e.queries() if n.startswith("op") and n[2:3].isdigit() or n == "pipeline"), "ledger_summary" in e.queries(), set(e.oracle_sql()) <= set(e.queries()))
"""


def test_without_the_subpackage():
    out = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "[] True True", out.stderr[-500:]


def test_every_sql_has_a_query(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["operation", "calls", "cost_usd", "latency_ms", "pages", "cost_per_page_usd"] and out.count() > 1
