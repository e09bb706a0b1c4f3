"""The driver's contract with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), len(e.oracle_sql()) <= len(q))"


def told(*broken: str) -> list[str]:
    block = "".join(f"import sys; sys.modules[{name!r}] = None; " for name in broken)
    return subprocess.run([sys.executable, "-c", block + COUNT], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_queries_without_the_optional_operators():
    for broken in ("quillspan.llm", "quillspan.llm.queries", "corpus_pipeline", "regex"):
        number, optional, sound = told(broken)
        assert int(number) > 80 and optional == "0" and sound == "True", broken
