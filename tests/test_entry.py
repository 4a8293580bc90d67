"""The driver's contract holds without what only the llm subpackage needs."""

import subprocess
import sys
from pathlib import Path

HIDDEN = """
import sys
sys.modules["regex"] = None
import __spark_entry__ as e
names = set(e.queries())
assert {"tpch_q1", "p1_features", "p2_found", "p4_found"} <= names and set(e.oracle_sql()) <= names
assert not {"p3_found", "p6_ids"} & names
"""


def test_core_queries_without_the_subpackage():
    subprocess.run([sys.executable, "-c", HIDDEN], cwd=Path(__file__).resolve().parent.parent, check=True)
