"""The driver's contract, with the corpus subpackage and without it."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["data_source", "test_score", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the entry still imports and has the other queries."""
    for part in ("tidemill", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tidemill" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and 'pipeline' not in q and not [n for n in q if n.startswith('op')], len(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
