"""The driver's entry module with and without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tallyworks.catalog import registered

ROOT = Path(__file__).resolve().parent.parent

COUNT = """
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
print(len(names), len(sql - names), sum(n.startswith("op") or n == "pipeline" for n in names))
"""


def counted(folder) -> list[int]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True)
    return [int(n) for n in done.stdout.split()]


@pytest.mark.parametrize("pipeline", [True, False])
def test_all_other_queries_stay_without_the_package(tmp_path, pipeline):
    shutil.copytree(ROOT / "tallyworks", tmp_path / "tallyworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    assert counted(tmp_path) == [len(registered()[0]), 0, 0]


def test_flagship_query_needs_no_package(tmp_path, spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["cohort_month", "buyers", "month_offset", "active_buyers", "retention"]
