"""Every registered query against its SQL, on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from check_gate import compare, duck
from conftest import ROOT

from factloom.plans import load

SMALL = "/root/testdata/sf0.001"
REG = load()


@pytest.fixture(scope="module")
def outcomes(spark):
    """What each query gave, several running at once."""
    con = duck(SMALL)

    def check(name):
        try:
            df = REG.QUERIES[name](spark, SMALL)
            if name in REG.ORACLES:
                return compare(df, con.cursor(), REG.ORACLES[name])
            return None if df.take(1) else "no rows"
        except Exception as exc:  # shown by the query's own test
            return repr(exc)[:2000]
    names = sorted(REG.QUERIES)
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(names, pool.map(check, names)))


@pytest.mark.parametrize("name", sorted(REG.QUERIES))
def test_query_agrees(outcomes, name):
    assert outcomes[name] is None


def test_entry_and_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_without_the_training_data_operators(tmp_path):
    """A copy in which both folders are gone still has all other queries, and no pipeline."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), [n for n in q if n.startswith('op1') or n == 'pipeline'])"],
                           cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert found.stdout.split(maxsplit=1) == [str(len(REG.QUERIES)), "True []\n"]
