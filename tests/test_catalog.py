"""Every query with SQL against a second engine, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from docketry.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value.isoformat() if isinstance(value, datetime.date) else value


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, other, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    result = other.execute(catalog.SQL[name])
    names = sorted(df.columns)
    assert sorted(d[0] for d in result.description) == names
    at = [[d[0] for d in result.description].index(n) for n in names]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == expected and got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 232
    assert set(catalog.SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_subpackage():
    """The entry module works where the optional parts are gone, and only then hides an import error."""
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {names}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len([q for q in e.queries() if q[:2] == 'op' and q[2].isdigit()]), len(e.queries()) > 50)
"""
    run = lambda names: subprocess.run([sys.executable, "-c", code.replace("{names}", repr(names))], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for names in (("corpus_pipeline", "docketry.llm"), ("docketry.llm",), ("corpus_pipeline",)):
        assert run(names).stdout.split() == ["0", "True"]
    assert run(("docketry.plans.oracle",)).returncode
