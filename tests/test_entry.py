"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_the_rest_stands_alone():
    code = "import sys; sys.modules['tamarack.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n[:2] in ('p1', 'p8')]; print('fine')"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0])
    assert out.stdout.strip() == "fine", out.stderr
