"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from tidewheel.plans import flows, objects  # noqa: F401
from tidewheel.plans import queries as P

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x


def rows_of(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(P.QUERIES))
def test_query(spark, small, duck, name):
    got = P.QUERIES[name](spark, small).toPandas()
    if name not in P.SQL:
        assert len(got)
        return
    want = duck.sql(P.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(tmp_path):
    """The entry imports, and has the queue's queries, where the llm folders aren't there."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['tidewheel.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) == len(P.QUERIES)
