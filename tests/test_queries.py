"""Every registered engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quern import queries, store_queries  # noqa: F401  both register theirs
from quern.registry import QUERIES, SQL

#: Each takes many rounds; the driver runs them all at a larger size.
SLOW = {"dl_cycle", "dl_cycle_with_nulls", "dl_ancestor_naive"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, v if v is not None else 0) for v in r])
    assert order(tuple(r[c] for c in columns) for r in got.collect()) == order(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("absent", ["zstandard", "tiktoken", "xxhash", "public_tokenizers", "quern.llm"])
def test_entry_works_without_what_the_subpackage_needs(absent):
    import subprocess
    import sys
    from pathlib import Path

    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(*e.queries()); print(len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True).stdout.splitlines()
    assert set(QUERIES) <= set(said[-2].split()) and int(said[-1]) >= len(SQL)
