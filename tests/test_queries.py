"""Registered queries against their DuckDB statements on the smallest tables, and the driver contract."""

import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from normscope.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_oracle(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    want = duck.sql(oracle.ORACLES[name])
    assert sorted(want.columns) == columns
    expected = sorted(([plain(v) for v in r] for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-4 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('normscope.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 40 and not any(q.startswith('op') for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(entry.__file__).parent))
