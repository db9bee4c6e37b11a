"""Every registered query of the library against its SQL on an independent engine."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

from quarry import queries  # noqa: E402


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return repr(round(float(value), 6)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, oracle, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted([[plain(r[c]) for c in columns] for r in df.collect()], key=str)
    if name in queries.SQL:
        found = oracle.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
        assert got == sorted([[plain(v) for v in r] for r in found], key=str)
    else:
        assert got


def test_scan_prunes_columns_and_scores_once(spark):
    plan = queries.min_score_filter(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    plan = queries.topk_global(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "WindowGroupLimit" in plan
