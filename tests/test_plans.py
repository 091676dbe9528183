"""Registered queries against their SQL on the smallest tables, and shapes of the physical plans."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from scholarmesh.operators import retrieval as R
from scholarmesh.plans import bindings as B

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUICK = ["bm25_topk", "knn_exact", "score_persons", "fold", "tokenize", "filter_calls", "order_calls_page", "snapshot_diff",
         "multiset_diff", "new_announcements", "merge_extension_dates", "pack_lines", "registry_sections", "clean_dates",
         "chat_context", "extract_records"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    mine = [tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    theirs = [tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_retrieval_plans(spark):
    c, v, q = B.chunks(spark, SF), B.vectors(spark, SF), B.queries(spark, SF)
    for df in (R.bm25_topk(c, q), R.knn_exact(v, q)):
        plan = _plan(df)
        assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_all_queries_are_registered_with_plain_names():
    names = set(queries())
    assert len(names) > 110 and set(oracle_sql()) <= names
