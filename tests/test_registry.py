"""Every registered query has a stable schema and agrees with its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "bm25_topk" in names


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_core_queries_agree_with_sql(spark):
    import verify
    from blattwerk.plans import core

    assert verify.compare(spark, FOLDER, sorted(core.oracle_sql())) == 0
    assert entry.entry(spark).count() > 0
