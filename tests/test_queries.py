"""Every registered query with SQL gives the rows of that SQL."""

import pytest
from compare import rows

from lumenframe import plans
from lumenframe.plans import vectors


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, oracle, small, name):
    ours = plans.queries()[name](spark, small).toPandas()
    theirs = oracle.execute(plans.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, small, name):
    assert plans.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cosine_topk", "gallery_dual_gate"])
def test_gallery_above_the_bound(spark, oracle, small, name, monkeypatch):
    monkeypatch.setattr(vectors, "GALLERY_ROWS", 60)
    monkeypatch.setattr(vectors, "TASK_PAIRS", 500)
    assert rows(plans.queries()[name](spark, small).toPandas()) == rows(oracle.execute(plans.oracle_sql()[name]).df())
