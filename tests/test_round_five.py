"""Findings of round 3 that were left: searches by blocks, clusters in a task, regions, frozen brands."""

import random

import pytest
from compare import rows
from test_round_four import differs

from lumenframe import plans
from lumenframe.plans import vectors

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["cosine_topk", "gallery_dual_gate"])
@pytest.mark.parametrize("of_a_block", [7, 20_000])
def test_vectors_without_values_come_last(spark, tmp_path, monkeypatch, name, of_a_block):
    monkeypatch.setattr(vectors, "GALLERY_ROWS", of_a_block)
    monkeypatch.setattr(vectors, "TASK_PAIRS", 2 * of_a_block)
    rng = random.Random(7)
    data = [(25 * i, [rng.uniform(-1, 1) for _ in range(64)], i % 5 if i % 7 else None) for i in range(50)]
    data[8] = (200, None, 3)  # a query without a vector
    data += [(1001 + i, None, 1) for i in range(4)]
    if name == "cosine_topk":  # which of equal exemplars a label has is open in the SQL
        data += [(2001 + i, data[i % 3][1], 2) for i in range(30)]
    ours, theirs = differs(spark, tmp_path, name, embeddings=(data, EMBEDDINGS))
    assert ours == theirs


def test_a_search_broadcasts_no_gallery_and_makes_no_row_of_a_pair(spark, small):
    for name in ("cosine_topk", "gallery_dual_gate"):
        plan = plans.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "CoGroup" in plan


@pytest.mark.parametrize("of_a_task, run", [(200_000, 50), (0, 50), (60, 20)])
def test_clusters_in_a_task_and_by_turns_are_alike(spark, monkeypatch, of_a_task, run):
    from test_masks import plain_kmeans

    from lumenframe.operators import clusters

    monkeypatch.setattr(clusters, "TASK_PIXELS", of_a_task)
    monkeypatch.setattr(clusters, "RUN", run)
    rng = random.Random(11)
    samples = [[(float(rng.randrange(100)), float(rng.randrange(-40, 40)), float(rng.randrange(-9, 9))) for _ in range(n)] for n in (1, 2, 49, 50, 74, 75, 120)] + [[(1.0, 2.0, 3.0)] * 80]
    px = spark.createDataFrame([(i, *p) for i, s in enumerate(samples) for p in s], "sample long, L double, a double, b double").repartition(3)
    got = {}
    for r in clusters.kmeans(px, "sample").collect():
        got.setdefault(r["sample"], {})[r.k] = (r.n, [round(x, 6) for x in (r.L, r.a, r.b)])
    assert got == {i: plain_kmeans(s) for i, s in enumerate(samples)}


def test_turns_of_small_samples_write_no_tables(spark, small, monkeypatch):
    from lumenframe.operators import clusters

    monkeypatch.setattr(clusters, "written", None)
    for name in ("lab_clusters", "robust_lab_vote"):
        assert plans.queries()[name](spark, small).count()


def test_formulas_of_regions_are_short(spark, small):
    plan = plans.queries()["body_regions"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 30_000 and "decimal" not in plan  # pasted into each other, they were too long to be compiled
