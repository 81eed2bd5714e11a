"""Findings of round 3: rows on the edge of a limit or of a rounding, and operators that go over the data fewer times."""

from datetime import datetime

import duckdb
import pytest
from compare import rows

from lumenframe import plans


def differs(spark, folder, name, **tables):
    """Rows of a query and of its SQL over small tables of our own."""
    con = duckdb.connect()
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return rows(plans.queries()[name](spark, str(folder)).toPandas()), rows(con.execute(plans.oracle_sql()[name]).df())


LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_box_on_the_limit_of_movement_matches(spark, tmp_path):
    data = [(459485, 67160, 3580, 1, 21.0), (459485, 77005, 3719, 1, 33.0), (459485, 60100, 3470, 5, 45.0)]
    ours, theirs = differs(spark, tmp_path, "box_metrics", lineitem=(data, LINEITEM))
    assert ours == theirs


def test_share_just_below_a_half_is_rounded_down(spark, tmp_path):
    data = [(479, 51, "signup", 0.99), (843, 63, "signup", 9.15), (3565, 70, "purchase", 2.84), (3760, 81, "click", 13.93)]
    data = [(i, datetime(2024, 1, 1, 3, 0, s - 50), 1345, kind, value, "{}") for i, s, kind, value in data]
    ours, theirs = differs(spark, tmp_path, "rolling_weighted_vote", events=(data, EVENTS))
    assert ours == theirs


@pytest.mark.parametrize("first", [("b", "a"), ("a", "b")])
def test_sums_alike_to_nine_places_are_ties(spark, tmp_path, first):
    # 0.1 + 0.2 and 0.3: the same share, though the sums differ in the last bit
    values = [(40, first[0], 10.0), (80, first[0], 20.0), (120, first[1], 30.0)]
    data = [(i, datetime(2024, 1, 1, 0, 0, k), 1, kind, value, "{}") for k, (i, kind, value) in enumerate(values)]
    ours, theirs = differs(spark, tmp_path, "rolling_weighted_vote", events=(data, EVENTS))
    assert ours == theirs


def test_tracker_takes_plain_boxes():
    import numpy as np

    from lumenframe.streaming.tracker import Tracker

    plain, arrays = Tracker(), Tracker()
    for frame in range(40):
        boxes = [[100.0 + 3 * frame, 50.0, 60.0, 150.0], [400.0 - 3 * frame, 52.0, 60.0, 150.0]][: 1 + frame % 2]
        assert plain.advance(frame, boxes) == arrays.advance(frame, np.array(boxes))
    assert len(plain.active()) == 2


def test_strips_of_lines_are_the_whole_mask(spark, monkeypatch):
    from lumenframe.operators import masks

    monkeypatch.setattr(masks, "STRIP", 8)
    monkeypatch.setattr(masks, "TASK_LINES", 10)
    on = [(0, x, y, 70, 40) for x in range(70) for y in range(40) if (x * 7 + y * 11) % 89]
    px = spark.createDataFrame(on, "sample long, x int, y int, width int, height int")
    columns, left = masks.interior_columns(masks.lines(px, "sample"), "sample")
    places = {(x, y) for _, x, y, _, _ in on}
    want = {(x, y) for x, y in places if all((u, v) in places for u in range(max(0, x - 2), min(70, x + 2)) for v in range(max(0, y - 2), min(40, y + 2)))}
    assert {(r.x, y) for r in columns.collect() for y in r.ys} == want and left.collect() == [(0, len(want))]


@pytest.mark.parametrize("rows_of_a_task", [500_000, 3])
def test_columns_at_rank_of_small_and_large_groups(spark, monkeypatch, rows_of_a_task):
    from pyspark.sql import functions as F

    from lumenframe.operators import metrics

    monkeypatch.setattr(metrics, "TASK_ROWS", rows_of_a_task)
    data = [(g, float((i * 7 + g) % 13), float(i % 5)) for g in (1, 2) for i in range(20 + g)] + [(3, 1.0, None)]
    df = spark.createDataFrame(data, "g int, p double, q double")
    for few in (False, True):
        got = {r.g: (r.n, r.p, r.q) for r in metrics.columns_at_rank(df, ["g"], ["p", "q"], lambda n: F.floor(n / 2), few=few).collect()}
        assert got == {g: (20 + g, *[sorted(r[c] for r in data if r[0] == g)[(20 + g) // 2] for c in (1, 2)]) for g in (1, 2)}


def test_frames_of_one_size_together(spark):
    import numpy as np

    from lumenframe.operators import assign

    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 80, 5, 2, 1, 17])
    ends = np.cumsum(sizes)
    boxes, scores = rng.integers(1, 40, (ends[-1], 4)).astype(float), rng.integers(0, 4, ends[-1]) / 4
    got = assign.suppressed_by_frame(boxes, scores, ends - sizes, ends, 0.3)
    for a, b in zip(ends - sizes, ends, strict=True):
        order = np.lexsort((*boxes[a:b].T[::-1],))
        want = np.zeros(b - a, bool)
        want[order] = assign.suppressed(boxes[a:b][order], scores[a:b][order], 0.3)
        assert (got[a:b] == want).all()


def test_overlap_just_at_a_half_is_rounded_as_in_sql(spark, tmp_path):
    found = duckdb.sql("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey IN (3407, 81701, 96565)").fetchall()
    ours, theirs = differs(spark, tmp_path, "best_match_argmax", lineitem=(found, LINEITEM))
    assert ours == theirs
