"""Erosion, interior sampling and clusters of colours against plain loops."""

import random

from lumenframe.operators import clusters, masks


def plain(width, height, on):
    side = max(3, min(width, height) // 10)
    before, after = side // 2, side - 1 - side // 2
    left = {
        (x, y) for x, y in on
        if all((u, v) in on for u in range(max(0, x - before), min(width, x + after + 1)) for v in range(max(0, y - before), min(height, y + after + 1)))
    }
    more = {(x, y) for x, y in on if int(width * 0.3) <= x < int(width * 0.7) and int(height * 0.3) <= y < int(height * 0.7)} if len(left) < 20 else set()
    return left, sorted([*left, *more])


def test_masks_equal_plain_loops(spark):
    rng, rows, want = random.Random(9), [], {}
    for sample, (width, height, share) in enumerate([(12, 9, 0.95), (44, 31, 0.99), (50, 60, 1.0), (8, 8, 1.0), (1, 1, 1.0), (30, 2, 0.9), (20, 20, 0.3), (40, 40, 0.97)]):
        on = {(x, y) for x in range(width) for y in range(height) if rng.random() < share}
        rows += [(sample, x, y, width, height) for x, y in on]
        want[sample] = plain(width, height, on)
    px = spark.createDataFrame(rows, "sample long, x int, y int, width int, height int").repartition(3)
    left, inner = {}, {}
    for r in masks.eroded(px, "sample").collect():
        left.setdefault(r.sample, set()).add((r.x, r.y))
    for r in masks.interior(px, "sample").collect():
        inner.setdefault(r.sample, []).append((r.x, r.y))
    assert any(len(e) >= 20 for e, _ in want.values()) and any(0 < len(e) < 20 for e, _ in want.values())
    for sample, (e, i) in want.items():
        assert left.get(sample, set()) == e and sorted(inner.get(sample, [])) == i
    assert masks.interior(px.where("false"), "sample").count() == 0


def plain_kmeans(colours):
    k = max(2, min(3, len(colours) // 25))
    gap = lambda p, q: sum((x - y) * (x - y) for x, y in zip(p, q, strict=True))
    centres = [min(colours)]
    while len(centres) < k:
        centres.append(min(set(colours), key=lambda p: (-min(gap(p, c) for c in centres), p)))
    near = lambda p: min(range(k), key=lambda i: (gap(p, centres[i]), i))
    for _ in range(15):
        at = [near(p) for p in colours]
        new = [tuple(sum(p[j] for p, a in zip(colours, at, strict=True) if a == i) / at.count(i) for j in range(3)) if i in at else c for i, c in enumerate(centres)]
        far, centres = max(gap(p, q) for p, q in zip(centres, new, strict=True)), new
        if far <= 1.0:
            break
    at = [near(p) for p in colours]
    return {i: (at.count(i), [round(x, 6) for x in centres[i]]) for i in set(at)}


def test_clusters_equal_plain_loops(spark):
    rng = random.Random(4)
    samples = [[(float(rng.randrange(100)), float(rng.randrange(-40, 40)), float(rng.randrange(-40, 40))) for _ in range(n)] for n in (1, 30, 74, 75, 300)]
    samples += [[(1.0, 2.0, 3.0)] * 90, [(1.0, 2.0, 3.0)] * 50 + [(60.0, 2.0, 3.0)] * 50]
    px = spark.createDataFrame([(i, *p) for i, s in enumerate(samples) for p in s], "sample long, L double, a double, b double").repartition(3)
    got = {}
    for r in clusters.kmeans(px, "sample").collect():
        got.setdefault(r["sample"], {})[r.k] = (r.n, [round(x, 6) for x in (r.L, r.a, r.b)])
    assert got == {i: plain_kmeans(s) for i, s in enumerate(samples)}
    assert clusters.kmeans(px.where("false"), "sample").count() == 0
