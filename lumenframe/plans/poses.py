"""Queries over detector outputs and keypoints, drawn from embeddings and lineitem by fixed formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import vector as V
from lumenframe.sources.tables import table

#: Least confidence of a detection, and of a visible keypoint.
CONFIDENCE, VISIBLE = 0.35, 0.30


def detector_rows(spark, d):
    """Rows of centre, size, objectness and classes: objectness is tested before the class product."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(V.doubles("embedding"), lambda x: V.sigmoid(x * 8)).alias("p"))
    cells = e.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("p", i * 8 + 1, 8))).alias("cell", "r"))
    cells = cells.where(F.get("r", F.lit(4)) >= CONFIDENCE)
    classes = F.slice("r", 6, 3)
    best = F.get("r", F.lit(4)) * F.array_max(classes)
    return cells.where(best >= CONFIDENCE).select("vec_id", F.col("cell").cast("long").alias("cell"), V.argmax(classes).cast("long").alias("class"), F.round(best, 4).alias("score"))


DETECTOR = """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 1 / (1 + exp(-8 * x))) AS p FROM embeddings),
c AS (SELECT vec_id, i AS cell, list_slice(p, i * 8 + 1, i * 8 + 8) AS r FROM e, range(8) t(i)),
b AS (SELECT vec_id, cell, list_slice(r, 6, 8) AS k, r[5] AS o FROM c WHERE r[5] >= 0.35)
SELECT vec_id, cell, list_position(k, list_max(k)) - 1 AS class, round(o * list_max(k), 4) AS score FROM b WHERE o * list_max(k) >= 0.35"""


def detector_columns(spark, d):
    """The transposed layout: one row of values for each class, no objectness."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(V.doubles("embedding"), lambda x: V.sigmoid(x * 8))).alias("at", "p"))
    e = e.where("at >= 32").select("vec_id", (F.col("at") % 8).cast("long").alias("cell"), F.floor((F.col("at") - 32) / 8).alias("class"), "p")
    best = e.groupBy("vec_id", "cell").agg(F.max(F.struct("p", (-F.col("class")).alias("neg"))).alias("m"))
    return best.where(F.col("m.p") >= 0.6).select("vec_id", "cell", (-F.col("m.neg")).alias("class"), F.round("m.p", 4).alias("score"))


COLUMNS = """WITH e AS (SELECT vec_id, unnest(list_transform(embedding::DOUBLE[], lambda x: 1 / (1 + exp(-8 * x)))) AS p, unnest(range(64)) AS i FROM embeddings),
c AS (SELECT vec_id, i % 8 AS cell, (i - 32) // 8 AS class, p FROM e WHERE i >= 32), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, cell ORDER BY p DESC, class) AS k FROM c)
SELECT vec_id, cell, class, round(p, 4) AS score FROM r WHERE k = 1 AND p >= 0.6"""


def _points(spark, d):
    """Confidences and heights of 17 keypoints for each embedding."""
    p = F.transform(F.slice(V.doubles("embedding"), 1, 34), lambda x: V.sigmoid(x * 8))
    e = table(spark, d, "embeddings").select("vec_id", p.alias("p"))
    return e.select("vec_id", F.slice("p", 1, 17).alias("c"), F.slice("p", 18, 17).alias("y"))


POINTS = """e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 1 / (1 + exp(-8 * x))) AS p FROM embeddings), k AS (SELECT vec_id, list_slice(p, 1, 17) AS c, list_slice(p, 18, 34) AS y FROM e)"""


def visibility_flags(spark, d):
    """Which parts are seen, how many keypoints, their mean confidence, and raised hands (keypoints by fixed number)."""
    k = _points(spark, d)
    seen = lambda *i: [F.get("c", F.lit(x)) >= 0.5 for x in i]
    either = lambda *i: F.greatest(*[s.cast("int") for s in seen(*i)]) == 1
    visible = F.filter("c", lambda x: x >= 0.5)
    raised = lambda wrist, shoulder: seen(wrist)[0] & seen(shoulder)[0] & (F.get("y", F.lit(wrist)) < F.get("y", F.lit(shoulder)))
    return k.select(
        "vec_id", either(0, 1, 2, 3, 4).alias("head"), either(5, 6).alias("shoulders"), either(11, 12).alias("hips"), either(15, 16).alias("feet"),
        F.size(visible).cast("long").alias("points"), F.round(V.total(F.col("c")) / 17, 4).alias("mean_confidence"), (raised(9, 5) | raised(10, 6)).alias("raised"),
    )


VISIBILITY = f"""WITH {POINTS} SELECT vec_id, list_max(list_slice(c, 1, 5)) >= 0.5 AS head, greatest(c[6], c[7]) >= 0.5 AS shoulders, greatest(c[12], c[13]) >= 0.5 AS hips, greatest(c[16], c[17]) >= 0.5 AS feet,
 len(list_filter(c, lambda x: x >= 0.5)) AS points, round(list_sum(c) / 17, 4) AS mean_confidence, (c[10] >= 0.5 AND c[6] >= 0.5 AND y[10] < y[6]) OR (c[11] >= 0.5 AND c[7] >= 0.5 AND y[11] < y[7]) AS raised FROM k"""


def orientation(spark, d):
    """Front with nose and both eyes, near-frontal with nose and one, side with one ear only, back with shoulders alone."""
    k = _points(spark, d)
    c = lambda i: F.get("c", F.lit(i)) >= 0.5
    label = F.when(c(0) & c(1) & c(2), "Front").when(c(0) & (c(1) != c(2)), "NearFrontal").when(c(3) != c(4), "Side").when(~c(0) & c(5) & c(6), "Back").otherwise("Uncertain")
    return k.groupBy(label.alias("orientation")).agg(F.count("*").alias("n"))


ORIENTATION = f"""WITH {POINTS}, v AS (SELECT list_transform(c, lambda x: x >= 0.5) AS s FROM k)
SELECT CASE WHEN s[1] AND s[2] AND s[3] THEN 'Front' WHEN s[1] AND s[2] <> s[3] THEN 'NearFrontal' WHEN s[4] <> s[5] THEN 'Side' WHEN NOT s[1] AND s[6] AND s[7] THEN 'Back' ELSE 'Uncertain' END AS orientation, count(*) AS n FROM v GROUP BY 1"""


def anatomical_consistency(spark, d):
    """Passed checks over made checks; 0.5 when nothing can be checked."""
    k = _points(spark, d)
    y, c = (lambda i: F.get("y", F.lit(i))), (lambda i: F.get("c", F.lit(i)) >= 0.5)
    pairs = [(0, 5), (5, 11), (11, 13), (13, 15), (6, 12)]
    made = sum(((c(a) & c(b)).cast("int") for a, b in pairs), F.lit(0))
    passed = sum(((c(a) & c(b) & (y(a) < y(b))).cast("int") for a, b in pairs), F.lit(0))
    return k.select("vec_id", F.round(F.when(made == 0, 0.5).otherwise(passed / made), 4).alias("score"))


PAIRS = [(1, 6), (6, 12), (12, 14), (14, 16), (7, 13)]
MADE = " + ".join(f"CAST(c[{a}] >= 0.5 AND c[{b}] >= 0.5 AS INT)" for a, b in PAIRS)
PASSED = " + ".join(f"CAST(c[{a}] >= 0.5 AND c[{b}] >= 0.5 AND y[{a}] < y[{b}] AS INT)" for a, b in PAIRS)
ANATOMY = f"WITH {POINTS} SELECT vec_id, round(CASE WHEN {MADE} = 0 THEN 0.5 ELSE ({PASSED})::DOUBLE / ({MADE}) END, 4) AS score FROM k"

QUERIES = {
    "detector_rows": (detector_rows, DETECTOR),
    "detector_columns": (detector_columns, COLUMNS),
    "visibility_flags": (visibility_flags, VISIBILITY),
    "orientation": (orientation, ORIENTATION),
    "anatomical_consistency": (anatomical_consistency, ANATOMY),
}
