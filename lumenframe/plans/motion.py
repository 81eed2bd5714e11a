"""Queries over frames as small images and over camera motion, and over how a tracker fares.

An embedding is read as an image of 8 x 8 grey values; label is the scenario, vec_id the frame.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import rules
from lumenframe.functions import vector as V
from lumenframe.sources.tables import DETECTIONS_SQL, detections, table

SIDE = 8
GREYS = "g AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * 127 + 128) AS g FROM embeddings)"


def _greys(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(V.doubles("embedding"), lambda x: x * 127 + 128).alias("g"))


def _laplacian(spark, d):
    """Five-point stencil at each inner pixel."""
    inner = [r * SIDE + c for r in range(1, SIDE - 1) for c in range(1, SIDE - 1)]
    at = lambda i, k: F.get("g", i + k)
    stencil = F.transform(F.array(*map(F.lit, inner)), lambda i: at(i, -SIDE) + at(i, SIDE) + at(i, -1) + at(i, 1) - 4 * at(i, 0))
    return _greys(spark, d).select("vec_id", "label", F.explode(stencil).alias("lap"))


LAPLACIAN = f"""{GREYS}, l AS (SELECT vec_id, label, g[i - 7] + g[i + 9] + g[i] + g[i + 2] - 4 * g[i + 1] AS lap FROM g, range(64) t(i) WHERE i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6)"""


def laplacian_variance(spark, d):
    """Sharpness: the population variance of the filtered pixels."""
    return _laplacian(spark, d).groupBy("vec_id").agg(F.round(F.var_pop("lap"), 3).alias("sharpness"))


SHARP = f"WITH {LAPLACIAN} SELECT vec_id, round(var_pop(lap), 3) AS sharpness FROM l GROUP BY 1"


def _moves(spark, d):
    """Mean absolute difference to the scenario's frame before, over 40, at most 1; none for the first."""
    before = F.lag("g").over(Window.partitionBy("label").orderBy("vec_id"))
    x = _greys(spark, d).withColumn("b", before)
    gap = V.total(F.zip_with("g", "b", lambda p, q: F.abs(p - q))) / (SIDE * SIDE)
    return x.select("vec_id", "label", F.when(F.col("b").isNotNull(), F.least(F.lit(1.0), gap / 40)).alias("motion"))


MOVES = f"""{GREYS}, b AS (SELECT *, lag(g) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM g),
m AS (SELECT vec_id, label, CASE WHEN b IS NOT NULL THEN least(1.0, list_sum(list_transform(range(1, 65), lambda i: abs(g[i] - b[i]))) / 64 / 40) END AS motion FROM b)"""

#: Categories of motion, sharpness and both.
MOTION = [("Stable", "motion < 0.20"), ("ModerateMotion", "motion < 0.55")]
QUADRANT = [("Stable_Sharp", "motion < 0.20 AND sharp >= 45.0"), ("Moving_Sharp", "motion >= 0.20 AND sharp >= 45.0"), ("Moving_Blurry", "motion >= 0.20")]
#: Sharpness of a frame by a fixed formula, where a row is enough.
SHARP_OF = "(vec_id * 37 % 90) * 1.0 AS sharp"


def frame_motion(spark, d):
    x = _moves(spark, d).selectExpr("vec_id", "coalesce(motion, 0.0) * (vec_id % 5) / 5 AS motion", SHARP_OF)
    return x.select("vec_id", F.round("motion", 4).alias("motion"), rules.first_match(MOTION, "HighMotion").alias("category"), F.when(F.col("sharp") >= 45, "Sharp").otherwise("Blurry").alias("sharpness"), rules.first_match(QUADRANT, "Stable_Blurry").alias("quadrant"))


FRAME = f"""WITH {MOVES}, s AS (SELECT vec_id, coalesce(motion, 0.0) * (vec_id % 5) / 5 AS motion, {SHARP_OF} FROM m)
SELECT vec_id, round(motion, 4) AS motion, {rules.first_match_sql(MOTION, 'HighMotion')} AS category, CASE WHEN sharp >= 45 THEN 'Sharp' ELSE 'Blurry' END AS sharpness, {rules.first_match_sql(QUADRANT, 'Stable_Blurry')} AS quadrant FROM s"""

#: Truth, detections and the confirmed track (none: 0) of each frame, by fixed formulas.
LOG = ["vec_id", "label", "vec_id % 9 <> 0 AS truth", "vec_id % 7 <> 0 AS detected", "CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 1 + (vec_id // 60) % 3 END AS track", SHARP_OF]
#: How a frame failed; before is the confirmed track seen last in the scenario.
FAILURES = [
    ("A", "truth AND NOT detected"),
    ("B", "truth AND detected AND track > 0 AND before > 0 AND track <> before"),
    ("B lost", "truth AND detected AND track = 0 AND before > 0"),
    ("D", "NOT truth AND detected"),
]


def _failures(spark, d):
    """Only frames with truth and a detection carry the confirmed track on."""
    x = table(spark, d, "embeddings").selectExpr(*[c.replace("vec_id // 60", "(vec_id div 60)") for c in LOG])
    held = F.when(F.col("truth") & F.col("detected") & (F.col("track") > 0), F.col("track"))
    before = F.last(held, ignorenulls=True).over(Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("failure", rules.first_match(FAILURES, "None"))


FAILED = f"""f0 AS (SELECT {', '.join(LOG)} FROM embeddings), f1 AS (SELECT *, CASE WHEN truth AND detected AND track > 0 THEN track END AS held FROM f0),
f2 AS (SELECT *, coalesce(last_value(held IGNORE NULLS) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f1), f AS (SELECT *, {rules.first_match_sql(FAILURES, 'None')} AS failure FROM f2)"""


def failure_classes(spark, d):
    return _failures(spark, d).select("vec_id", F.col("before").cast("long").alias("before"), "failure")


CLASSES = f"WITH {FAILED} SELECT vec_id, CAST(before AS BIGINT) AS before, failure FROM f"


def scenario_summary(spark, d):
    """Miss rate, switches, false detections, ids beyond the first, and the mean sharpness of failures, by scenario."""
    f, failed = _failures(spark, d), F.col("failure")
    return f.groupBy("label").agg(
        F.round(F.coalesce(F.count_if(failed == "A") / F.nullif(F.count_if("truth"), F.lit(0)), F.lit(0.0)), 4).alias("miss_rate"),
        F.count_if(failed == "B").alias("switches"), F.count_if(failed == "D").alias("false_detections"),
        F.greatest(F.lit(0).cast("long"), F.countDistinct(F.when(F.col("track") > 0, F.col("track"))) - 1).alias("false_ids"),
        F.round(F.coalesce(F.avg(F.when(failed != "None", F.col("sharp"))), F.lit(0.0)), 4).alias("sharpness"),
    )


SUMMARY = f"""WITH {FAILED} SELECT label, round(coalesce(count(*) FILTER (WHERE failure = 'A')::DOUBLE / nullif(count(*) FILTER (WHERE truth), 0), 0.0), 4) AS miss_rate, count(*) FILTER (WHERE failure = 'B') AS switches,
 count(*) FILTER (WHERE failure = 'D') AS false_detections, greatest(0, count(DISTINCT track) FILTER (WHERE track > 0) - 1) AS false_ids, round(coalesce(avg(sharp) FILTER (WHERE failure <> 'None'), 0.0), 4) AS sharpness FROM f GROUP BY 1"""

#: Where a colour choice comes from. The semantic colour needs confidence .25; a neutral that both agree on is measured.
FALLBACK = "CASE WHEN conf >= 0.25 AND semantic <> 'Unknown' THEN semantic ELSE measured END"
HYBRID = "CASE WHEN chroma < 4.0 AND semantic IN ('Black', 'Grey', 'White') THEN measured WHEN margin >= 0.07 THEN semantic ELSE measured END"
_NAMES = "CASE {} WHEN 0 THEN 'Black' WHEN 1 THEN 'Red' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Grey' WHEN 4 THEN 'Blue' ELSE 'White' END"
CHOICE = ["frame", "det", "confidence AS conf", f"{_NAMES.format('part % 6')} AS semantic", f"{_NAMES.format('part * 7 % 5')} AS measured", "(part * 11 % 90) / 10.0 AS chroma", "(part * 13 % 20) / 100.0 AS margin"]


def colour_choice(spark, d):
    """The semantic colour or the measured one: by confidence alone, and by chroma and margin."""
    x = detections(spark, d).selectExpr(*CHOICE)
    return x.selectExpr(f"{FALLBACK} AS by_confidence", f"{HYBRID} AS by_margin").groupBy("by_confidence", "by_margin").agg(F.count("*").alias("n"))


CHOICES = f"WITH {DETECTIONS_SQL}, c AS (SELECT {', '.join(CHOICE)} FROM det) SELECT {FALLBACK} AS by_confidence, {HYBRID} AS by_margin, count(*) AS n FROM c GROUP BY 1, 2"

#: Shades that count as right for a colour, but not the other way round.
SHADES = {"Red": ("Maroon",), "Blue": ("Navy",), "Green": ("Olive",)}
ONE_WAY = "predicted = expected OR " + " OR ".join(f"(expected = '{c}' AND predicted IN ({', '.join(map(repr, s))}))" for c, s in SHADES.items())
_WORDS = ["Red", "Maroon", "Blue", "Navy", "Green", "Olive"]
_WORD = lambda c: "CASE " + c + " " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END"
PAIRED = [f"{_WORD('o_orderkey % 6')} AS expected", f"{_WORD('o_custkey % 6')} AS predicted"]


def one_way_synonyms(spark, d):
    x = table(spark, d, "orders").selectExpr(*PAIRED)
    return x.groupBy("expected", "predicted").agg(F.count("*").alias("n"), F.max(F.expr(ONE_WAY)).alias("right"))


ONE = f'WITH p AS (SELECT {", ".join(PAIRED)} FROM orders) SELECT expected, predicted, count(*) AS n, bool_or({ONE_WAY}) AS "right" FROM p GROUP BY 1, 2'


def mean_hsv(spark, d):
    """Channel means of each sample, named by the rules."""
    x = table(spark, d, "lineitem").selectExpr("l_suppkey AS sample", "l_partkey % 180 AS h", "l_orderkey % 256 AS s", "(l_partkey * 3 + l_suppkey * 7) % 256 AS v")
    x = x.groupBy("sample").agg(F.avg("h").alias("H"), (F.avg("s") * 0.4).alias("S"), F.avg("v").alias("V"))
    return x.select("sample", F.round("H", 4).alias("hue"), rules.first_match(rules.HSV_RULES, "Grey").alias("name"))


MEAN = f"""WITH x AS (SELECT l_suppkey AS sample, avg(l_partkey % 180) AS H, avg(l_orderkey % 256) * 0.4 AS S, avg((l_partkey * 3 + l_suppkey * 7) % 256) AS V FROM lineitem GROUP BY 1)
SELECT sample, round(H, 4) AS hue, {rules.first_match_sql(rules.HSV_RULES, 'Grey')} AS name FROM x"""


def polygon_mask(spark, d):
    """Grid points inside a convex four-corner body and inside an ellipse, for each brand's fixed shape."""
    x = spark.range(0, 30 * 30).selectExpr("id % 30 AS x", "id div 30 AS y")
    return x.selectExpr(f"{INSIDE} AS in_body", f"{ELLIPSE} AS in_ellipse").groupBy("in_body", "in_ellipse").agg(F.count("*").alias("n"))


#: Corners in order; a point is inside if it is on the same side of all edges.
CORNERS = [(6, 3), (22, 5), (25, 27), (4, 24)]
INSIDE = " AND ".join(f"({bx - ax}) * (y - {ay}) - ({by - ay}) * (x - {ax}) >= 0" for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True))
ELLIPSE = "((x - 15.0) / 9.0) * ((x - 15.0) / 9.0) + ((y - 14.0) / 12.0) * ((y - 14.0) / 12.0) <= 1.0"
MASK = f"WITH g AS (SELECT x, y FROM range(30) a(x), range(30) b(y)) SELECT {INSIDE} AS in_body, {ELLIPSE} AS in_ellipse, count(*) AS n FROM g GROUP BY 1, 2"


def best_five(spark, d):
    """The five best observations of each track vote by quality; the best must reach 0.35."""
    o = table(spark, d, "events").select("event_id", F.col("user_id").alias("track"), F.col("event_type").alias("category"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("q"))
    o = o.withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("q"), "event_id"))).where("k <= 5")
    sums = o.groupBy("track", "category").agg(F.sum("q").alias("s"), F.max("q").alias("top"))
    best = sums.groupBy("track").agg(F.min(F.struct(F.round(-F.col("s"), 9).alias("neg"), "category")).alias("b"), F.max("top").alias("top"))
    return best.select("track", F.when(F.col("top") >= 0.35, F.col("b.category")).otherwise("InsufficientVisualEvidence").alias("consensus"))


FIVE = """WITH o AS (SELECT event_id, user_id AS track, event_type AS category, least(value / 100.0, 1.0::DOUBLE) AS q FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY q DESC, event_id) AS k FROM o),
s AS (SELECT track, category, sum(q) AS s, max(q) AS top FROM r WHERE k <= 5 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(-s, 9), category) AS k, max(top) OVER (PARTITION BY track) AS best FROM s)
SELECT track, CASE WHEN best >= 0.35 THEN category ELSE 'InsufficientVisualEvidence' END AS consensus FROM b WHERE k = 1"""

QUERIES = {
    "laplacian_variance": (laplacian_variance, SHARP),
    "frame_motion": (frame_motion, FRAME),
    "failure_classes": (failure_classes, CLASSES),
    "scenario_summary": (scenario_summary, SUMMARY),
    "colour_choice": (colour_choice, CHOICES),
    "one_way_synonyms": (one_way_synonyms, ONE),
    "mean_hsv": (mean_hsv, MEAN),
    "polygon_mask": (polygon_mask, MASK),
    "best_five": (best_five, FIVE),
}
