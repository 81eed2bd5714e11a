"""Queries over brand observations: regions, gates, temporal state with a freeze, and what is accepted.

Observations come from events: user_id is the track, the region and brand follow event_id, the similarity value / 100.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import rules
from lumenframe.functions import vector as V
from lumenframe.plans.regions import BOXES_SQL, _boxes
from lumenframe.sources.tables import table

#: Names by which each region is called, in the order in which regions are compared; others count as Upper.
ALIASES = {"Upper": ("upper", "uppertorso", "torso"), "Lower": ("lower", "lowerbody", "legs"), "Watch": ("watch", "wrist"), "Shoes": ("shoe", "shoes", "feet"), "Bag": ("bag", "backpack")}
REGION = "CASE " + " ".join(f"WHEN lower(called) IN ({', '.join(repr(a) for a in names)}) THEN '{name}'" for name, names in ALIASES.items()) + " ELSE 'Upper' END"
CALLED = "CASE event_id % 6 WHEN 0 THEN 'UpperTorso' WHEN 1 THEN 'legs' WHEN 2 THEN 'Feet' WHEN 3 THEN 'backpack' WHEN 4 THEN 'Wrist' ELSE 'Sleeve' END"
#: Least similarity of a pass, observations of a pool, passes that make a brand stable.
PASS, POOL, STABLE = 0.40, 3, 2


def _observed(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "user_id AS track", "ts", f"{CALLED} AS called", "concat('B', cast(event_id * 7 % 3 AS string)) AS brand", "least(value / 100.0, 1.0) AS sim", "event_id % 17 = 0 AS switched")
    return e.selectExpr("*", f"{REGION} AS region", f"sim >= {PASS} AS ok")


OBSERVED = f"""e AS (SELECT event_id, user_id AS track, ts, {CALLED} AS called, concat('B', CAST(event_id * 7 % 3 AS VARCHAR)) AS brand, least(value / 100.0, 1.0::DOUBLE) AS sim, event_id % 17 = 0 AS switched FROM events),
o AS (SELECT *, {REGION} AS region, sim >= {PASS} AS ok FROM e)"""


def region_aliases(spark, d):
    return _observed(spark, d).groupBy("called", "region").agg(F.count("*").alias("n"))


ALIAS = f"WITH {OBSERVED} SELECT called, region, count(*) AS n FROM o GROUP BY 1, 2"


def _states(spark, d):
    """The state of each (track, region) after each observation: rows of a possible switch are ignored, the first stable result stays."""
    w = Window.partitionBy("track", "region").orderBy("ts", "event_id")
    pool = F.filter(F.collect_list(F.struct("brand", "sim", "ok")).over(w.rowsBetween(1 - POOL, 0)), lambda x: x.ok)
    o = _observed(spark, d).where("NOT switched").withColumn("pool", pool)
    groups = F.transform(F.array_distinct("pool.brand"), lambda b: F.struct((-F.size(F.filter("pool", lambda x: x.brand == b))).alias("neg"), F.array_position("pool.brand", b).alias("at"), b.alias("brand")))
    o = o.withColumn("top", F.get(F.array_sort(groups), F.lit(0)))
    best = F.array_max(F.transform(F.filter("pool", lambda x: x.brand == F.col("top.brand")), lambda x: x.sim))
    name = F.when(F.col("top").isNull(), "BrandUnknown").when(-F.col("top.neg") >= STABLE, "BrandStable").otherwise("BrandCandidate")
    found = F.struct(name.alias("state"), F.coalesce("top.brand", F.lit("BrandUnknown")).alias("brand"), F.coalesce(-F.col("top.neg"), F.lit(0)).cast("long").alias("hits"), F.coalesce(best, "sim").alias("similarity"))
    o = o.withColumn("found", found)
    frozen = F.first(F.when(F.col("found.state") == "BrandStable", F.col("found")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return o.select("event_id", "track", "region", "ts", F.coalesce(frozen, F.col("found")).alias("r")).select("event_id", "track", "region", "ts", "r.*")


STATES = f"""{OBSERVED}, n AS (SELECT *, row_number() OVER (PARTITION BY track, region ORDER BY ts, event_id) AS k FROM o WHERE NOT switched),
c AS (SELECT a.event_id, b.brand, count(*) AS hits, min(b.k) AS pos, max(b.sim) AS best FROM n a JOIN n b ON a.track = b.track AND a.region = b.region AND b.k BETWEEN a.k - {POOL - 1} AND a.k AND b.ok GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY hits DESC, pos) AS r FROM c),
f AS (SELECT n.*, CASE WHEN t.brand IS NULL THEN 'BrandUnknown' WHEN t.hits >= {STABLE} THEN 'BrandStable' ELSE 'BrandCandidate' END AS state, coalesce(t.brand, 'BrandUnknown') AS found, coalesce(t.hits, 0) AS hits, coalesce(t.best, n.sim) AS similarity
 FROM n LEFT JOIN t ON t.event_id = n.event_id AND t.r = 1),
s AS (SELECT track, region, min(k) AS k FROM f WHERE state = 'BrandStable' GROUP BY 1, 2),
z AS (SELECT f.event_id, f.track, f.region, f.ts, g.state, g.found AS brand, g.hits, g.similarity FROM f LEFT JOIN s ON s.track = f.track AND s.region = f.region JOIN f g ON g.track = f.track AND g.region = f.region AND g.k = CASE WHEN f.k >= s.k THEN s.k ELSE f.k END)"""


def brand_state(spark, d):
    return _states(spark, d).select("event_id", "track", "region", "state", "brand", "hits", F.round("similarity", 4).alias("similarity"))


STATE = f"WITH {STATES} SELECT event_id, track, region, state, brand, hits, round(similarity, 4) AS similarity FROM z"

#: Brand names that are none, and what a state is called.
NONE = ("BrandUnknown", "Unknown", "Not Visible")
NAMED = [("Not Visible", "state = 'NotVisible'"), ("Unknown", "state = 'BrandUnknown'"), ("Candidate", "state = 'BrandCandidate'"), ("Stable", "state = 'BrandStable'")]
ACCEPTED = f"state IN ('BrandCandidate', 'BrandStable') AND brand NOT IN ({', '.join(map(repr, NONE))})"
PLACE = "CASE region " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(("Upper", "Lower", "Watch", "Shoes", "Bag"))) + " END"


def top_brand(spark, d):
    """Each track's last states: how many regions have an accepted brand, and the most similar of them."""
    last = _states(spark, d).groupBy("track", "region").agg(F.max_by(F.struct("state", "brand", "similarity"), F.struct("ts", "event_id")).alias("l")).select("track", "region", "l.*")
    last = last.selectExpr("*", f"{ACCEPTED} AS accepted", f"{PLACE} AS place").withColumn("named", rules.first_match(NAMED, "Insufficient"))
    best = F.min(F.when(F.col("accepted"), F.struct((-F.col("similarity")).alias("neg"), "place", "region", "brand", "named")))
    out = last.groupBy("track").agg(F.count_if("accepted").alias("accepted"), F.count_if(F.col("state") == "BrandStable").alias("stable"), best.alias("b"))
    return out.select("track", "accepted", "stable", (F.col("accepted") > 0).alias("any_accepted"), F.col("b.region").alias("region"), F.col("b.brand").alias("brand"), F.col("b.named").alias("named"))


TOP = f"""WITH {STATES}, l AS (SELECT *, row_number() OVER (PARTITION BY track, region ORDER BY ts DESC, event_id DESC) AS r FROM z),
a AS (SELECT *, {ACCEPTED} AS accepted, {PLACE} AS place, {rules.first_match_sql(NAMED, 'Insufficient')} AS named FROM l WHERE r = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY similarity DESC, place) AS k FROM a WHERE accepted)
SELECT a.track, count(*) FILTER (WHERE a.accepted) AS accepted, count(*) FILTER (WHERE a.state = 'BrandStable') AS stable, count(*) FILTER (WHERE a.accepted) > 0 AS any_accepted, any_value(b.region) AS region, any_value(b.brand) AS brand, any_value(b.named) AS named
FROM a LEFT JOIN b ON b.track = a.track AND b.k = 1 GROUP BY a.track"""


def brand_snapshot(spark, d):
    """Without time, a single look decides: a pass is a candidate, never stable."""
    o = _observed(spark, d).where("NOT switched")
    return o.groupBy("region", F.when(F.col("ok"), "BrandCandidate").otherwise("BrandUnknown").alias("state")).agg(F.count("*").alias("n"), F.round(F.max("sim"), 4).alias("best"))


SNAPSHOT = f"WITH {OBSERVED} SELECT region, CASE WHEN ok THEN 'BrandCandidate' ELSE 'BrandUnknown' END AS state, count(*) AS n, round(max(sim), 4) AS best FROM o WHERE NOT switched GROUP BY 1, 2"

#: What is known of each region of a person, by fixed formulas; regions in the order in which they are worked through.
_PARTS = {"Upper": (1, 0.35), "Lower": (2, 0.40), "Shoes": (3, 0.06), "Watch": (4, 0.05), "Bag": (5, 0.10)}
#: A person of 180 pixels, each twelfth frame, regions of 32 pixels, logos of 24 in either direction.
DISPATCH = [
    ("Unchanged", "h * 0.53 < 180 OR frame % 12 <> 0"),
    ("ModelUnavailable", "region = 'Watch'"),
    ("UnsupportedRegion", "region = 'Bag' AND NOT present"),
    ("NotVisible", "NOT present OR (region <> 'Bag' AND NOT shown AND rh < 32)"),
    ("Kept", "steady"),
    ("InsufficientVisualEvidence", "rw < 32 OR rh < 32"),
    ("NoLogoCandidate", "logos = 0"),
    ("NoUsableCrop", "logo_w < 24 AND logo_h < 24"),
]
_FACTS = "(part + {i} * 7) % 5 <> 0 AS present, (part * 3 + {i}) % 4 <> 0 AS shown, (det + {i}) % 5 = 0 AS steady, (part + det + {i}) % 3 AS logos, (part * 5 + {i} * 11) % 60 AS logo_w, (part * 3 + det * 7) % 60 AS logo_h, w * 0.6 AS rw, h * {f} AS rh"


def brand_dispatch(spark, d):
    """What becomes of each region of each person."""
    b = _boxes(spark, d)
    parts = [f"named_struct('region', '{r}', 'i', {i}, 'f', cast({f} AS double))" for r, (i, f) in _PARTS.items()]
    rows = b.withColumn("r", F.explode(F.expr(f"array({', '.join(parts)})"))).select("*", "r.*").selectExpr("frame", "det", "part", "h", "region", *_FACTS.format(i="i", f="f").split(", "))
    return rows.select("region", rules.first_match(DISPATCH, "Recognised").alias("outcome")).groupBy("region", "outcome").agg(F.count("*").alias("n"))


_ALL = " UNION ALL ".join(f"SELECT *, '{r}' AS region, {_FACTS.format(i=i, f=f'{f}::DOUBLE')} FROM big" for r, (i, f) in _PARTS.items())
DISPATCHED = f"WITH {BOXES_SQL}, a AS ({_ALL}) SELECT region, {rules.first_match_sql(DISPATCH, 'Recognised')} AS outcome, count(*) AS n FROM a GROUP BY 1, 2"

#: Which bank each region is compared with.
BANKS = [("Upper", "upper_types", 12), ("Lower", "lower_types", 9), ("Shoes", "shoe_types", 7)]


def region_bank(spark, d):
    """Observations joined to the bank of their region; regions without a bank go."""
    bank = spark.createDataFrame(BANKS, "region string, bank string, labels long")
    return _observed(spark, d).join(F.broadcast(bank), "region").groupBy("region", "bank", "labels").agg(F.count("*").alias("n"))


BANK = f"WITH {OBSERVED}, b(region, bank, labels) AS (VALUES {', '.join(map(str, BANKS))}) SELECT region, bank, labels, count(*) AS n FROM o JOIN b USING (region) GROUP BY 1, 2, 3"


def brand_best(spark, d):
    """The greatest similarity of each supported brand to the first vector, and its exemplar; brands without any get zero."""
    v = table(spark, d, "embeddings").select("vec_id", "label", V.l2_normalize(V.doubles("embedding")).alias("v"))
    first = v.where("vec_id = 0").select(F.col("v").alias("q"))
    sims = v.where("vec_id <> 0").join(F.broadcast(first), F.lit(True)).select("label", F.struct(V.dot(F.col("v"), F.col("q")).alias("sim"), (-F.col("vec_id")).alias("neg")).alias("s"))
    best = sims.groupBy("label").agg(F.max("s").alias("s"))
    return spark.range(12).select(F.col("id").alias("label")).join(best, "label", "left").select("label", F.round(F.coalesce("s.sim", F.lit(0.0)), 4).alias("similarity"), F.concat(F.lit("v"), (-F.col("s.neg")).cast("string")).alias("exemplar"))


BRAND_BEST = """WITH n AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
s AS (SELECT n.label, n.vec_id, list_dot_product(n.v, q.v) AS sim FROM n, n q WHERE q.vec_id = 0 AND n.vec_id <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS k FROM s)
SELECT b.label, round(coalesce(r.sim, 0.0), 4) AS similarity, CASE WHEN r.vec_id IS NOT NULL THEN 'v' || CAST(r.vec_id AS VARCHAR) END AS exemplar FROM range(12) b(label) LEFT JOIN r ON r.label = b.label AND r.k = 1"""

QUERIES = {
    "region_aliases": (region_aliases, ALIAS),
    "brand_state": (brand_state, STATE),
    "top_brand": (top_brand, TOP),
    "brand_snapshot": (brand_snapshot, SNAPSHOT),
    "brand_dispatch": (brand_dispatch, DISPATCHED),
    "region_bank": (region_bank, BANK),
    "brand_best": (brand_best, BRAND_BEST),
}
