"""Queries over the life of a track's attributes: admission, freezes, and states from rolling evidence.

Observations come from events, as in ``plans.tracks``; what is seen of the person follows event_id.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import rules
from lumenframe.plans.boxes import CANDIDATES
from lumenframe.sources.tables import DETECTIONS_SQL, detections, table

#: Observations of a window, least observations, margin and consensus, least share that a category may have with a small margin, quality of the best pool.
LAST, LEAST, MARGIN, CONSENSUS, SHARE, POOL = 10, 5, 0.12, 0.65, 0.45, 0.60
_Q = "least(value / 100.0, 1.0)"
SEEN = [
    "event_id", "ts", "user_id AS track", "event_type AS category", f"{_Q} AS quality", "(event_id % 40) / 100.0 AS margin_in",
    "(event_id div 13) % 4 = 1 AS has", "event_id % 5 <> 0 AS visible", "event_id % 7 <> 0 AS evidence", "event_id % 11 = 0 AS blank", "event_id % 17 = 0 AS switched",
]


def _roll():
    return Window.partitionBy("track").orderBy("ts", "event_id").rowsBetween(1 - LAST, 0)


def _ever():
    return Window.partitionBy("track").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)


def _seen(spark, d):
    return table(spark, d, "events").selectExpr(*SEEN)


SEEN_SQL = "o AS (SELECT " + ", ".join(SEEN).replace(" div ", " // ").replace("100.0", "100.0::DOUBLE").replace("1.0)", "1.0::DOUBLE)") + ", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
#: The state of an attribute. Without valid observations a track that has a pool of good ones keeps its state.
STATES = [
    ("Keep", "n = 0 AND pooled"),
    ("NotVisible", "n = 0 AND NOT visible"),
    ("Analyzing", "n = 0 AND evidence"),
    ("InsufficientVisualEvidence", "n = 0"),
    ("Analyzing", f"n < {LEAST}"),
]
TWO_STATES = [*STATES, ("Uncertain", f"margin < {MARGIN} OR consensus < {CONSENSUS}")]
TYPE_STATES = [*STATES, ("Uncertain", f"(margin < {MARGIN} AND share < {SHARE}) OR consensus < {CONSENSUS}")]
KEPT = "CASE WHEN state <> 'Keep' THEN state END"


def two_class_life(spark, d):
    """A two-class attribute over the last observations: quality-weighted means, votes, and the state."""
    ok = F.col("has") & F.col("category").isin("click", "error")
    w = F.greatest(F.col("quality"), F.lit(0.1)) * F.least(F.greatest(F.col("margin_in") / 0.30, F.lit(0.25)), F.lit(1.0))
    a, b = F.when(F.col("category") == "click", F.col("quality")).otherwise(0.0), F.when(F.col("category") == "error", F.col("quality")).otherwise(0.0)
    o = _seen(spark, d).withColumns({"w": F.when(ok, w), "a": F.when(ok, a), "b": F.when(ok, b)})
    total = F.sum("w").over(_roll())
    o = o.withColumns({
        "n": F.count("w").over(_roll()), "ma": F.sum(F.col("a") * F.col("w")).over(_roll()) / total, "mb": F.sum(F.col("b") * F.col("w")).over(_roll()) / total,
        "va": F.count_if(F.col("a") > F.col("b")).over(_roll()), "pooled": F.coalesce(F.bool_or(F.col("has") & (F.col("quality") >= POOL)).over(_ever()), F.lit(False)),
    })
    o = o.withColumns({"margin": F.round(F.abs(F.col("ma") - F.col("mb")), 9), "consensus": F.round(F.when(F.col("ma") > F.col("mb"), F.col("va")).otherwise(F.col("n") - F.col("va")) / F.nullif("n", F.lit(0)), 9)})
    o = o.withColumn("state", rules.first_match(TWO_STATES, "Stable"))
    state = F.coalesce(F.last(F.expr(KEPT), ignorenulls=True).over(_ever()), F.lit("Analyzing"))
    return o.select("event_id", F.col("n").cast("long").alias("n"), F.round("consensus", 4).alias("consensus"), F.when(F.col("n") > 0, F.when(F.col("ma") > F.col("mb"), "click").otherwise("error")).alias("winner"), state.alias("state"))


_WEIGHT = "greatest(quality, 0.1) * least(greatest(margin_in / {}, 0.25), 1.0)"
_POOLED = f"coalesce(bool_or(has AND quality >= {POOL}) OVER (PARTITION BY track ORDER BY k ROWS UNBOUNDED PRECEDING), false) AS pooled"
TWO = f"""WITH {SEEN_SQL}, w AS (SELECT *, CASE WHEN has AND category IN ('click', 'error') THEN {_WEIGHT.format('0.30')} END AS w, CASE WHEN category = 'click' THEN quality ELSE 0 END AS a, CASE WHEN category = 'error' THEN quality ELSE 0 END AS b FROM o),
r AS (SELECT *, count(w) OVER l AS n, sum(a * w) OVER l / sum(w) OVER l AS ma, sum(b * w) OVER l / sum(w) OVER l AS mb, count(CASE WHEN w IS NOT NULL AND a > b THEN 1 END) OVER l AS va, {_POOLED} FROM w WINDOW l AS (PARTITION BY track ORDER BY k ROWS {LAST - 1} PRECEDING)),
m AS (SELECT *, round(abs(ma - mb), 9) AS margin, round((CASE WHEN ma > mb THEN va ELSE n - va END)::DOUBLE / nullif(n, 0), 9) AS consensus FROM r),
s AS (SELECT *, {rules.first_match_sql(TWO_STATES, 'Stable')} AS state FROM m)
SELECT event_id, n, round(consensus, 4) AS consensus, CASE WHEN n > 0 THEN CASE WHEN ma > mb THEN 'click' ELSE 'error' END END AS winner,
 coalesce(last_value({KEPT} IGNORE NULLS) OVER (PARTITION BY track ORDER BY k ROWS UNBOUNDED PRECEDING), 'Analyzing') AS state FROM s"""


def category_life(spark, d):
    """A category over the last observations: those with an empty score map weigh in the total, and count for the consensus."""
    w = F.greatest(F.col("quality"), F.lit(0.1)) * F.least(F.greatest(F.col("margin_in") / 0.25, F.lit(0.25)), F.lit(1.0))
    o = _seen(spark, d).withColumn("w", F.when(F.col("has"), w))
    held = F.filter(F.collect_list(F.struct("has", "blank", "category", "quality", "w")).over(_roll()), lambda x: x.has)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda t, x: t + f(x))
    o = o.withColumns({"held": held, "pooled": F.coalesce(F.bool_or(F.col("has") & (F.col("quality") >= POOL)).over(_ever()), F.lit(False))})
    o = o.withColumns({"n": F.size("held"), "total": total(F.col("held"), lambda x: x.w), "scored": F.filter("held", lambda x: ~x.blank)})
    cats = F.transform(F.array_distinct("scored.category"), lambda c: F.struct(F.round(-total(F.filter("scored", lambda x: x.category == c), lambda x: x.quality * x.w), 9).alias("neg"), c.alias("category"), F.size(F.filter("scored", lambda x: x.category == c)).alias("votes")))
    o = o.withColumn("cats", F.array_sort(cats))
    top, second = F.get("cats", F.lit(0)), F.get("cats", F.lit(1))
    o = o.withColumns({"share": F.round(F.coalesce(-top.neg, F.lit(0.0)) / F.nullif("total", F.lit(0.0)), 9), "margin": F.round((F.coalesce(-top.neg, F.lit(0.0)) - F.coalesce(-second.neg, F.lit(0.0))) / F.nullif("total", F.lit(0.0)), 9), "consensus": F.round(F.coalesce(top.votes, F.lit(0)) / F.nullif(F.col("n").cast("double"), F.lit(0.0)), 9)})
    o = o.withColumn("state", rules.first_match(TYPE_STATES, "Stable"))
    state = F.coalesce(F.last(F.expr(KEPT), ignorenulls=True).over(_ever()), F.lit("Analyzing"))
    return o.select("event_id", F.col("n").cast("long").alias("n"), top.category.alias("top"), F.round("share", 4).alias("share"), F.round("margin", 4).alias("margin"), F.round("consensus", 4).alias("consensus"), state.alias("state"))


CATEGORY = f"""WITH {SEEN_SQL}, w AS (SELECT *, {_WEIGHT.format('0.25')} AS w, {_POOLED} FROM o),
t AS (SELECT a.event_id, count(b.w) AS n, sum(b.w) AS tw FROM w a LEFT JOIN w b ON a.track = b.track AND b.has AND b.k BETWEEN a.k - {LAST - 1} AND a.k GROUP BY 1),
c AS (SELECT a.event_id, b.category, round(sum(b.quality * b.w), 9) AS s, count(*) AS votes FROM w a JOIN w b ON a.track = b.track AND b.has AND NOT b.blank AND b.k BETWEEN a.k - {LAST - 1} AND a.k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, category) AS rk, lead(s) OVER (PARTITION BY event_id ORDER BY s DESC, category) AS s2 FROM c),
m AS (SELECT w.*, t.n, r.category AS top, round(coalesce(r.s, 0) / nullif(t.tw, 0), 9) AS share, round((coalesce(r.s, 0) - coalesce(r.s2, 0)) / nullif(t.tw, 0), 9) AS margin, round(coalesce(r.votes, 0)::DOUBLE / nullif(t.n, 0), 9) AS consensus
 FROM w JOIN t USING (event_id) LEFT JOIN r ON r.event_id = w.event_id AND r.rk = 1),
s AS (SELECT *, {rules.first_match_sql(TYPE_STATES, 'Stable')} AS state FROM m)
SELECT event_id, n, top, round(share, 4) AS share, round(margin, 4) AS margin, round(consensus, 4) AS consensus, coalesce(last_value({KEPT} IGNORE NULLS) OVER (PARTITION BY track ORDER BY k ROWS UNBOUNDED PRECEDING), 'Analyzing') AS state FROM s"""

#: What an observation has where a stage gave no result.
DEFAULTS = {"category": ("CASE WHEN has THEN category END", "'Unknown'"), "quality": ("CASE WHEN has THEN quality END", "0.0"), "margin": ("CASE WHEN evidence THEN margin_in END", "0.0"), "switched": ("CASE WHEN visible THEN switched END", "false")}


def observation_defaults(spark, d):
    return _seen(spark, d).selectExpr("event_id", *[f"coalesce({v}, {default}) AS {k}" for k, (v, default) in DEFAULTS.items()])


OBSERVATION = f"WITH {SEEN_SQL} SELECT event_id, " + ", ".join(f"coalesce({v}, {default}) AS {k}" for k, (v, default) in DEFAULTS.items()) + " FROM o"


def admission(spark, d):
    """Confirmed tracks' observations that may be aggregated: live asks for quality, video does not."""
    o = _seen(spark, d).where("track % 10 > 0 AND visible").withColumn("live", F.expr("quality >= 0.3 AND evidence AND NOT switched")).withColumn("video", F.expr("evidence AND NOT switched"))
    return o.groupBy("track").agg(F.count("*").alias("confirmed"), F.count_if("live").alias("live"), F.count_if("video").alias("video"))


ADMISSION = f"WITH {SEEN_SQL} SELECT track, count(*) AS confirmed, count(*) FILTER (WHERE quality >= 0.3 AND evidence AND NOT switched) AS live, count(*) FILTER (WHERE evidence AND NOT switched) AS video FROM o WHERE track % 10 > 0 AND visible GROUP BY 1"


def frozen_updates(spark, d):
    """Updates that count: none of a possible switch, and none after the track was finalised (its first best score)."""
    done = F.coalesce(F.bool_or((F.col("quality") >= 0.98) & ~F.col("switched")).over(_ever().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    o = _seen(spark, d).withColumn("finalised", done)
    return o.groupBy("track").agg(F.count("*").alias("n"), F.count_if(~F.col("switched") & ~F.col("finalised")).alias("used"), F.round(F.max(F.when(~F.col("switched") & ~F.col("finalised"), F.col("quality"))), 4).alias("best"))


FROZEN = f"""WITH {SEEN_SQL}, f AS (SELECT *, coalesce(bool_or(quality >= 0.98 AND NOT switched) OVER (PARTITION BY track ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS finalised FROM o)
SELECT track, count(*) AS n, count(*) FILTER (WHERE NOT switched AND NOT finalised) AS used, round(max(quality) FILTER (WHERE NOT switched AND NOT finalised), 4) AS best FROM f GROUP BY 1"""


def valid_candidates(spark, d):
    """Detections that are Strong or Probable, with their old place in the frame and a new one without gaps."""
    x = detections(spark, d).select("frame", "det", "confidence", F.col("box.w").alias("w"), F.col("box.h").alias("h"), (F.col("quantity") % 6).cast("int").alias("points"))
    x = x.withColumn("tier", rules.first_match(CANDIDATES, "Weak")).where("tier IN ('Strong', 'Probable')")
    return x.select("frame", "det", "tier", F.rank().over(Window.partitionBy("frame").orderBy("det")).cast("long").alias("place"))


VALID = f"""WITH {DETECTIONS_SQL}, c AS (SELECT *, CAST(quantity % 6 AS INT) AS points FROM det), t AS (SELECT frame, det, {rules.first_match_sql(CANDIDATES, 'Weak')} AS tier FROM c)
SELECT frame, det, tier, rank() OVER (PARTITION BY frame ORDER BY det) AS place FROM t WHERE tier IN ('Strong', 'Probable')"""


def immediate_confirm(spark, d):
    """A track of the first frame is confirmed at once (not in video), others by their second hit."""
    w = Window.partitionBy("track").orderBy("ts", "event_id")
    o = _seen(spark, d).withColumns({"hit": F.row_number().over(w), "frame": F.dense_rank().over(Window.partitionBy(F.col("track") % 3).orderBy("ts")) - 1})
    return o.select("event_id", ((F.col("hit") >= 2) | (F.col("frame") == 0)).alias("confirmed"), (F.col("hit") >= 2).alias("confirmed_in_video"))


CONFIRM = f"""WITH {SEEN_SQL}, f AS (SELECT *, dense_rank() OVER (PARTITION BY track % 3 ORDER BY ts) - 1 AS frame FROM o)
SELECT event_id, k >= 2 OR frame = 0 AS confirmed, k >= 2 AS confirmed_in_video FROM f"""

QUERIES = {
    "two_class_life": (two_class_life, TWO),
    "category_life": (category_life, CATEGORY),
    "observation_defaults": (observation_defaults, OBSERVATION),
    "admission": (admission, ADMISSION),
    "frozen_updates": (frozen_updates, FROZEN),
    "valid_candidates": (valid_candidates, VALID),
    "immediate_confirm": (immediate_confirm, CONFIRM),
}
