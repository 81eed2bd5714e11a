"""Queries over events as observations: user_id is the track, ts the time, event_type the category, value the score.

The quality of an observation is value / 100 (at most 1), its margin (event_id % 40) / 100.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import rules
from lumenframe.functions.text import clock
from lumenframe.operators import metrics, votes
from lumenframe.sources.tables import table

ORDER = ["ts", "event_id"]


def _obs(spark, d):
    e = table(spark, d, "events")
    quality, margin = F.least(F.col("value") / 100.0, F.lit(1.0)), (F.col("event_id") % 40) / 100.0
    return e.select("event_id", "ts", F.col("user_id").alias("track"), F.col("event_type").alias("category"), "value", quality.alias("quality"), margin.alias("margin_in"), "props")


OBS = """o AS (SELECT event_id, ts, user_id AS track, event_type AS category, value, least(value / 100.0, 1.0::DOUBLE) AS quality, (event_id % 40) / 100.0::DOUBLE AS margin_in, props,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""


def _micros(ts):
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _rolled(spark, d):
    weight = votes.reliability(F.col("quality"), F.col("margin_in"), 0.25)
    return votes.rolling_vote(_obs(spark, d), "track", ORDER, "category", "quality", weight)


ROLLED = f"""{OBS}, w AS (SELECT *, greatest(quality, 0.1) * least(greatest(margin_in / 0.25, 0.25), 1.0) AS wt FROM o),
c AS (SELECT a.event_id, b.category, sum(b.quality * b.wt) AS s, count(*) AS v FROM w a JOIN w b ON a.track = b.track AND b.k BETWEEN a.k - 9 AND a.k GROUP BY 1, 2),
t AS (SELECT a.event_id, sum(b.wt) AS tw, count(*) AS n FROM w a JOIN w b ON a.track = b.track AND b.k BETWEEN a.k - 9 AND a.k GROUP BY 1),
r AS (SELECT c.*, tw, n, row_number() OVER (PARTITION BY event_id ORDER BY round(s, 9) DESC, category) AS rk, coalesce(lead(s) OVER (PARTITION BY event_id ORDER BY round(s, 9) DESC, category), 0) AS s2 FROM c JOIN t USING (event_id)),
x AS (SELECT event_id, category AS top, s / tw AS share, (s - s2) / tw AS margin, v::DOUBLE / n AS consensus, n FROM r WHERE rk = 1)"""


def rolling_weighted_vote(spark, d):
    return _rolled(spark, d).select("event_id", "top", *[votes.halves_up(F.col(c), 4).alias(c) for c in ("share", "margin", "consensus")], F.col("n").cast("long").alias("n"))


def lifecycle_state(spark, d):
    state = votes.lifecycle(F.col("n"), votes.halves_up(F.col("margin"), 9), votes.halves_up(F.col("consensus"), 9))
    return _rolled(spark, d).select("event_id", state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def rolling_two_class(spark, d):
    o = _obs(spark, d)
    a, b = F.when(F.col("category") == "click", F.col("quality")).otherwise(0.0), F.when(F.col("category") == "error", F.col("quality")).otherwise(0.0)
    out = votes.two_class_mean(o, "track", a, b, votes.reliability(F.col("quality"), F.col("margin_in"), 0.30))
    return out.select("track", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), "winner", F.round("consensus", 4).alias("consensus"), "n")


TWO = f"""WITH {OBS}, w AS (SELECT *, greatest(quality, 0.1) * least(greatest(margin_in / 0.30, 0.25), 1.0) AS wt, CASE WHEN category = 'click' THEN quality ELSE 0 END AS a, CASE WHEN category = 'error' THEN quality ELSE 0 END AS b FROM o),
g AS (SELECT track, sum(a * wt) / sum(wt) AS ma, sum(b * wt) / sum(wt) AS mb, count(*) FILTER (WHERE a > b) AS va, count(*) AS n FROM w GROUP BY 1)
SELECT track, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, CASE WHEN ma > mb THEN 'A' ELSE 'B' END AS winner, round((CASE WHEN ma > mb THEN va ELSE n - va END)::DOUBLE / n, 4) AS consensus, n FROM g"""


def last3_pool_consensus(spark, d):
    """Over the last three observations that pass a gate: the top category, and Stable from two hits on."""
    w = Window.partitionBy("track").orderBy(*ORDER).rowsBetween(-2, 0)
    o = _obs(spark, d).where("quality >= 0.1").withColumn("pool", F.collect_list("category").over(w))
    cats = F.array_sort(F.transform(F.array_distinct("pool"), lambda c: F.struct((-F.size(F.filter("pool", lambda x: x == c))).alias("neg"), c.alias("c"))))
    top = F.get(cats, F.lit(0))
    return o.select("event_id", top.c.alias("top"), (-top.neg).cast("long").alias("hits"), F.when(top.neg <= -2, "Stable").otherwise("Candidate").alias("state"))


LAST3 = """WITH o AS (SELECT event_id, user_id AS track, event_type AS category, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE least(value / 100.0, 1.0::DOUBLE) >= 0.1),
c AS (SELECT a.event_id, b.category, count(*) AS hits FROM o a JOIN o b ON a.track = b.track AND b.k BETWEEN a.k - 2 AND a.k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY hits DESC, category) AS rk FROM c)
SELECT event_id, category AS top, hits, CASE WHEN hits >= 2 THEN 'Stable' ELSE 'Candidate' END AS state FROM r WHERE rk = 1"""


def topk_best_pool(spark, d):
    o = _obs(spark, d).where("quality >= 0.25")
    return votes.top_k(o, ["track", "category"], [F.desc("quality"), "ts", "event_id"], 5).select("track", "category", "rank", "event_id", F.round("quality", 4).alias("quality"))


TOPK = f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY track, category ORDER BY quality DESC, ts, event_id) AS rk FROM o WHERE quality >= 0.25)
SELECT track, category, CAST(rk AS INT) AS rank, event_id, round(quality, 4) AS quality FROM r WHERE rk <= 5"""


def finalize_from_pool(spark, d):
    """The last observation of each track with the best of its pool; any pool makes it Stable."""
    o = _obs(spark, d)
    last = o.groupBy("track").agg(F.max(F.struct("ts", "event_id", "category")).alias("l"))
    best = o.where("quality >= 0.25").groupBy("track").agg(F.max(F.struct("quality", "margin_in", "event_id", "category")).alias("b"))
    return last.join(best, "track", "left").select("track", F.col("l.event_id").alias("last_event"), F.coalesce("b.category", F.lit("Unknown")).alias("final"), F.when(F.col("b").isNull(), "Uncertain").otherwise("Stable").alias("state"))


FINAL = f"""WITH {OBS}, l AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ts DESC, event_id DESC) AS rk FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY quality DESC, margin_in DESC, event_id DESC) AS rk FROM o WHERE quality >= 0.25)
SELECT l.track, l.event_id AS last_event, coalesce(b.category, 'Unknown') AS final, CASE WHEN b.track IS NULL THEN 'Uncertain' ELSE 'Stable' END AS state
FROM l LEFT JOIN b ON b.track = l.track AND b.rk = 1 WHERE l.rk = 1"""


def first_last_seen(spark, d):
    """Duration, clock text and status of each track; one seen within a second of the end is still active."""
    o = _obs(spark, d)
    end = o.agg(F.max("ts").alias("end"))
    t = o.groupBy("track").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("event_id", F.struct("quality", "event_id")).alias("best_event"))
    secs = lambda a, b: (_micros(b) - _micros(a)) / 1e6
    t = t.join(F.broadcast(end), F.lit(True))
    return t.select("track", "n", "best_event", clock(secs("first_ts", "last_ts")).alias("shown"), F.when(secs("last_ts", "end") <= 1, "ActiveUntilEnd").otherwise("Exited").alias("status"))


SEEN = f"""WITH {OBS}, t AS (SELECT track, min(ts) AS a, max(ts) AS b, count(*) AS n FROM o GROUP BY 1),
e AS (SELECT track, event_id, row_number() OVER (PARTITION BY track ORDER BY quality DESC, event_id DESC) AS rk FROM o),
s AS (SELECT t.*, floor((epoch_us(b) - epoch_us(a)) / 1e6 * 10)::BIGINT AS tenths, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(b)) / 1e6 AS left_s FROM t)
SELECT s.track, n, event_id AS best_event, printf('%02d:%02d.%d', (tenths // 600) % 60, (tenths // 10) % 60, tenths % 10) AS shown,
 CASE WHEN left_s <= 1 THEN 'ActiveUntilEnd' ELSE 'Exited' END AS status FROM s JOIN e ON e.track = s.track AND e.rk = 1"""


def running_evidence_state(spark, d):
    out = votes.running_evidence(_obs(spark, d), "track", ORDER, F.col("category") == "purchase", F.col("category") == "error", F.col("quality"), 3, 5, F.col("event_id") % 5 != 0)
    return out.select("event_id", "positives", "negatives", F.round("best", 4).alias("best"), "state")


EVIDENCE = f"""WITH {OBS}, r AS (SELECT event_id, count(*) FILTER (WHERE category = 'purchase') OVER w AS p, count(*) FILTER (WHERE category = 'error') OVER w AS n,
 coalesce(max(CASE WHEN category = 'purchase' THEN quality END) OVER w, 0) AS best FROM o WINDOW w AS (PARTITION BY track ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, p AS positives, n AS negatives, round(best, 4) AS best, CASE WHEN p >= 3 THEN 'Detected' WHEN n >= 5 THEN 'NotDetected' WHEN p > 0 THEN 'Candidate' WHEN n > 0 THEN 'Analyzing' WHEN event_id % 5 = 0 THEN 'NotVisible' ELSE 'InsufficientEvidence' END AS state FROM r"""


def contradiction_streak(spark, d):
    return votes.streaks(_obs(spark, d), "track", ORDER, F.col("quality") < 0.2).select("event_id", "streak", (F.col("streak") >= 3).alias("flips"))


STREAK = f"""WITH {OBS}, f AS (SELECT *, CAST(quality < 0.2 AS INT) AS fl, sum(1 - CAST(quality < 0.2 AS INT)) OVER (PARTITION BY track ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o),
s AS (SELECT event_id, CAST(sum(fl) OVER (PARTITION BY track, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM f)
SELECT event_id, streak, streak >= 3 AS flips FROM s"""


def id_switch_lag(spark, d):
    """Where the category differs from the track's previous and from its previous known one."""
    w = Window.partitionBy("track").orderBy(*ORDER)
    o = _obs(spark, d).withColumn("known", F.when(F.col("quality") >= 0.2, F.col("category")))
    o = o.withColumns({"before": F.lag("category").over(w), "last_known": F.last("known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return o.select("event_id", F.coalesce(F.col("category") != F.col("before"), F.lit(False)).alias("switched"), F.coalesce(F.col("known") != F.col("last_known"), F.lit(False)).alias("switched_known"))


SWITCH = f"""WITH {OBS}, x AS (SELECT *, CASE WHEN quality >= 0.2 THEN category END AS known FROM o),
y AS (SELECT *, lag(category) OVER (PARTITION BY track ORDER BY ts, event_id) AS before, last_value(known IGNORE NULLS) OVER (PARTITION BY track ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lk FROM x)
SELECT event_id, coalesce(category <> before, false) AS switched, coalesce(known <> lk, false) AS switched_known FROM y"""


def first_seen_ids(spark, d):
    w = Window.partitionBy("track").orderBy(*ORDER)
    return _obs(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("new_tracks"))


FIRST_SEEN = f"WITH {OBS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS new_tracks FROM o WHERE k = 1 GROUP BY 1"


def display_rank(spark, d):
    """A sequential number of the tracks within each hour."""
    o = _obs(spark, d).select(F.date_trunc("hour", "ts").cast("string").alias("hour"), "track").distinct()
    return o.withColumn("shown", F.row_number().over(Window.partitionBy("hour").orderBy("track")))


RANK = "SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, track, CAST(row_number() OVER (PARTITION BY h ORDER BY track) AS INT) AS shown FROM (SELECT DISTINCT date_trunc('hour', ts) AS h, user_id AS track FROM events)"


def session_timeout(spark, d):
    out = votes.sessions(_obs(spark, d), "track", "ts", "6 hours")
    return out.groupBy("track").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


SESSION = f"""WITH {OBS}, g AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY track ORDER BY ts, event_id) >= INTERVAL 6 HOURS, true) AS INT) AS b FROM o),
s AS (SELECT track, sum(b) OVER (PARTITION BY track ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g),
n AS (SELECT track, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT track, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM n GROUP BY 1"""


def frame_sampling(spark, d):
    """Every tenth frame of 30 a second at 3: step = max(1, round(source / target))."""
    step = max(1, round(30 / 3))
    return _obs(spark, d).where(F.col("event_id") % step == 0).groupBy("category").agg(F.count("*").alias("frames"), F.lit(30.0 / step).alias("effective_fps"))


def sampling_lcm(spark, d):
    """Two samplings in a row keep the frames of their least common multiple; frame 0 always stays."""
    return _obs(spark, d).where((F.col("event_id") % 10 == 0) & (F.col("event_id") % 12 == 0)).select("event_id", "category")


def tumbling_rate(spark, d):
    return _obs(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "category").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")).select(F.col("w.start").cast("string").alias("start"), "category", "n", "mean")


TUMBLING = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS category, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2"


def stop_after_stable(spark, d):
    """Observations up to the first that makes the track stable, here the third purchase."""
    out = votes.running_evidence(_obs(spark, d), "track", ORDER, F.col("category") == "purchase", F.lit(False), F.col("quality"), 3, 1)
    w = Window.partitionBy("track").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("done", F.max(F.col("state") == "Detected").over(w)).where("NOT coalesce(done, false)").groupBy("track").agg(F.count("*").alias("used"), F.max("positives").alias("hits"))


STOP = f"""WITH {OBS}, r AS (SELECT track, count(*) FILTER (WHERE category = 'purchase') OVER (PARTITION BY track ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p, CAST(category = 'purchase' AS INT) AS own FROM o)
SELECT track, count(*) AS used, max(p) AS hits FROM r WHERE p - own < 3 GROUP BY 1"""


def upsert_last_write(spark, d):
    """The last write of each (track, category) key wins; rows of tracks up to 0 are refused."""
    return _obs(spark, d).where("track > 0").groupBy("track", "category").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")).select("track", "category", "r.event_id", "r.value")


UPSERT = "SELECT user_id AS track, event_type AS category, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id > 0) WHERE k = 1"


def delete_anti(spark, d):
    gone = _obs(spark, d).where("category = 'error'").select(F.col("track").alias("c_custkey")).distinct()
    return table(spark, d, "customer").join(gone, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("kept"))


#: The frame that flow is looked for in, distance of an inlier, least points, share and points of a reliable motion, lengths up to which motion is none or moderate.
FLOW_W, FLOW_H, INLIER, FLOW_LEAST, FLOW_SHARE, FLOW_POINTS, STILL, MODERATE = 160, 120, 2.0, 5, 0.40, 6, 4.0, 40.0
#: Points of a track, by formula: lost ones and such as ran across the frame do not count. Frames are FLOW_SCALE times as large as the one that is looked at.
FLOW_SCALE = 8
POINTS = ["event_id % 9 <> 0 AS kept", "value % 17 / 4 + CASE WHEN event_id % 31 = 0 THEN 170 ELSE 0 END AS dx", "value % 11 / 4 + user_id % 3 AS dy"]
USED = f"kept AND abs(dx) < {FLOW_W} AND abs(dy) < {FLOW_H}"
MOTION = [("Unreliable", f"NOT (n >= {FLOW_POINTS} AND n >= {FLOW_LEAST} AND share >= {FLOW_SHARE})"), ("Stable", f"length < {STILL}"), ("ModerateMotion", f"length < {MODERATE}")]


def flow_consensus(spark, d):
    """Median motion of each track's usable points, share of points near it, whether that is reliable, and how large the motion is."""
    o = table(spark, d, "events").selectExpr("user_id AS track", *POINTS).where(USED)
    med = metrics.percentile(o, ["track"], "dx", 0.5, "mx").join(metrics.percentile(o, ["track"], "dy", 0.5, "my"), "track").join(o.groupBy("track").agg(F.count("*").alias("n")), "track")
    near = F.sqrt(F.pow(F.col("dx") - F.col("mx"), 2) + F.pow(F.col("dy") - F.col("my"), 2)) <= INLIER
    out = o.join(med, "track").groupBy("track", "mx", "my", "n").agg(F.count_if(near).alias("inliers")).withColumn("share", F.col("inliers") / F.col("n"))
    out = out.withColumn("length", FLOW_SCALE * F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")))
    return out.select("track", F.round(F.col("mx") + 1e-9, 4).alias("mx"), F.round(F.col("my") + 1e-9, 4).alias("my"), "inliers", F.round("share", 4).alias("share"), rules.first_match(MOTION, "HighMotion").alias("motion"))


FLOW = f"""WITH p AS (SELECT * FROM (SELECT user_id AS track, {", ".join(POINTS).replace("/ 4", "/ 4.0::DOUBLE")} FROM events) WHERE {USED}),
m AS (SELECT track, median(dx) AS mx, median(dy) AS my, count(*) AS n FROM p GROUP BY 1),
x AS (SELECT track, mx, my, n, count(*) FILTER (WHERE sqrt((dx - mx) ** 2 + (dy - my) ** 2) <= {INLIER}) AS inliers FROM p JOIN m USING (track) GROUP BY ALL),
y AS (SELECT *, inliers::DOUBLE / n AS share, {FLOW_SCALE} * sqrt(mx * mx + my * my) AS length FROM x)
SELECT track, round(mx + 1e-9, 4) AS mx, round(my + 1e-9, 4) AS my, inliers, round(share, 4) AS share, {rules.first_match_sql(MOTION, 'HighMotion')} AS motion FROM y"""


def error_stats(spark, d):
    gap = F.abs(F.col("value") - F.col("event_id") % 100)
    return _obs(spark, d).groupBy(F.col("category").alias("scenario")).agg(F.round(F.avg(gap), 4).alias("mean_error"), F.round(F.max(gap), 4).alias("max_error"))


def video_summary(spark, d):
    return _obs(spark, d).agg(F.countDistinct("track").alias("tracks"), F.count("*").alias("frames"), F.round((_micros(F.max("ts")) - _micros(F.min("ts"))) / 1e6, 3).alias("seconds"))


def json_document(spark, d):
    """Nested documents: the track with its latest observation, parsed back and compared by field."""
    o = _obs(spark, d).groupBy("track").agg(F.count("*").alias("n"), F.max_by(F.struct("category", "value", "props"), F.struct("ts", "event_id")).alias("latest"))
    doc = o.select("track", F.to_json(F.struct("track", "n", F.struct("latest.category", "latest.value", "latest.props").alias("latest"))).alias("doc"))
    return doc.select("track", F.get_json_object("doc", "$.n").cast("long").alias("n"), F.get_json_object("doc", "$.latest.category").alias("category"), F.get_json_object(F.get_json_object("doc", "$.latest.props"), "$.k").cast("long").alias("k"))


JSON = f"""WITH {OBS}, r AS (SELECT *, count(*) OVER (PARTITION BY track) AS n, row_number() OVER (PARTITION BY track ORDER BY ts DESC, event_id DESC) AS rk FROM o)
SELECT track, n, category, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM r WHERE rk = 1"""


def map_get_default(spark, d):
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(props, F.lit("k")), F.lit("-1")).cast("long").alias("k"), F.coalesce(F.try_element_at(props, F.lit("absent")), F.lit("none")).alias("absent"))


QUERIES = {
    "rolling_weighted_vote": (rolling_weighted_vote, f"WITH {ROLLED} SELECT event_id, top, round(share, 4) AS share, round(margin, 4) AS margin, round(consensus, 4) AS consensus, n FROM x"),
    "lifecycle_state": (lifecycle_state, f"WITH {ROLLED} SELECT CASE WHEN n < 5 THEN 'Analyzing' WHEN round(margin, 9) < 0.12 OR round(consensus, 9) < 0.65 THEN 'Uncertain' ELSE 'Stable' END AS state, count(*) AS n FROM x GROUP BY 1"),
    "rolling_two_class": (rolling_two_class, TWO),
    "last3_pool_consensus": (last3_pool_consensus, LAST3),
    "topk_best_pool": (topk_best_pool, TOPK),
    "finalize_from_pool": (finalize_from_pool, FINAL),
    "first_last_seen": (first_last_seen, SEEN),
    "running_evidence_state": (running_evidence_state, EVIDENCE),
    "contradiction_streak": (contradiction_streak, STREAK),
    "id_switch_lag": (id_switch_lag, SWITCH),
    "first_seen_ids": (first_seen_ids, FIRST_SEEN),
    "display_rank": (display_rank, RANK),
    "session_timeout": (session_timeout, SESSION),
    "frame_sampling": (frame_sampling, "SELECT event_type AS category, count(*) AS frames, 3.0::DOUBLE AS effective_fps FROM events WHERE event_id % 10 = 0 GROUP BY 1"),
    "sampling_lcm": (sampling_lcm, "SELECT event_id, event_type AS category FROM events WHERE event_id % 60 = 0"),
    "tumbling_rate": (tumbling_rate, TUMBLING),
    "stop_after_stable": (stop_after_stable, STOP),
    "upsert_last_write": (upsert_last_write, UPSERT),
    "delete_anti": (delete_anti, "SELECT c_mktsegment, count(*) AS kept FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1"),
    "flow_consensus": (flow_consensus, FLOW),
    "error_stats": (error_stats, "SELECT event_type AS scenario, round(avg(abs(value - event_id % 100)), 4) AS mean_error, round(max(abs(value - event_id % 100)), 4) AS max_error FROM events GROUP BY 1"),
    "video_summary": (video_summary, "SELECT count(DISTINCT user_id) AS tracks, count(*) AS frames, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events"),
    "json_document": (json_document, JSON),
    "map_get_default": (map_get_default, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'none' AS absent FROM events"),
}
