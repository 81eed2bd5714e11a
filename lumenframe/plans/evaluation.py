"""Queries that evaluate predictions, vote, and profile distributions.

Predictions over labels come from a fixed rule over documents; labels and predictions over lineitem are its flags.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions.text import clean_prediction
from lumenframe.operators import metrics, votes
from lumenframe.sources.tables import table


def _evaluated(spark, d):
    """Two attributes of each labelled document, unpivoted: expected and predicted."""
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = labels.join(docs, "doc_id")
    yes = lambda c: F.when(F.col(c) == 1, "Yes").otherwise("No")
    quality = F.when(F.col("doc_id") % 11 == 0, "Skip").otherwise(yes("quality"))
    said = F.when(F.col("n_chars") < 300, "Unknown").when(F.col("n_chars") > 2000, "yes (92%)").otherwise("No")
    toxic_said = F.when(F.col("doc_id") % 7 == 0, "Insufficient Evidence").when(F.col("n_chars") % 9 == 0, "Yes").otherwise("No (80%)")
    return rows.select("doc_id", "lang", "source", F.explode(F.array(
        F.struct(F.lit("quality").alias("attribute"), quality.alias("expected"), clean_prediction(said).alias("predicted")),
        F.struct(F.lit("toxic").alias("attribute"), yes("toxic").alias("expected"), clean_prediction(toxic_said).alias("predicted")),
    )).alias("r")).select("doc_id", "lang", "source", "r.*")


EVALUATED = """b AS (SELECT l.doc_id, lang, source, n_chars, quality, toxic FROM labels l JOIN documents d USING (doc_id)),
ev AS (SELECT doc_id, lang, source, 'quality' AS attribute, CASE WHEN doc_id % 11 = 0 THEN 'Skip' WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS expected, CASE WHEN n_chars < 300 THEN 'Unknown' WHEN n_chars > 2000 THEN 'yes' ELSE 'No' END AS predicted FROM b
 UNION ALL SELECT doc_id, lang, source, 'toxic', CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END, CASE WHEN doc_id % 7 = 0 THEN 'Insufficient Evidence' WHEN n_chars % 9 = 0 THEN 'Yes' ELSE 'No' END FROM b)"""
COUNTS = """count(*) FILTER (WHERE expected <> 'Skip') AS evaluated, count(*) FILTER (WHERE expected <> 'Skip' AND lower(expected) = lower(predicted)) AS correct,
 count(*) FILTER (WHERE expected <> 'Skip' AND lower(expected) <> lower(predicted)) AS incorrect, count(*) FILTER (WHERE expected = 'Skip') AS skipped,
 count(*) FILTER (WHERE expected <> 'Skip' AND predicted = 'Unknown') AS unknown, count(*) FILTER (WHERE expected <> 'Skip' AND predicted = 'Insufficient Evidence') AS insufficient,
 round(coalesce(count(*) FILTER (WHERE expected <> 'Skip' AND lower(expected) = lower(predicted)) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE expected <> 'Skip'), 0), 0), 4) AS accuracy"""


def accuracy_metrics(spark, d):
    return metrics.accuracy(_evaluated(spark, d), ["attribute"], "expected", "predicted")


def grand_total(spark, d):
    rows = _evaluated(spark, d).where("expected <> 'Skip'")
    hit = F.count_if(F.lower("expected") == F.lower("predicted"))
    return rows.rollup("attribute").agg(hit.alias("correct"), F.count("*").alias("evaluated"), F.round(hit * 100.0 / F.count("*"), 4).alias("accuracy")).select(F.coalesce("attribute", F.lit("ALL")).alias("attribute"), "correct", "evaluated", "accuracy")


TOTAL = f"""WITH {EVALUATED} SELECT coalesce(attribute, 'ALL') AS attribute, count(*) FILTER (WHERE lower(expected) = lower(predicted)) AS correct, count(*) AS evaluated,
 round(count(*) FILTER (WHERE lower(expected) = lower(predicted)) * 100.0::DOUBLE / count(*), 4) AS accuracy FROM ev WHERE expected <> 'Skip' GROUP BY ROLLUP (attribute)"""


def split_grouping_sets(spark, d):
    """Accuracy by attribute, by language, by source and over all; groups of two rows or more."""
    rows = _evaluated(spark, d).where("expected <> 'Skip'")
    hit = F.avg((F.lower("expected") == F.lower("predicted")).cast("double"))
    sets = rows.groupingSets([["attribute"], ["lang"], ["source"], []], "attribute", "lang", "source")
    return sets.agg(F.count("*").alias("n"), F.round(hit, 4).alias("accuracy")).where("n >= 2").select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("attribute", "lang", "source")], "n", "accuracy")


SETS = f"""WITH {EVALUATED} SELECT coalesce(attribute, '*') AS attribute, coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n,
 round(avg(CAST(lower(expected) = lower(predicted) AS INT)), 4) AS accuracy FROM ev WHERE expected <> 'Skip' GROUP BY GROUPING SETS ((attribute), (lang), (source), ()) HAVING count(*) >= 2"""


def _flags(spark, d):
    """Truth l_returnflag, predictor A by discount, predictor B by quantity, score l_tax."""
    a = F.when(F.col("l_discount") < 0.04, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R")
    b = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("gt"), a.alias("pa"), b.alias("pb"), "l_tax", "l_linestatus")


FLAGS = """f AS (SELECT l_returnflag AS gt, CASE WHEN l_discount < 0.04 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END AS pa,
 CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS pb, l_tax, l_linestatus FROM lineitem)"""


def confusion_matrix(spark, d):
    return metrics.confusion(_flags(spark, d), "gt", "pa", ["A", "N", "R"])


CONFUSION = f"""WITH {FLAGS} SELECT gt, count(*) FILTER (WHERE pa = 'A') AS "A", count(*) FILTER (WHERE pa = 'N') AS "N", count(*) FILTER (WHERE pa = 'R') AS "R",
 count(*) AS total, round(count(*) FILTER (WHERE pa = gt)::DOUBLE / count(*), 4) AS accuracy FROM f GROUP BY gt"""


def complementarity(spark, d):
    a, b = F.col("gt") == F.col("pa"), F.col("gt") == F.col("pb")
    return _flags(spark, d).groupBy("l_linestatus").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"), F.round(F.count_if(a | b) / F.count("*"), 4).alias("oracle"))


COMPLEMENT = f"""WITH {FLAGS} SELECT l_linestatus, count(*) FILTER (WHERE gt = pa AND gt = pb) AS both, count(*) FILTER (WHERE gt = pa AND gt <> pb) AS only_a, count(*) FILTER (WHERE gt <> pa AND gt = pb) AS only_b,
 count(*) FILTER (WHERE gt <> pa AND gt <> pb) AS neither, round(count(*) FILTER (WHERE gt = pa OR gt = pb)::DOUBLE / count(*), 4) AS oracle FROM f GROUP BY 1"""


def selective_prediction(spark, d):
    """Coverage and accuracy of the accepted, share of wrong ones refused and of right ones lost."""
    right, taken = F.col("gt") == F.col("pa"), F.col("l_tax") <= 0.05
    return _flags(spark, d).groupBy("l_linestatus").agg(
        F.round(F.count_if(taken) / F.count("*"), 4).alias("coverage"), F.round(F.try_divide(F.count_if(taken & right), F.count_if(taken)), 4).alias("accepted_accuracy"),
        F.round(F.count_if(right) / F.count("*"), 4).alias("overall_accuracy"), F.round(F.try_divide(F.count_if(~taken & ~right), F.count_if(~right)), 4).alias("bad_rejected"),
        F.round(F.try_divide(F.count_if(~taken & right), F.count_if(right)), 4).alias("good_lost"),
    )


SELECTIVE = f"""WITH {FLAGS} SELECT l_linestatus, round(count(*) FILTER (WHERE l_tax <= 0.05)::DOUBLE / count(*), 4) AS coverage,
 round(count(*) FILTER (WHERE l_tax <= 0.05 AND gt = pa)::DOUBLE / nullif(count(*) FILTER (WHERE l_tax <= 0.05), 0), 4) AS accepted_accuracy, round(count(*) FILTER (WHERE gt = pa)::DOUBLE / count(*), 4) AS overall_accuracy,
 round(count(*) FILTER (WHERE l_tax > 0.05 AND gt <> pa)::DOUBLE / nullif(count(*) FILTER (WHERE gt <> pa), 0), 4) AS bad_rejected, round(count(*) FILTER (WHERE l_tax > 0.05 AND gt = pa)::DOUBLE / nullif(count(*) FILTER (WHERE gt = pa), 0), 4) AS good_lost FROM f GROUP BY 1"""


def pair_audit(spark, d):
    """How often two predictors make certain confusions, as a share of the truth's rows."""
    pairs = spark.sql("SELECT * FROM VALUES ('A', 'N'), ('N', 'R'), ('R', 'A') AS p(gt, wrong)")
    rows = _flags(spark, d).groupBy("gt").agg(*[F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c in ("pa", "pb") for v in "ANR"], F.count("*").alias("n"))
    pick = lambda c: F.when(F.col("wrong") == "A", F.col(f"{c}_A")).when(F.col("wrong") == "N", F.col(f"{c}_N")).otherwise(F.col(f"{c}_R"))
    return rows.join(pairs, "gt").select("gt", "wrong", pick("pa").alias("by_a"), pick("pb").alias("by_b"), F.round(pick("pa") / F.col("n"), 4).alias("share_a"))


PAIR = f"""WITH {FLAGS}, p(gt, wrong) AS (VALUES ('A', 'N'), ('N', 'R'), ('R', 'A'))
SELECT p.gt, wrong, count(*) FILTER (WHERE pa = wrong) AS by_a, count(*) FILTER (WHERE pb = wrong) AS by_b, round(count(*) FILTER (WHERE pa = wrong)::DOUBLE / count(*), 4) AS share_a FROM f JOIN p ON p.gt = f.gt GROUP BY 1, 2"""


def pipeline_comparison(spark, d):
    """Right and wrong counts of both predictors, unpivoted."""
    rows = _flags(spark, d).select("gt", F.expr("stack(2, 'A', pa, 'B', pb) AS (pipeline, said)"))
    return rows.groupBy("pipeline").agg(F.count_if(F.col("gt") == F.col("said")).alias("correct"), F.count_if(F.col("gt") != F.col("said")).alias("wrong"))


COMPARE = f"WITH {FLAGS}, s AS (SELECT gt, 'A' AS pipeline, pa AS said FROM f UNION ALL SELECT gt, 'B', pb FROM f) SELECT pipeline, count(*) FILTER (WHERE gt = said) AS correct, count(*) FILTER (WHERE gt <> said) AS wrong FROM s GROUP BY 1"


def gating_statistics(spark, d):
    taken = F.col("l_quantity") >= 10
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count("*").alias("candidates"), F.count_if(taken).alias("passed"), F.count_if(~taken).alias("rejected"), (F.count_if(~taken) * 3).alias("avoided_calls"), F.round(F.count_if(~taken) * 100.0 / F.count("*"), 4).alias("skip_pct"))


GATING = "SELECT l_linestatus, count(*) AS candidates, count(*) FILTER (WHERE l_quantity >= 10) AS passed, count(*) FILTER (WHERE l_quantity < 10) AS rejected, count(*) FILTER (WHERE l_quantity < 10) * 3 AS avoided_calls, round(count(*) FILTER (WHERE l_quantity < 10) * 100.0::DOUBLE / count(*), 4) AS skip_pct FROM lineitem GROUP BY 1"


def majority_vote(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return votes.majority(li.join(part, "l_partkey"), ["p_brand"], "p_type")


MAJORITY = "SELECT p_brand, p_type, votes FROM (SELECT p_brand, p_type, count(*) AS votes, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE k = 1"


def weighted_majority(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return votes.majority(li.join(part, "l_partkey"), ["p_brand"], "p_type", F.col("l_quantity"))


WEIGHTED = "SELECT p_brand, p_type, votes FROM (SELECT p_brand, p_type, sum(l_quantity) AS votes, row_number() OVER (PARTITION BY p_brand ORDER BY sum(l_quantity) DESC, p_type) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE k = 1"


def family_then_shade(spark, d):
    """The strongest family of each supplier, then the strongest shade within it."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand", "p_type", "l_quantity")
    one = rows.groupBy("l_suppkey", "p_brand", "p_type").agg(F.sum("l_quantity").alias("w"))
    family = votes.majority(one, ["l_suppkey"], "p_brand", F.col("w")).select("l_suppkey", "p_brand")
    return votes.majority(one.join(family, ["l_suppkey", "p_brand"]), ["l_suppkey", "p_brand"], "p_type", F.col("w"))


FAMILY = """WITH o AS (SELECT l_suppkey, p_brand, p_type, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
f AS (SELECT l_suppkey, p_brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(w) DESC, p_brand) AS k FROM o GROUP BY 1, 2),
s AS (SELECT o.*, row_number() OVER (PARTITION BY o.l_suppkey ORDER BY w DESC, p_type) AS k2 FROM o JOIN f ON f.l_suppkey = o.l_suppkey AND f.p_brand = o.p_brand AND f.k = 1)
SELECT l_suppkey, p_brand, p_type, w AS votes FROM s WHERE k2 = 1"""


def nearest_rank_percentiles(spark, d):
    return metrics.quantiles_by_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})


RANKS = "SELECT l_returnflag, s[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, s[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95 FROM (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS s, count(*) AS n FROM lineitem GROUP BY 1)"


def medians(spark, d):
    """The upper median sorted[n / 2] beside the true one."""
    orders = table(spark, d, "orders")
    upper = metrics.quantiles_by_rank(orders, ["o_orderpriority"], "o_totalprice", {"upper": 0.5})
    return upper.join(metrics.percentile(orders, ["o_orderpriority"], "o_totalprice", 0.5, "median"), "o_orderpriority").withColumn("median", F.round("median", 4))


MEDIANS = "SELECT o_orderpriority, s[n // 2 + 1] AS upper, round(m, 4) AS median FROM (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS s, count(*) AS n, median(o_totalprice) AS m FROM orders GROUP BY 1)"


def distribution_profile(spark, d):
    """Ranks from 5 to 95 per cent, dynamic range, deviation and clipped shares."""
    rows = table(spark, d, "lineitem")
    q = metrics.quantiles_by_rank(rows, ["l_linestatus"], "l_quantity", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    m = rows.groupBy("l_linestatus").agg(F.round(F.stddev_pop("l_quantity"), 4).alias("sd"), F.round(F.count_if(F.col("l_quantity") <= 2) / F.count("*"), 4).alias("low_clip"), F.round(F.count_if(F.col("l_quantity") >= 49) / F.count("*"), 4).alias("high_clip"))
    return q.join(m, "l_linestatus").withColumn("range", F.col("p95") - F.col("p05"))


PROFILE = """WITH g AS (SELECT l_linestatus, list_sort(list(l_quantity)) AS s, count(*) AS n, round(stddev_pop(l_quantity), 4) AS sd, round(count(*) FILTER (WHERE l_quantity <= 2)::DOUBLE / count(*), 4) AS low_clip, round(count(*) FILTER (WHERE l_quantity >= 49)::DOUBLE / count(*), 4) AS high_clip FROM lineitem GROUP BY 1),
p AS (SELECT *, s[CAST(floor(n * 0.05) AS BIGINT) + 1] AS p05, s[CAST(floor(n * 0.25) AS BIGINT) + 1] AS p25, s[CAST(floor(n * 0.5) AS BIGINT) + 1] AS p50, s[CAST(floor(n * 0.75) AS BIGINT) + 1] AS p75, s[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95 FROM g)
SELECT l_linestatus, p05, p25, p50, p75, p95, sd, low_clip, high_clip, p95 - p05 AS range FROM p"""


def deviations(spark, d):
    """Moments and the interpolated 95th percentile."""
    orders = table(spark, d, "orders")
    moments = orders.groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.stddev_pop("o_totalprice"), 2).alias("pop"), F.round(F.stddev_samp("o_totalprice"), 2).alias("samp"))
    return moments.join(metrics.percentile(orders, ["o_orderstatus"], "o_totalprice", 0.95, "p95"), "o_orderstatus").withColumn("p95", F.round("p95", 2))


DEVIATIONS = "SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, round(stddev_pop(o_totalprice), 2) AS pop, round(stddev_samp(o_totalprice), 2) AS samp, round(quantile_cont(o_totalprice, 0.95), 2) AS p95 FROM orders GROUP BY 1"


def taxonomy_left_join(spark, d):
    """Raw labels to targets; what the taxonomy lacks keeps its own name and is unmappable."""
    to = spark.sql("SELECT * FROM VALUES ('ECONOMY', 'Basic', 'VALID'), ('STANDARD', 'Basic', 'VALID'), ('PROMO', 'Special', 'AMBIGUOUS') AS t(raw, target, status)")
    part = table(spark, d, "part").select("p_partkey", F.element_at(F.split("p_type", " "), 1).alias("raw"))
    out = part.join(F.broadcast(to), "raw", "left").select(F.coalesce("target", "raw").alias("target"), F.coalesce("status", F.lit("UNMAPPABLE")).alias("status"))
    return out.groupBy("target", "status").agg(F.count("*").alias("n"))


TAXONOMY = """WITH t(raw, target, status) AS (VALUES ('ECONOMY', 'Basic', 'VALID'), ('STANDARD', 'Basic', 'VALID'), ('PROMO', 'Special', 'AMBIGUOUS')), p AS (SELECT string_split(p_type, ' ')[1] AS raw FROM part)
SELECT coalesce(target, p.raw) AS target, coalesce(status, 'UNMAPPABLE') AS status, count(*) AS n FROM p LEFT JOIN t ON t.raw = p.raw GROUP BY 1, 2"""


def keyed_merge(spark, d):
    """Finalised and active values of a key: the active one wins."""
    final = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("f"))
    active = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("a"))
    return final.join(active, "key", "full_outer").select("key", F.coalesce("a", "f").alias("value"), F.when(F.col("a").isNull(), "final").otherwise("active").alias("origin"))


MERGE = "SELECT coalesce(c_custkey, k) AS key, coalesce(a, c_acctbal) AS value, CASE WHEN a IS NULL THEN 'final' ELSE 'active' END AS origin FROM customer FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS a FROM orders GROUP BY 1) ON k = c_custkey"


def smallest_free_id(spark, d):
    """The least positive number that a group doesn't use: the first gap in its distinct sorted ids."""
    ids = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") % 40 + 1).cast("int").alias("i")).distinct()
    ranked = ids.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("i")))
    return ranked.groupBy("c_nationkey").agg(F.coalesce(F.min(F.when(F.col("i") != F.col("k"), F.col("k"))), F.max("k") + 1).alias("free_id"))


FREE = """WITH i AS (SELECT DISTINCT c_nationkey, CAST(c_custkey % 40 + 1 AS INT) AS i FROM customer), n AS (SELECT DISTINCT c_nationkey FROM customer)
SELECT n.c_nationkey, CAST(min(g) AS INT) AS free_id FROM n, range(1, 42) t(g) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.c_nationkey = n.c_nationkey AND i.i = g) GROUP BY 1"""


def set_ops(spark, d):
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    used, known = c.select(F.col("c_nationkey").alias("k")), n.select(F.col("n_nationkey").alias("k"))
    out = known.union(r.select("r_regionkey")).distinct().withColumn("op", F.lit("union"))
    out = out.unionByName(known.exceptAll(used.distinct()).withColumn("op", F.lit("except")))
    out = out.unionByName(known.intersect(used).withColumn("op", F.lit("intersect")))
    return out.unionByName(known.where(F.col("k").isin(1, 3, 5)).withColumn("op", F.lit("member")))


SETOPS = """SELECT n_nationkey AS k, 'union' AS op FROM nation UNION SELECT r_regionkey, 'union' FROM region
UNION ALL (SELECT n_nationkey, 'except' FROM nation EXCEPT SELECT c_nationkey, 'except' FROM customer)
UNION ALL (SELECT n_nationkey, 'intersect' FROM nation INTERSECT SELECT c_nationkey, 'intersect' FROM customer)
UNION ALL SELECT n_nationkey, 'member' FROM nation WHERE n_nationkey IN (1, 3, 5)"""


def topk_per_group(spark, d):
    return votes.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 4).select("o_custkey", "rank", "o_orderkey", "o_totalprice")


TOPK = "SELECT o_custkey, CAST(k AS INT) AS rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 4"

QUERIES = {
    "accuracy_metrics": (accuracy_metrics, f"WITH {EVALUATED} SELECT attribute, {COUNTS} FROM ev GROUP BY attribute"),
    "grand_total": (grand_total, TOTAL),
    "split_grouping_sets": (split_grouping_sets, SETS),
    "confusion_matrix": (confusion_matrix, CONFUSION),
    "complementarity": (complementarity, COMPLEMENT),
    "selective_prediction": (selective_prediction, SELECTIVE),
    "pair_audit": (pair_audit, PAIR),
    "pipeline_comparison": (pipeline_comparison, COMPARE),
    "gating_statistics": (gating_statistics, GATING),
    "majority_vote": (majority_vote, MAJORITY),
    "weighted_majority": (weighted_majority, WEIGHTED),
    "family_then_shade": (family_then_shade, FAMILY),
    "nearest_rank_percentiles": (nearest_rank_percentiles, RANKS),
    "medians": (medians, MEDIANS),
    "distribution_profile": (distribution_profile, PROFILE),
    "deviations": (deviations, DEVIATIONS),
    "taxonomy_left_join": (taxonomy_left_join, TAXONOMY),
    "keyed_merge_full_outer": (keyed_merge, MERGE),
    "smallest_free_id": (smallest_free_id, FREE),
    "set_ops": (set_ops, SETOPS),
    "topk_per_group": (topk_per_group, TOPK),
}
