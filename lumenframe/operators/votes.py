"""Quality-weighted votes, running evidence and life-cycle states over observations.

An observation has a track, an order, a category, a score, a quality and a margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Observations of a rolling window, least count, margin and consensus of a stable state.
WINDOW, LEAST_COUNT, LEAST_MARGIN, LEAST_CONSENSUS = 10, 5, 0.12, 0.65


#: Fixed value: places to which sums are alike, so that the order of addition decides no tie.
ALIKE = 9


def halves_up(x: Column, places: int) -> Column:
    """x to some places as SQL rounds it: x times a power of ten to the nearest whole number. F.round goes by the decimal text, where 0.02185 is a half."""
    return F.round(x * 10.0**places) / 10.0**places


def reliability(quality: Column, margin: Column, scale: float) -> Column:
    """max(.1, quality) * clamp(margin / scale, .25, 1)."""
    return F.greatest(quality, F.lit(0.1)) * F.least(F.greatest(margin / scale, F.lit(0.25)), F.lit(1.0))


def rolling_vote(obs: DataFrame, track: str, order: list[str], category: str, score: str, weight: Column, last: int = WINDOW) -> DataFrame:
    """For each observation, the weighted vote over its track's last observations.

    Adds top, share, margin, consensus and n. Scores of a category add up to score * weight over the
    total weight; sums that are alike to nine places are ties, which go to the category that sorts first. The window is bounded, so
    its rows are gathered in one array for each row, and nothing is joined. The newest is added up first.
    """
    w = Window.partitionBy(track).orderBy(*order).rowsBetween(-(last - 1), 0)
    rows = obs.withColumn("__w", weight).withColumn("__last", F.reverse(F.collect_list(F.struct(F.col(category).alias("c"), F.col(score).alias("s"), F.col("__w").alias("w"))).over(w)))
    cats = F.array_sort(F.array_distinct(F.transform("__last", lambda x: x.c)))
    sums = lambda x, c: F.aggregate(F.filter("__last", lambda y: y.c == c), F.lit(0.0), lambda a, y: a + y.s * y.w)
    per = F.transform(F.transform(cats, lambda c: F.struct(c.alias("c"), sums(None, c).alias("sum"))), lambda p: F.struct((-halves_up(p["sum"], ALIKE)).alias("order"), p.c.alias("c"), p["sum"].alias("sum"), F.size(F.filter("__last", lambda y: y.c == p.c)).alias("votes")))
    rows = rows.withColumn("__per", F.array_sort(per)).withColumn("__total", F.aggregate("__last", F.lit(0.0), lambda a, y: a + y.w))
    top, second = F.get("__per", F.lit(0)), F.coalesce(F.get("__per", F.lit(1))["sum"], F.lit(0.0))
    return rows.select(
        *obs.columns,
        top.c.alias("top"), (top["sum"] / F.col("__total")).alias("share"), ((top["sum"] - second) / F.col("__total")).alias("margin"),
        (top.votes / F.size("__last")).alias("consensus"), F.size("__last").alias("n"),
    )


def lifecycle(n: Column, margin: Column, consensus: Column) -> Column:
    """Analyzing below the least count, then Uncertain or Stable."""
    unsure = (margin < LEAST_MARGIN) | (consensus < LEAST_CONSENSUS)
    return F.when(n < LEAST_COUNT, "Analyzing").when(unsure, "Uncertain").otherwise("Stable")


def two_class_mean(obs: DataFrame, track: str, first: Column, second: Column, weight: Column) -> DataFrame:
    """Weighted means of two scores for each track, the winner, and its share of votes."""
    rows = obs.select(track, first.alias("a"), second.alias("b"), weight.alias("w")).groupBy(track).agg(
        (F.sum(F.col("a") * F.col("w")) / F.sum("w")).alias("mean_a"), (F.sum(F.col("b") * F.col("w")) / F.sum("w")).alias("mean_b"),
        F.count_if(F.col("a") > F.col("b")).alias("votes_a"), F.count("*").alias("n"),
    )
    wins = F.col("mean_a") > F.col("mean_b")
    votes = F.when(wins, F.col("votes_a")).otherwise(F.col("n") - F.col("votes_a"))
    return rows.select("*", F.when(wins, "A").otherwise("B").alias("winner"), (votes / F.col("n")).alias("consensus"))


def majority(rows: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """The value with the most rows or weight in each group; ties go to the value that sorts first."""
    counted = rows.groupBy(*by, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("votes"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("votes")).alias("neg"), F.col(value).alias("v"))).alias("m")).select(*by, F.col("m.v").alias(value), (-F.col("m.neg")).alias("votes"))


def top_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, with rank; Spark limits groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def running_evidence(obs: DataFrame, track: str, order: list[str], positive: Column, negative: Column, confidence: Column, need_positive: int, need_negative: int, visible: Column | None = None) -> DataFrame:
    """Running counts of evidence for and against, the greatest confidence so far, and the state they give.

    Without any evidence, what is not visible is told apart from what was seen too badly.
    """
    w = Window.partitionBy(track).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = obs.withColumns({
        "positives": F.sum(positive.cast("int")).over(w), "negatives": F.sum(negative.cast("int")).over(w),
        "best": F.coalesce(F.max(F.when(positive, confidence)).over(w), F.lit(0.0)),
    })
    p, n = F.col("positives"), F.col("negatives")
    state = F.when(p >= need_positive, "Detected").when(n >= need_negative, "NotDetected").when(p > 0, "Candidate").when(n > 0, "Analyzing")
    state = state.otherwise("InsufficientEvidence") if visible is None else state.when(~visible, "NotVisible").otherwise("InsufficientEvidence")
    return rows.withColumn("state", state)


def streaks(obs: DataFrame, track: str, order: list[str], flag: Column) -> DataFrame:
    """How many rows in a row the flag has held, by gaps and islands."""
    w = Window.partitionBy(track).orderBy(*order)
    rows = obs.withColumn("__f", flag.cast("int")).withColumn("__g", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(track, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum("__f").over(run)).drop("__f", "__g")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Runs of events that are less than a gap apart."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")
