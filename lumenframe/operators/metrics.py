"""Evaluation of predictions against ground truth, and distribution statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.sources.scratch import written


def accuracy(rows: DataFrame, by: list[str], expected: str, predicted: str) -> DataFrame:
    """Counts and accuracy of each group. Expected 'Skip' or blank is not evaluated.

    unknown and insufficient count predictions of those labels among the evaluated.
    """
    skip = (F.lower(F.coalesce(expected, F.lit(""))) == "skip") | (F.trim(F.coalesce(expected, F.lit(""))) == "")
    right = ~skip & (F.lower(expected) == F.lower(predicted))
    said = lambda label: F.count_if(~skip & (F.lower(predicted) == label))
    out = rows.groupBy(*by).agg(
        F.count_if(~skip).alias("evaluated"), F.count_if(right).alias("correct"), F.count_if(~skip & ~right).alias("incorrect"),
        F.count_if(skip).alias("skipped"), said("unknown").alias("unknown"), said("insufficient evidence").alias("insufficient"),
    )
    return out.withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("correct") * 100.0, F.col("evaluated")), F.lit(0.0)), 4))


#: Rows that are dealt to a task, about; groups that are broadcast at most.
TASK_ROWS, BROADCAST_ROWS = 500_000, 200_000


def values_at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], weight: str | None = None) -> DataFrame:
    """The values at given places (from 0, as functions of a group's count) of each group's sorted values, with the count n.

    With weight, a row stands for so many. Groups are dealt out, so many to a task, and sorted there. Where a task would get far more rows than others,
    values are dealt out instead, see _spread. So no list is gathered, no task sorts a large group, and a task's rows don't grow with the input.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), *([] if weight is None else [F.col(weight).alias("_w")]))
    dealt = _dealt(rows, by)
    return _spread(rows, by, ranks) if dealt is None else _in_tasks(dealt, by, ranks)


def _tasks(rows: DataFrame, of_a_row: int = 1) -> int:
    return max(-(-rows.count() * of_a_row // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)


def _dealt(rows: DataFrame, by: list[str], of_a_row: int = 1) -> DataFrame | None:
    """rows by hash of their group, about TASK_ROWS to a task if each becomes so many there; none if a task would get twice as many or more."""
    tasks = _tasks(rows, of_a_row)
    loads = rows.groupBy(F.pmod(F.hash(*by), F.lit(tasks)).alias("task")).count()  # as repartition deals; a row for each task and no group
    most = loads.agg(F.max("count")).first()[0] or 0
    return rows.repartition(tasks, *by) if most * of_a_row < 2 * TASK_ROWS else None


def _weight(rows: DataFrame) -> Column:
    return F.col("_w") if "_w" in rows.columns else F.lit(1)


def _in_tasks(rows: DataFrame, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    group = Window.partitionBy(*by)
    upto = F.sum(_weight(rows)).over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumns({"_upto": upto, "n": F.sum(_weight(rows)).over(group)})
    return found.groupBy(*by, "n").agg(*[F.min(F.when(F.col("_upto") > place(F.col("n")).cast("long"), F.col("_v"))).alias(name) for name, place in ranks.items()])


def _spread(rows: DataFrame, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """values_at_ranks of large groups: equal values are counted, dealt out by ranges of (group, value) with as many different values each, and the counts
    of a group's ranges tell in which of them a rank lies. Only these are sorted, whatever the values' distribution."""
    counted = written(rows.repartition(_tasks(rows), *by, "_v").groupBy(*by, "_v").agg(F.sum(_weight(rows)).alias("_c")), "counted")
    parts = _tasks(counted)
    ranged = written(counted.repartitionByRange(parts, *by, "_v").withColumn("_p", F.spark_partition_id()), "ranged")
    group = Window.partitionBy(*by)  # of a row for each range
    sizes = ranged.groupBy(*by, "_p").agg(F.sum("_c").alias("_s")).withColumns({"_upto": F.sum("_s").over(group.orderBy("_p")), "n": F.sum("_s").over(group)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in ranks.items()]))
    at = sizes.withColumn("_r", wanted).where("_r.place < _upto AND _r.place >= _upto - _s")
    at = written(at.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_p"]], "n", F.col("_r.name").alias("_name"), (F.col("_r.place") - (F.col("_upto") - F.col("_s"))).alias("_left")), "places")
    at = F.broadcast(at) if at.count() <= BROADCAST_ROWS else at
    inner = ranged.join(at, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_p"]]).repartition(parts, *by, "_name")
    inner = inner.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy("_v")))
    return inner.groupBy(*by, "n").agg(*[F.min(F.when((F.col("_name") == name) & (F.col("_upto") > F.col("_left")), F.col("_v"))).alias(name) for name in ranks])


def _unpivoted(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row for each column's value (_i, _v) that is known."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)])).alias("_l")
    return rows.select(*by, each).select(*by, F.col("_l.i").alias("_i"), F.col("_l.v").alias("_v")).where("_v IS NOT NULL")


def columns_at_rank(rows: DataFrame, by: list[str], columns: list[str], place: Callable[[Column], Column], few: bool = False) -> DataFrame:
    """The value of each of some columns at a place of its sorted values, and the count n of the first, for groups that have values of all.

    Whole rows are dealt out, and only in their tasks become a row for each column, so a shuffle holds no more than the input.
    few says that groups have few different values, which are then counted before anything is dealt out.
    """
    rows, group = rows.select(*by, *columns), [*by, "_i"]
    if few:
        counted = written(_unpivoted(rows, by, columns).groupBy(*group, "_v").agg(F.count("*").alias("_count")), "values")
        found = values_at_ranks(counted, group, "_v", {"_at": place}, "_count")
    else:
        dealt = _dealt(rows, by, len(columns))
        found = _spread(_unpivoted(rows, by, columns), group, {"_at": place}) if dealt is None else _in_tasks(_unpivoted(dealt, by, columns), group, {"_at": place})
    wide = found.groupBy(*by).agg(F.max(F.when(F.col("_i") == 0, F.col("n"))).alias("n"), F.count("*").alias("_k"), *[F.max(F.when(F.col("_i") == i, F.col("_at"))).alias(c) for i, c in enumerate(columns)])
    return wide.where(F.col("_k") == len(columns)).drop("_k")


def quantiles_by_rank(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """sorted[int(n * q)] of each group, the last value at most."""
    place = lambda q: lambda n: F.least(F.floor(n * q), n - 1)
    return values_at_ranks(rows, by, value, {name: place(q) for name, q in qs.items()}).drop("n")


def percentile(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The percentile between two neighbouring values, as far as q lies between them; the median at 0.5."""
    at = lambda n: (n - 1) * F.lit(q)
    found = values_at_ranks(rows, by, value, {"_below": lambda n: F.floor(at(n)), "_above": lambda n: F.ceil(at(n))})
    part = at(F.col("n")) - F.floor(at(F.col("n")))
    return found.select(*by, (F.col("_below") + (F.col("_above") - F.col("_below")) * part).alias(name))


def confusion(rows: DataFrame, expected: str, predicted: str, labels: list[str]) -> DataFrame:
    """Counts by expected (rows) and predicted (columns) label, totals and accuracy of each row."""
    out = rows.groupBy(expected).pivot(predicted, labels).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(f"`{x}`") for x in labels), F.lit(0))
    hit = F.coalesce(*[F.when(F.col(expected) == x, F.col(f"`{x}`")) for x in labels], F.lit(0))
    return out.withColumn("total", total).withColumn("accuracy", F.round(F.try_divide(hit, total), 4))
