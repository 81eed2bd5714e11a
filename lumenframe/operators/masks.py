"""Masks as tables of pixels: erosion, and the pixels well inside of a mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.sources.scratch import written

#: Least side of the structuring square, the share of the shorter side that it takes, pixels below which the centre is taken, and where the centre begins and ends.
LEAST_SIDE, SIDE_SHARE, LEAST_PIXELS, CENTRE = 3, 10, 20, (0.30, 0.70)

#: Lines of masks that are dealt to a task, about, and places of a strip of lines.
TASK_LINES, STRIP = 20_000, 64


def structuring_side(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(LEAST_SIDE), F.floor(F.least(width, height) / SIDE_SHARE)).cast("int")


def _inside(places: str, size: str) -> Column:
    """The places of a sorted line whose neighbours are all in it: side of them, the anchor at side / 2; what lies beyond the border never erodes.

    Places are different and sorted, so two of them have all between them if they are as far apart in the array.
    """
    before = F.floor(F.col("side") / 2).cast("int")
    after = F.col("side") - 1 - before
    line = F.col(places)

    def kept(at, i):
        first, last = F.greatest(at - before, F.lit(0)), F.least(at + after, F.col(size) - 1)
        return (F.get(line, (i - at + first).cast("int")) == first) & (F.get(line, (i + last - at).cast("int")) == last)

    return F.filter(line, kept)


def lines(pixels: DataFrame, sample: str, width: str = "width", height: str = "height") -> DataFrame:
    """(sample, width, height, y, xs): the lines of masks, each with its sorted places."""
    at = pixels.groupBy(sample, F.col(width).alias("width"), F.col(height).alias("height"), "y")
    return at.agg(F.array_sort(F.collect_set(F.col("x").cast("int"))).alias("xs"))


def eroded_columns(lines_: DataFrame, sample: str) -> DataFrame:
    """(sample, width, height, x, ys): what a square structuring element leaves, first of each line, then of each column of what is left.

    Lines are dealt out in strips of some places, so a task holds a line or a column of a mask and not a mask.
    """
    tasks = max(-(-lines_.count() // TASK_LINES), lines_.sparkSession.sparkContext.defaultParallelism)
    rows = lines_.withColumn("side", structuring_side(F.col("width"), F.col("height"))).withColumn("xs", _inside("xs", "width"))
    strips = F.sequence(F.lit(0), F.floor((F.col("width") - 1) / STRIP).cast("int"))
    rows = rows.withColumn("strip", F.explode(strips)).withColumn("xs", F.filter("xs", lambda x: F.floor(x / STRIP) == F.col("strip"))).repartition(tasks, sample, "strip")
    columns = rows.withColumn("x", F.explode("xs")).groupBy(sample, "strip", "width", "height", "side", "x").agg(F.array_sort(F.collect_list(F.col("y").cast("int"))).alias("ys"))
    return columns.select(sample, "width", "height", "x", _inside("ys", "height").alias("ys")).where(F.size("ys") > 0)


def interior_columns(lines_: DataFrame, sample: str) -> tuple[DataFrame, DataFrame]:
    """The columns (sample, width, height, x, ys) to take a colour from, and (sample, eroded) for every mask, as ``interior`` has them."""
    inner = written(eroded_columns(lines_, sample), "eroded")
    left = inner.groupBy(sample).agg(F.sum(F.size("ys")).alias("eroded"))
    left = lines_.select(sample).distinct().join(left, sample, "left").select(sample, F.coalesce("eroded", F.lit(0)).alias("eroded"))
    low, high = CENTRE
    inside = lambda c, size: (c >= F.floor(F.col(size) * low)) & (c < F.floor(F.col(size) * high))
    centre = lines_.where(inside(F.col("y"), "height")).join(left.where(F.col("eroded") < LEAST_PIXELS), sample, "left_semi")
    centre = centre.select(sample, "width", "height", F.explode(F.filter("xs", lambda x: inside(x, "width"))).alias("x"), F.array(F.col("y").cast("int")).alias("ys"))
    return inner.unionByName(centre), left


def eroded(pixels: DataFrame, sample: str, width: str = "width", height: str = "height") -> DataFrame:
    """The pixels (sample, x, y) of masks that a square structuring element leaves, with what else they have."""
    kept = eroded_columns(lines(pixels, sample, width, height), sample).select(sample, "x", F.explode("ys").alias("y"))
    return pixels.join(kept, [sample, "x", "y"], "left_semi")


def interior(pixels: DataFrame, sample: str, width: str = "width", height: str = "height") -> DataFrame:
    """The pixels to take a colour from: the eroded mask, or the mask's pixels in the centre where erosion leaves too few (added to them)."""
    inner = eroded(pixels, sample, width, height)
    few = pixels.select(sample).distinct().join(inner.groupBy(sample).agg(F.count("*").alias("n")), sample, "left").where(F.coalesce("n", F.lit(0)) < LEAST_PIXELS).select(sample)
    low, high = CENTRE
    inside = lambda c, size: (F.col(c) >= F.floor(F.col(size) * low)) & (F.col(c) < F.floor(F.col(size) * high))
    centre = pixels.where(inside("x", width) & inside("y", height)).join(few, sample, "left_semi")
    return inner.unionByName(centre)
