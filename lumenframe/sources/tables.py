"""Batch sources: driver tables, derived frames and detections, media files and integrity-guarded caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.geometry import box

#: Accepted media extensions and MIME types.
IMAGE_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".jfif": "image/jpeg", ".png": "image/png"}
VIDEO_TYPES = {".mp4": "video/mp4", ".avi": "video/x-msvideo", ".mov": "video/quicktime", ".webm": "video/webm"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that are dealt to a task, about.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows by hash of some columns, in so many parts that a task's rows don't grow with the input; joins and groups by these columns need no other shuffle."""
    return rows.repartition(max(-(-rows.count() // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism), *by)


def media_files(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,jfif,png}", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files of a folder as (path, modificationTime, length, content), without names that hold an excluded part."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    for part in exclude:
        found = found.where(~F.col("path").contains(part))
    return found


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by a fixed formula over lineitem: one frame for each order, one detection for each line.

    (frame, det, box, confidence); coordinates are whole numbers, so all arithmetic is exact.
    """
    li = table(spark, sf_dir, "lineitem")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("frame"), line.alias("det"), part.alias("part"), F.col("l_quantity").alias("quantity"),
        box((part * 7 + line * 13) % 200, (supp * 11 + line * 5) % 150, 40 + part % 60, 80 + supp % 90).alias("box"),
        ((part * 31 + supp * 17 + line) % 100 / 100.0).alias("confidence"),
    )


#: The same rows as SQL text over lineitem.
DETECTIONS_SQL = """
det AS (SELECT l_orderkey AS frame, l_linenumber AS det, l_partkey AS part, l_quantity AS quantity,
  CAST((l_partkey * 7 + l_linenumber * 13) % 200 AS DOUBLE) AS x, CAST((l_suppkey * 11 + l_linenumber * 5) % 150 AS DOUBLE) AS y,
  CAST(40 + l_partkey % 60 AS DOUBLE) AS w, CAST(80 + l_suppkey % 90 AS DOUBLE) AS h,
  ((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 100) / 100.0::DOUBLE AS confidence FROM lineitem)
"""


def save_bank(bank: DataFrame, path: str, model_sha: str, content_sha: str, version: int = 1) -> None:
    """Write vectors (bank, label, vec) and, beside them, what they were made from."""
    bank.write.mode("overwrite").parquet(f"{path}/vectors")
    dim = bank.select(F.max(F.size("vec"))).first()[0] or 0
    bank.sparkSession.range(1).select(
        F.lit(version).alias("version"), F.lit(dim).alias("dim"), F.lit(model_sha).alias("model_sha"), F.lit(content_sha).alias("content_sha")
    ).write.mode("overwrite").parquet(f"{path}/meta")


def load_bank(spark: SparkSession, path: str, model_sha: str, content_sha: str, dim: int, version: int = 1) -> tuple[DataFrame | None, str]:
    """The vectors if they still match, else None; and why."""
    try:
        meta = spark.read.parquet(f"{path}/meta").first()
    except Exception as e:  # a missing cache is a reason, not an error
        return None, f"unreadable: {type(e).__name__}"
    for what, found, wanted in (("version", meta.version, version), ("dim", meta.dim, dim), ("model", meta.model_sha, model_sha), ("content", meta.content_sha, content_sha)):
        if found != wanted:
            return None, f"{what} differs"
    return spark.read.parquet(f"{path}/vectors"), "ok"


def media_union(spark: SparkSession, folders: list[str], pattern: str = "*.{jpg,jpeg,jfif,png}", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files of several folders."""
    found = media_files(spark, folders[0], pattern, exclude)
    for folder in folders[1:]:
        found = found.union(media_files(spark, folder, pattern, exclude))
    return found


def gallery_files(spark: SparkSession, folder: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(file, brand, content): exemplar images; the brand is the name before the first mark, or its alias."""
    name = F.element_at(F.split("path", "/"), -1)
    raw = F.lower(F.regexp_extract(name, r"^([^_\-.\d]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in (aliases or {}).items() for x in pair]) if aliases else F.lit(None).cast("map<string,string>")
    return media_files(spark, folder, "*.png").select(name.alias("file"), F.coalesce(F.try_element_at(known, raw), F.initcap(raw)).alias("brand"), "content")


def labelled_files(labels: DataFrame, first: DataFrame, second: DataFrame, key: str = "file") -> DataFrame:
    """Labelled rows whose file is in the first folder, or else in the second, with the path; the others go."""
    names = lambda files, at: files.select(F.element_at(F.split("path", "/"), -1).alias(key), F.col("path").alias(at)).dropDuplicates([key])
    found = labels.join(names(first, "_a"), key, "left").join(names(second, "_b"), key, "left")
    return found.withColumn("path", F.coalesce("_a", "_b")).where("path IS NOT NULL").drop("_a", "_b")
