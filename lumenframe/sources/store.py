"""Keyed stores and document sinks on plain Parquet and JSON folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "person_id int, attribute string, expected string, version long, deleted boolean"


class GroundTruth:
    """Last write wins for each (person, attribute). Writes are appended and settled when read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, rows: DataFrame, version: int) -> None:
        """Upsert rows (person_id, attribute, expected); persons up to 0 are refused."""
        if not rows.where("person_id IS NULL OR person_id <= 0").isEmpty():
            raise ValueError("person_id must be positive")
        self._append(rows.select("person_id", "attribute", "expected", F.lit(version).cast("long").alias("version"), F.lit(False).alias("deleted")))

    def delete(self, keys: DataFrame, version: int) -> None:
        """Delete by (person_id, attribute)."""
        self._append(keys.select("person_id", "attribute", F.lit(None).cast("string").alias("expected"), F.lit(version).cast("long").alias("version"), F.lit(True).alias("deleted")))

    def _append(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.folder}/{uuid.uuid4().hex}")

    def read(self) -> DataFrame:
        log = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.folder)
        last = log.groupBy("person_id", "attribute").agg(F.max_by(F.struct("expected", "deleted"), "version").alias("r"))
        return last.where("NOT r.deleted").select("person_id", "attribute", "r.expected")


def write_documents(rows: DataFrame, folder: str, key: str) -> None:
    """One JSON document for each row: the key beside a nested struct of the rest."""
    rest = [c for c in rows.columns if c != key]
    rows.select(key, F.struct(*rest).alias("document")).write.mode("overwrite").json(folder)


def crop_url(content, mime: str = "image/jpeg"):
    """Binary content as a data URL."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))
