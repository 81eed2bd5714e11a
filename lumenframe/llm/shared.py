"""Helpers shared by the operators: scratch tables and text columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from lumenframe.sources.scratch import scratch_root
from lumenframe.sources.ship import ship

__all__ = ["ascii_lower", "drop_scratch", "freed", "held", "materialize", "only", "quoted", "release_others", "sampled", "scratch_root", "ship", "small", "trimmed", "with_text"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Tables that are broadcast have at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000
#: Functions whose caches outlive their tasks.
_HELD: list = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back, which cuts lineage.

    The files are ordinary Parquet on shared storage, so a lost executor costs nothing.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch tables that df reads, once nothing else will read them."""
    spark, root = df.sparkSession, scratch_root(df.sparkSession)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root.removeprefix("file://") in folder:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with computed ones."""
    return df.select(*[df[n] for n in names])


def with_text(df: DataFrame, carry: tuple[str, ...], text: str) -> tuple[DataFrame, int]:
    """The carried columns and the text, and its place; a text that is carried stands there once."""
    columns = [df[c] for c in carry]
    return (df.select(*columns), carry.index(text)) if text in carry else (df.select(*columns, df[text].alias("__text")), len(carry))


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its rows and bytes are few enough; else joins shuffle it."""

    def width(name: str, kind) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 16
        if isinstance(kind, ArrayType):
            of = F.octet_length if isinstance(kind.elementType, (StringType, BinaryType)) else (lambda _: F.lit(8))
            return F.coalesce(F.aggregate(F.col(name), F.lit(16), lambda n, x: n + F.coalesce(of(x), F.lit(0)) + 16), F.lit(0))
        return F.lit(8)

    size = df.agg(F.count("*").alias("n"), F.sum(sum((width(f.name, f.dataType) for f in df.schema), F.lit(0)).cast("long")).alias("bytes")).first()
    return F.broadcast(df) if size.n <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES else df


def sampled(rows: DataFrame, of: str, text: str, most: int) -> DataFrame:
    """One row of each text that a hash picks: about ``most`` different texts of each value of ``of``, and always one at least.

    Repeated texts count once, before anything is picked, so neither copies nor the table's size change what a class is made of.
    """
    bits = 40
    rows = only(rows, of, text).toDF("of", "text").where("of IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 64 - bits))
    each = rows.select("of", "hash").distinct().groupBy("of").agg(F.count("*").alias("n"), F.min("hash").alias("least"))
    cut = F.greatest("least", F.least(F.lit(most) / F.col("n"), F.lit(1.0)) * float(1 << bits))
    picked = rows.join(small(each.select("of", cut.alias("cut"))), "of").where("hash <= cut")
    return picked.dropDuplicates(["of", "hash"]).select(F.col("of").alias(of), F.col("text").alias(text))


def quoted(name: str) -> str:
    """A column's name as it stands in a schema text."""
    return "`" + name.replace("`", "``") + "`"


def held(cached):
    """cached, a function with a cache that outlives its tasks; it is emptied when a worker gets a task of another module."""
    _HELD.append(cached)
    return cached


def trimmed() -> None:
    """Give unused memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def release_others(module: str) -> None:
    """Empty the caches that the tasks of other modules have left in this worker."""
    others = [cached for cached in _HELD if cached.__module__ != module and cached.cache_info().currsize]
    for cached in others:
        cached.cache_clear()
    if others:
        trimmed()


def freed(run):
    """run, a function of Arrow batches, whose task gives back what its worker no longer needs, before it begins and when it ends."""
    module = run.__module__

    @wraps(run)
    def task(batches):
        release_others(module)
        yield from run(batches)
        trimmed()

    return task
