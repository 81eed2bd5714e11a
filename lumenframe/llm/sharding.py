"""Shards by a k-d tree over document metadata.

Nodes are split at the weighted quantile of their widest dimension until every leaf is one
shard. Ties on a dimension are broken by a hash of the row, so a dimension that one value fills (a hot
source, a group of equal texts) is still split evenly. Cuts are found by histograms in rounds: the
searches of all nodes of a level are rows of a small table, and each round narrows all of them, so the driver sees
no more than counts. Slots come from counts of small hash cells, so no shard is ever sorted in one task.

The result depends on the rows alone, not on how they are partitioned: rows that are equal in every way are counted
and numbered, and the number is part of the hash.

Edge cases: a null text weighs only the overhead; repeated rows are dealt as single ones; null metadata count as the
least value; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.shared import BROADCAST_ROWS, drop_scratch, materialize, small

#: Bits of a quantised dimension and of the hash that breaks its ties.
DIM_BITS, TIE_BITS = 20, 42
#: Buckets of a round of a search; the share of a shard by which a cut may miss its target.
BUCKETS, SLACK = 1 << 15, 1e-4
#: Rows of a partition of the tables that searches make.
PART_ROWS = 100_000
#: Bytes that each document weighs besides its text.
OVERHEAD = 8
#: Rows of one slot cell, about, and the fewest cells of a shard; equal rows that are numbered at a time.
CELL_ROWS, LEAST_CELLS, CHUNK = 50_000, 64, 4_096


def numbered(meta: DataFrame) -> DataFrame:
    """meta with copy, which numbers rows that are equal in every way from 0."""
    names = meta.columns
    counted = materialize(meta.groupBy(*names).agg(F.count("*").alias("copies")), "shard-counts")
    few = counted.where("copies = 1").select(*names, F.lit(0).cast("long").alias("copy"))
    many = counted.where("copies > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))).alias("chunk")).repartition("chunk", "id", "crc")
    start = F.col("chunk") * CHUNK
    return few.union(many.select(*names, F.explode(F.sequence(start, F.least(start + CHUNK, F.col("copies")) - 1)).alias("copy")))


def few_parts(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which there are n at most, in no more partitions than they need."""
    return rows.coalesce(max(1, min(rows.sparkSession.sparkContext.defaultParallelism, n // PART_ROWS)))


def cuts_of(tree: DataFrame, key: Column, spans: DataFrame, nodes: int, slack: float) -> DataFrame:
    """(first, dim, cut) of each of so many nodes in spans (first, dim, lo, hi, target): the weight of keys below the cut is as
    near to the target as the slack demands, or the keys allow."""
    state = spans.select("first", "dim", "lo", "hi", "target", F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("cut"))
    state = materialize(few_parts(state, nodes), "cuts")
    while left := state.where("cut IS NULL").count():
        at = state.where("cut IS NULL").withColumn("width", F.greatest(F.lit(1).cast("long"), F.ceil((F.col("hi") - F.col("lo")) / BUCKETS)))
        at = F.broadcast(at) if left <= BROADCAST_ROWS else at  # its rows are eight numbers each
        rows = tree.join(at, "first").withColumn("key", key).where("key >= lo AND key < hi")
        found = few_parts(rows.groupBy("first", F.expr("(key - lo) div width").alias("b")).agg(F.sum("size").alias("w")), left * BUCKETS)
        order = Window.partitionBy("first").orderBy("b")  # of BUCKETS rows at most
        sums = found.withColumns({"upto": F.sum("w").over(order), "last": F.lead("b").over(order).isNull()}).join(at, "first")
        pick = sums.where("below + upto >= target OR last").groupBy("first").agg(F.min(F.struct("b", "w", "upto")).alias("p"))
        start, after = F.expr("lo + p.b * width"), F.expr("below + p.upto")
        end = F.least("hi", start + F.col("width"))
        over, under = after - F.col("target"), F.col("target") - (after - F.col("p.w"))
        cut = F.when((F.col("width") == 1) | (F.col("p.w") <= slack), F.when(over <= under, end).otherwise(start))
        new = at.join(pick, "first").select("first", "dim", start.alias("lo"), end.alias("hi"), "target", (after - F.col("p.w")).alias("below"), cut.alias("cut"))
        narrowed = materialize(few_parts(state.where("cut IS NOT NULL").union(new), nodes), "cuts")
        drop_scratch(state)
        state = narrowed
    return state.select("first", "dim", "cut")


def kd_shards(docs: DataFrame, dims: dict[str, Column], n_shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot): shards of nearly equal bytes.

    dims names numeric columns over docs. Give n_shards, or target_bytes for as many shards as
    their sum needs.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    meta = numbered(
        docs.select(
            F.col(key).alias("id"),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("crc"),
            *[c.cast("double").alias(f"v{i}") for i, c in enumerate(dims.values())],
        )
    )
    n = len(dims)
    tie = F.shiftrightunsigned(F.xxhash64("id", "crc", "size", *[f"v{i}" for i in range(n)], "copy"), 64 - TIE_BITS)
    meta = materialize(meta.withColumn("tie", tie), "shard-meta")
    ends = meta.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(f"v{i}").alias(f"{k}{i}") for i in range(n) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if target_bytes:
        n_shards = max(1, -(-(ends.bytes or 0) // target_bytes))
    top = (1 << DIM_BITS) - 1

    def quantised(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(f"v{i}") - lo) / (hi - lo) * (top - 1)) + 1, F.lit(0)).cast("long")

    # A node is known by the first shard under it, first, and has leaves shards.
    keys = [f"q{i}" for i in range(n)]
    tree = meta.select("id", "size", "crc", "copy", "tie", *[quantised(i).alias(k) for i, k in enumerate(keys)], F.lit(0).alias("first"), F.lit(n_shards).alias("leaves"))
    chosen = F.shiftleft(F.get(F.array(*keys), F.col("dim")), TIE_BITS) + F.col("tie")
    old = meta
    for level in range((n_shards - 1).bit_length() if ends.rows else 0):
        inner = tree.where("leaves > 1")
        widths = F.array(*[F.max(k) - F.min(k) for k in keys])
        spans = inner.groupBy("first", "leaves").agg(F.sum("size").alias("w"), widths.alias("widths"), F.array(*[F.min(k) for k in keys]).alias("low"), F.array(*[F.max(k) for k in keys]).alias("high"))
        spans = spans.withColumn("dim", (F.array_position("widths", F.array_max("widths")) - 1).cast("int"))
        lo, hi = F.shiftleft(F.get("low", F.col("dim")), TIE_BITS), F.shiftleft(F.get("high", F.col("dim")) + 1, TIE_BITS)
        spans = spans.select("first", "dim", lo.alias("lo"), hi.alias("hi"), (F.col("w") * F.expr("leaves div 2") / F.col("leaves")).alias("target"))
        cuts = cuts_of(inner, chosen, spans, 1 << level, SLACK * ends.bytes / n_shards)
        half = F.expr("leaves div 2").cast("int")
        right = chosen >= F.col("cut")
        split = tree.join(small(cuts), "first", "left").select(
            "id", "size", "crc", "copy", "tie", *keys,
            F.when(right, F.col("first") + half).otherwise(F.col("first")).alias("first"),
            F.when(F.col("leaves") == 1, 1).when(right, F.col("leaves") - half).otherwise(half).alias("leaves"),
        )
        tree = materialize(split, "shard-level")
        drop_scratch(old)
        drop_scratch(cuts)
        old = tree
    cells = max(LEAST_CELLS, -(-(ends.rows or 0) // (n_shards * CELL_ROWS)))
    out = materialize(tree.select("id", "size", "crc", "copy", "tie", F.col("first").alias("shard"), F.pmod(F.xxhash64("tie"), F.lit(cells)).alias("cell")), "shard-out")
    drop_scratch(old)
    count = out.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "cell").orderBy("tie", "id", "crc", "size", "copy")
    out = out.withColumn("k", F.row_number().over(within)).join(small(materialize(count, "shard-cells")), ["shard", "cell"])
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("k") - 1).cast("long").alias("slot"))


def document_dims(docs: DataFrame) -> dict[str, Column]:
    """The metadata of documents: length on a log scale, language, source and doc_id."""
    return {
        "size": F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 1),
        "lang": F.crc32("lang"),
        "source": F.crc32("source"),
        "doc_id": F.col("doc_id"),
    }


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = kd_shards(docs, document_dims(docs), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
