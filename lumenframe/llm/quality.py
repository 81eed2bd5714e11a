"""Quality by importance resampling.

Two generative models over hashed n-grams (words and word pairs), one of target texts and one of all raw
texts, give each document its weight: the sum over its n-grams of the log ratio of their probabilities.
Gumbel noise from a hash of the document is added, unscaled, and the k greatest are kept, which
samples k documents without replacement in proportion to their importance weights. There is no length
control. The exact k-th key is found by histograms.

The raw model counts every document. The target model reads at most about ``TARGETS`` labelled
documents. With no k given, it is the share of the labelled documents that are of quality 1.

Edge cases: null and empty texts have weight 0; labels that contradict each other count as the lower;
without targets every weight is 0; rows that are equal in every way have the same key, and just as many of
them are kept as k demands; an empty table gives an empty result; extra columns are ignored; carried columns must
not be named log_weight, gumbel_key or selected, which is an error; long texts are read in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.hashing import Remembered, mix, word_hash
from lumenframe.llm.quantile import Search, search
from lumenframe.llm.shared import freed, materialize, quoted, with_text

#: Buckets of the n-grams.
BUCKETS = 1 << 16
#: Labelled documents of the target model, about; the smoothing count.
TARGETS, ALPHA, SEED = 20_000, 1.0, 7
#: Words that are read at a time, and buckets that are counted at a time.
SLICE, HELD = 200_000, 2_000_000
#: Bits of a quantised key and of the hash that parts equal ones.
KEY_BITS, TIE_BITS = 40, 22


class Grams:
    """Buckets of the n-grams of texts."""

    def __init__(self):
        self.word = Remembered(word_hash)

    def __call__(self, text: str | None) -> Iterator[np.ndarray]:
        words = (text or "").split()
        for k in range(0, len(words), SLICE):
            h = mix(self.word.array(words[max(0, k - 1) : k + SLICE]))
            pairs = mix(h[:-1] * np.uint64(3) + h[1:])
            yield (np.concatenate([h if k == 0 else h[1:], pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", targets: int = TARGETS) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket."""
    judged = labels.select(F.col(key).alias("t_key"), "quality").where("quality IS NOT NULL").groupBy("t_key").agg(F.min("quality").alias("q")).where("q = 1")
    share = targets / max(1, judged.count())
    judged = judged.where(F.pmod(F.xxhash64("t_key"), F.lit(1_000_000)) / 1e6 < share).select("t_key", F.lit(True).alias("target"))
    rows = docs.select(F.col(key).alias("t_key"), F.col(text).alias("t")).join(F.broadcast(judged), "t_key", "left").select("t", F.coalesce("target", F.lit(False)).alias("target"))

    def run(batches):
        grams, counts = Grams(), np.zeros((2, BUCKETS), np.int64)
        held: tuple[list, list] = [], []

        def count() -> None:
            for i in (0, 1):
                if held[i]:
                    counts[i] += np.bincount(np.concatenate(held[i]), minlength=BUCKETS)
                    held[i].clear()

        size = 0
        for batch in batches:
            for t, is_target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for some in grams(t.as_py()):
                    held[is_target].append(some)
                    size += len(some)
                    if size >= HELD:
                        count()
                        size = 0
        count()
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "raw": counts.sum(axis=0)[at], "target": counts[1][at]})

    raw, target = np.full(BUCKETS, ALPHA), np.full(BUCKETS, ALPHA)
    for r in rows.mapInArrow(freed(run), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() <= ALPHA * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and log_weight, the sum of the log ratios of a document's n-grams."""
    (rows, at), n = with_text(docs, carry, text), len(carry)

    def run(batches):
        grams = Grams()
        for batch in batches:
            out = [round(float(sum(ratio[some].sum() for some in grams(t.as_py()))), 9) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.float64())], names=[*carry, "log_weight"])

    fields = [f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in carry]
    return rows.mapInArrow(freed(run), ", ".join([*fields, "log_weight double"]))


def target_share(labels: DataFrame) -> float:
    """The share of labelled documents that are of quality 1; 1 without labels."""
    found = labels.agg(F.avg("quality").alias("q")).first().q
    return 1.0 if found is None else float(found)


def gumbel(scored: DataFrame, key: str, seed: int) -> DataFrame:
    """scored with gumbel_key, its log_weight and noise from the key's hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log((bits + 0.5) / float(1 << 53))))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None, seed: int = SEED) -> DataFrame:
    """Every document with log_weight, gumbel_key and whether it is among the k selected."""
    carry = carry or (key,)
    if taken := {"log_weight", "gumbel_key", "selected", "__row", "__text"} & set(carry):
        raise ValueError(f"carried columns may not be named {', '.join(sorted(taken))}")
    scored = gumbel(weigh(docs, train(docs, labels, key, text), text, carry), key, seed)
    scored = materialize(scored.withColumn("__row", F.monotonically_increasing_id()), "weights")
    ends = scored.agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi"), F.max("__row").alias("row")).first()
    n = ends.n
    if k is None:
        k = round(n * target_share(labels))
    if not n or k >= n:
        return scored.drop("__row").withColumn("selected", F.lit(True))
    if k <= 0:
        return scored.drop("__row").withColumn("selected", F.lit(False))
    step = (ends.hi - ends.lo) or 1.0
    place = F.floor((F.col("gumbel_key") - ends.lo) / step * ((1 << KEY_BITS) - 1)).cast("long")
    place = F.shiftleft(place, TIE_BITS) + F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), key), 64 - TIE_BITS)
    # The cut is the least key of the k greatest; of the rows that share it, those written first stay.
    top = 1 << (KEY_BITS + TIE_BITS)
    cut = top - 1 - last_of(scored, F.lit(top - 1) - place, k, top)
    left = k - scored.where(place > cut).count()
    row = last_of(scored.where(place == cut), F.col("__row"), left, ends.row + 1)
    return scored.withColumn("selected", (place > cut) | ((place == cut) & (F.col("__row") <= row))).drop("__row")


def last_of(rows: DataFrame, key, k: int, top: int) -> int:
    """The k-th least of integer keys from 0 to top."""
    return search(rows, F.lit(0), key, F.lit(1), {0: Search(0, top, k - 0.5)}, up=True)[0].cut - 1


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
