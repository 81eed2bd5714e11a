"""Document fingerprints by I-Match.

A document's terms are its distinct lower-cased words whose inverse document frequency lies within
a band. They are sorted, and those of each of several randomised lexicon subsets are hashed in that order, so that a
change of a few terms leaves many of the hashes. Subsets keep from a quarter to a
thousandth of all terms, so that short and long documents both have hashes that outlast an edit.

Document frequencies are exact counts over every document. The terms of the band go to the workers; each is in at least
exp(-BAND[1]) of the documents, so there are at most exp(BAND[1]) times as many of them as terms in a document of mean size,
however many documents there are.

Edge cases: null counts as the empty text, whose fingerprint is all blank; a document without terms in the
band uses all its terms; equal texts have equal fingerprints; hashes of empty subsets are blank
and count for nothing, but equal fingerprints have likeness 1; repeated rows come back as often as they
went in and follow each other; keys are integers, null keys come last; rows of one key stay in one range, in the order of
their texts; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.hashing import MIX_A, mix, seeds
from lumenframe.llm.shared import freed, only, quoted, small

#: The band of inverse document frequencies, in nats.
BAND = (1.5, 8.0)
#: Randomised subsets, and the shares of terms that each keeps, as powers of a half.
SUBSETS, LEVELS = 32, (2, 4, 6, 8, 10)
#: Hashes that a level must have to be compared; terms that are hashed at once; terms that a task counts before they go out;
#: terms of the band up to which a task holds a table of their subsets.
LEAST, CHUNK, COUNTED, TABLE = 8, 4_096, 400_000, 1_000_000
#: Bytes of text of a range of keys, about.
RANGE_BYTES = 64_000_000
SEED = 11
BLANK = "...."


#: A fixed random number for each byte.
_BYTES = mix(seeds(256, SEED + 2))
_BYTES[ord(" ")] = 0


def terms(text: str) -> np.ndarray:
    """The sorted hashes of the distinct lower-cased words.

    All words are hashed at once: each is a number whose digits are its bytes' random numbers.
    """
    words = set(text.lower().split())
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    start = np.concatenate([[0], np.flatnonzero(data == ord(" ")) + 1])
    size = np.diff(np.append(start, len(data)))
    place = np.arange(len(data)) - np.repeat(start, size)
    found = np.sort(mix(np.add.reduceat(_BYTES[data] * powers(int(size.max()))[place], start)))
    same = found[1:] == found[:-1]  # of different words, hardly ever
    return np.delete(found, np.flatnonzero(same)) if same.any() else found


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): how many documents hold a term, by its hash; term 0 counts all documents."""

    def run(batches):
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"term": found.view(np.int64), "n": n})

        for batch in batches:
            for t in batch.column(0):
                held.append(np.append(terms(t.as_py() or ""), np.uint64(0)))
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return only(docs, text).mapInArrow(freed(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> np.ndarray:
    """The sorted hashes of the terms within the band."""
    counts = document_frequencies(docs, text).persist()
    try:
        n = counts.where("term = 0").agg(F.sum("n").alias("n")).first().n or 0
        inside = counts.where(F.col("term") != 0).where((F.col("n") >= n * exp(-band[1])) & (F.col("n") <= n * exp(-band[0])))
        return np.sort(inside.select("term").toArrow()["term"].to_numpy().view(np.uint64))
    finally:
        counts.unpersist()


class Fingerprinter:
    def __init__(self, kept: np.ndarray):
        self.kept = kept
        self.seeds, self.salt = seeds(SUBSETS, SEED), seeds(1, SEED + 1)[0]
        #: Of the kept terms: where their subsets begin, and how many and which they are; looked up instead of worked out for each text.
        self.starts = None
        if 0 < len(kept) <= TABLE:
            counts, subsets = zip(*(self.subsets(kept[k : k + CHUNK]) for k in range(0, len(kept), CHUNK)), strict=True)
            self.counts, self.table = np.concatenate(counts), np.concatenate(subsets)
            self.starts = np.cumsum(self.counts) - self.counts

    def subsets(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many subsets of all levels keep each term, and these subsets, term after term; each has its number over all levels."""
        place = mix(some[:, None] * self.seeds)
        within = np.concatenate([place < np.uint64(1 << (64 - level)) for level in LEVELS], axis=1)
        return within.sum(axis=1), np.nonzero(within)[1].astype(np.uint8)

    def __call__(self, text: str) -> str:
        every = terms(text)
        at = self.places(every) if len(self.kept) else np.zeros(0, np.int64)
        inside, looked_up = self.kept[at] if len(at) else every, len(at) and self.starts is not None
        groups = SUBSETS * len(LEVELS)
        hashes, sizes = np.zeros(groups, np.uint64), np.zeros(groups, np.int64)
        for k in range(0, len(inside), CHUNK):
            some = inside[k : k + CHUNK]
            if looked_up:
                counts = self.counts[at[k : k + CHUNK]]
                ends = np.cumsum(counts)
                subset = self.table[np.arange(ends[-1]) + np.repeat(self.starts[at[k : k + CHUNK]] - ends + counts, counts)]
            else:
                counts, subset = self.subsets(some)
            if not len(subset):
                continue
            order = np.argsort(subset, kind="stable")  # the terms of a subset stay in their order
            n = np.bincount(subset, minlength=groups)
            first, found = np.cumsum(n) - n, np.flatnonzero(n)
            rank = np.arange(len(order)) + np.repeat(sizes - first, n)
            # the terms of a subset are digits of a number
            digits = np.repeat(mix(some ^ self.salt), counts)[order] * powers(int(rank.max()) + 1)[rank]
            hashes[found] += np.add.reduceat(digits, first[found])
            sizes += n
        digests = (mix(hashes + sizes.astype(np.uint64)) >> np.uint64(48)).astype(">u2")
        out = np.frombuffer(digests.tobytes().hex().encode(), "S4").copy()
        out[sizes == 0] = BLANK
        return out.tobytes().decode()

    def places(self, every: np.ndarray) -> np.ndarray:
        """Places of those terms that are kept."""
        at = np.minimum(np.searchsorted(self.kept, every), len(self.kept) - 1)
        return at[self.kept[at] == every]


_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """At least n powers of a fixed odd number."""
    while len(_POWERS[0]) < n:
        have = _POWERS[0]
        _POWERS[0] = np.concatenate([have, have * have[-1] * MIX_A])
    return _POWERS[0]


def likeness(a: str, b: str) -> float:
    """The greatest share of agreeing hashes over the levels, of those that either has.

    A level counts if either fingerprint has LEAST hashes there.
    """
    if a == b:
        return 1.0
    x, y = np.array([a, b]).view("U4").reshape(2, len(LEVELS), SUBSETS)
    either = ((x != BLANK) | (y != BLANK)).sum(axis=1)
    same = ((x == y) & (x != BLANK)).sum(axis=1)
    return float((same / np.maximum(either, LEAST)).max())


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Rows dealt and sorted so that the next document, by descending key, is the next row.

    Each range of keys ends with a copy of the row that begins the next one that isn't empty, and the
    last with a copy of the very first: columns at, ghost, id, text. There are as many ranges as the texts' bytes need, each
    in a partition of its own. Only keys are looked at to find the ranges; texts are dealt out once. A row's range is looked
    up in a table of equal steps of the key, each with the ranges that begin in it.
    """
    spark = docs.sparkSession
    ident = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    size = docs.agg(F.sum(F.octet_length(F.coalesce(text, F.lit("")))).alias("bytes"), F.min(ident).alias("lo"), F.max(ident).alias("hi")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil((size["bytes"] or 0) / RANGE_BYTES))
    ids = docs.select(ident.alias("id"))
    bounds = sorted({int(x) for x in ids.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)}, reverse=True) if n > 1 else []
    lo, width = size.lo or 0, max(1.0, (float(size.hi or 0) - float(size.lo or 0)) / n)
    inner: dict[int, list[int]] = {}
    for b in bounds:
        inner.setdefault(int((float(b) - float(lo)) / width), []).append(b)
    steps, passed = [], 0
    for step in range(n + 1, -1, -1):  # keys come in descending order
        steps.append((step, passed, inner.get(step, [])))
        passed += len(inner.get(step, []))
    table = spark.createDataFrame(steps, "step long, passed int, inner array<bigint>")

    def ranged(rows: DataFrame) -> DataFrame:
        step = F.least(F.lit(n + 1), F.floor((F.col("id").cast("double") - float(lo)) / width)).cast("long")
        rows = rows.withColumn("step", step).join(F.broadcast(table) if n <= 1_000_000 else table, "step")
        return rows.withColumn("at", F.col("passed") + F.size(F.filter("inner", lambda b: b > F.col("id")))).drop("step", "passed", "inner")

    tops = {r["at"]: r["top"] for r in ranged(ids).groupBy("at").agg(F.max("id").alias("top")).collect()}  # one row for each range
    order = sorted(tops)
    found = spark.range(max(64, 40 * n)).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("code"))
    codes = {r.p: r.code for r in found.collect()}  # a number for each partition that is dealt to it
    places = [(k, tops[k], codes.get(k, k), codes.get(order[i - 1], order[i - 1])) for i, k in enumerate(order)]  # the very first follows the last
    places = spark.createDataFrame(places, "at int, top long, own long, before long")
    rows = ranged(docs.select(ident.alias("id"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))).join(small(places), "at")
    own, ghost = F.struct(F.col("own").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("at"), F.lit(True).alias("ghost"))
    rows = rows.select("id", "key", "text", F.explode(F.when(F.col("id") == F.col("top"), F.array(own, ghost)).otherwise(F.array(own))).alias("to"))
    rows = rows.select("to.at", "to.ghost", "id", "key", "text").repartition(n, "at").sortWithinPartitions("at", "ghost", F.desc("id"), "text")
    return rows.select("at", "ghost", "key", "text"), docs.schema[key].dataType.simpleString()


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last half comes from the next document.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text, band))
    rows, kind = with_next(docs, key, text)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        mark, held, done = Fingerprinter(shared.value), None, None
        for batch in batches:
            out, keys = [], []
            for i, (at, ghost) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if ghost and done == at:
                    continue  # the range already has the row that follows it
                body = batch.column(3)[i].as_py()
                own = mark(body)
                if held:
                    k, t, fp = held
                    half = len(t) // 2
                    edited = t[: len(t) - half] + body[:half]
                    other = mark(edited)
                    keys.append(k)
                    out.append((len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, other, likeness(fp, other), likeness(fp, own)))
                done = at if ghost else None
                held = None if ghost else (batch.column(2)[i].as_py(), body, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(2).type), *map(pa.array, zip(*out, strict=True))], names=names)

    return rows.mapInArrow(freed(run), f"{quoted(key)} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
