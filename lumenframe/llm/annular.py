"""Vector codes: product quantisation whose nearest entries are found by annular norm pruning.

Entries of a codebook are sorted by norm. The distance of two vectors is at least the difference of their norms, so
once some entry is known to be at distance d, only entries whose norm differs by d or less can be as near.
A binary search gives that interval, the ends included, and every entry of it is evaluated exactly in integers; so ties
are all seen and go to the lowest index.

Fitting: tasks sum up the parts of each entry in numpy, Spark adds the sums, and the driver gets a row for each component
of the codebooks, whose number does not depend on the table.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped; rows with a null key are
coded and come last among the seeds; seeds with one key are ordered by their vector; repeated rows count as often as they
occur; with fewer rows than entries the codebooks are smaller; empty tables give empty results; extra columns are ignored.
Empty vectors have parts of no components, at distance 0 of entry 0. Vectors whose length differs from the seeds' or is no
multiple of the number of parts, and components so large that a distance would not fit into 64 bits, end the job with an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.shared import freed, materialize, only, quoted, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries next by norm that give the first bound, and pairs of a part and an entry that are evaluated at a time.
FIRST, BLOCK_PAIRS = 4, 1 << 20


@dataclass
class Annuli:
    """A codebook sorted by norm."""

    entries: np.ndarray
    order: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Annuli:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        order = np.argsort(norms, kind="stable")
        return cls(np.ascontiguousarray(entries[order]), order, norms[order])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each part's nearest entry, the squared distance to it, and how many entries were in the annuli."""
        n, k = len(x), len(self.norms)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        start = np.clip(np.searchsorted(self.norms, norm) - FIRST // 2, 0, max(k - FIRST, 0))
        bound = np.full(n, np.iinfo(np.int64).max)
        for j in range(min(FIRST, k)):
            bound = np.minimum(bound, ((x - self.entries[start + j]) ** 2).sum(1))
        reach = np.sqrt(bound.astype(np.float64))
        reach += 1e-9 * (1 + reach + norm)  # rounding only widens the annulus
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        best, index, at = np.empty(n, np.int64), np.empty(n, np.int64), 0
        ends = np.cumsum(high - low)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
            width = (high - low)[at:stop]
            first = np.cumsum(width) - width
            row = np.repeat(np.arange(at, stop), width)
            entry = np.arange(len(row)) - np.repeat(first - low[at:stop], width)
            far = ((x[row] - self.entries[entry]) ** 2).sum(1)
            best[at:stop] = np.minimum.reduceat(far, first)
            index[at:stop] = np.minimum.reduceat(np.where(far == best[row], self.order[entry], k), first)
            at = stop
        return index, best, int(ends[-1]) if n else 0


@dataclass
class Codebooks:
    """entries[part, entry, component], all integers."""

    entries: np.ndarray
    scale: int = SCALE

    def annuli(self) -> list[Annuli]:
        return [Annuli.of(e) for e in self.entries]

    def whole(self, column) -> np.ndarray:
        """The integer vectors [row, part, component] of a list column without nulls."""
        parts, _, width = self.entries.shape
        if len(column) and set(np.unique(np.diff(column.offsets.to_numpy()))) != {parts * width}:
            raise ValueError(f"every vector must have {parts * width} components")
        return integers(column.flatten().to_numpy(zero_copy_only=False), self.scale, parts * width).reshape(len(column), parts, width)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(values: np.ndarray, scale: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        found = np.floor(values.astype(np.float64) * scale)
    if len(found) and np.abs(found).max() > isqrt((2**63 - 1) // max(size, 1)) // 2:
        raise OverflowError("a component is too large for distances of 64 bits")
    return found.astype(np.int64)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    v = F.col(quoted(vector))
    return rows.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def seeds(rows: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the vectors with the smallest keys."""
    found = only(rows, key, vector).toDF("key", "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    size = len(found[0].vector) if found else 0
    if size % parts or any(len(r.vector) != size for r in found):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    whole = integers(np.array([r.vector for r in found], np.float64).ravel(), scale, size).reshape(len(found), parts, size // parts)
    return Codebooks(whole.transpose(1, 0, 2), scale)


def moved(rows: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """Every entry becomes the floor of the mean of the parts that are nearest to it; unused entries stay."""
    parts, entries, width = books.entries.shape

    def summed(batches):
        annuli, n, s = books.annuli(), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = books.whole(batch.column(0))
            for p in range(parts):
                index, _, _ = annuli[p].nearest(x[:, p])
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(s[p], index, x[:, p])
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(list(s[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    each = only(rows, vector).mapInArrow(freed(summed), "part long, entry long, n long, sums array<long>")
    totals = each.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("j", "s")).groupBy("part", "entry", "j").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    found = {(r.part, r.entry, r.j): int(r.s) for r in totals.collect()}  # a row for each component of the codebooks
    new = books.entries.copy()
    for (p, e, j), s in found.items():
        if j:
            new[p, e, j - 1] = s // found[p, e, 0]
    return Codebooks(new, books.scale)


def fit(rows: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after some rounds of assigning all parts and moving the entries."""
    rows = usable(rows, vector)
    books = seeds(rows, key, vector, parts, entries, scale)
    for _ in range(rounds if books.entries.shape[1] else 0):
        books = moved(rows, vector, books)
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, and code (two hex digits for each part) and error (squared distances summed over parts)."""
    if books.entries.shape[1] > 256:
        raise ValueError("two hex digits name 256 entries at most")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = only(usable(rows, vector), *carry, vector).toDF(*[f"c{i}" for i in range(len(carry))], "vector")

    def coded(batches):
        annuli = books.annuli()
        for batch in batches:
            x = books.whole(batch.column(len(carry)))
            codes, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), np.int64)
            for p, a in enumerate(annuli):
                codes[:, p], best, _ = a.nearest(x[:, p])
                error += best
            text = codes.tobytes().hex()
            step = 2 * codes.shape[1]
            found = [pa.array([text[i : i + step] for i in range(0, len(text), step)] or [""] * len(x), pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *found], [*batch.schema.names[: len(carry)], "code", "error"])

    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(carry)), "code string, error long"])
    return rows.mapInArrow(freed(coded), schema).toDF(*carry, "code", "error")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = fit(rows, "vec_id", "embedding")
    coded = materialize(encode(rows, books, "embedding", ("vec_id", "label")), "coded")
    by_label = small(materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels"))
    found = coded.join(by_label, coded["label"].eqNullSafe(by_label["label"]))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment to codebook k, and codebook k + 1."""
    return f"""a{k} AS MATERIALIZED (
  SELECT p.rn, p.part, min({{'d': list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': c.entry}}) AS m
  FROM p JOIN c{k} c USING (part) GROUP BY 1, 2
), n{k} AS (
  SELECT part, a.m.e AS entry, count(*) AS n, [{", ".join(f"sum(p.x[{j}])" for j in range(1, 5))}] AS s
  FROM a{k} a JOIN p USING (rn, part) GROUP BY 1, 2
), c{k + 1} AS (
  SELECT c.part, c.entry, CASE WHEN n.n IS NULL THEN c.x ELSE list_transform(n.s, lambda s: CAST((s - ((s % n.n) + n.n) % n.n) // n.n AS BIGINT)) END AS x
  FROM c{k} c LEFT JOIN n{k} n ON n.part = c.part AND n.entry = c.entry
)"""


#: For vectors of 64 components.
SQL = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rn, part, v[4 * part + 1 : 4 * part + 4] AS x FROM kept, range(16) r(part)
), c0 AS (
  SELECT part, rn - 1 AS entry, x FROM p WHERE rn <= 64
), {", ".join(_round(k) for k in range(3))}, coded AS (
  SELECT rn, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY rn
), digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept k JOIN coded c USING (rn) CROSS JOIN digest d
"""
