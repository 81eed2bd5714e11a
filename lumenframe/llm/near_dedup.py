"""Near duplicates by MinHash with sequential Bayesian verification.

Texts with the same set of word shingles are one class. Classes meet in the buckets of a banded
MinHash signature. Within a bucket, signatures are compared a batch at a time; after each batch a
pair whose posterior probability of reaching the threshold (uniform prior, binomial
matches) is below ``MISS`` is dropped. The pairs that are left join classes to clusters. Within
each cluster every pair that survives the same batches is verified on its full sets, once and one by one, by an
inverted index over the cluster's shingles; pairs whose classes are joined already are skipped.

Buckets and clusters of more than ``RUN`` classes, or whose sets need more than ``RUN_SHINGLES``, are first dealt into
runs that share a few hubs; the classes that this leaves outside the largest component are then compared with
all the others, block by block. So no pair is lost, no task holds more than two blocks, and what a run finds goes out
as one link for each component that it joins to another. Rows grow with the number of classes while a group fits in
one run or hangs together. Of a larger group whose classes are near each other but not linked (nothing but looking
at each pair can tell), every class is sent to one task for each block. Buckets with equal members are looked at once.

Edge cases: null, empty and wordless texts have empty sets and stay alone; texts of fewer than k
words are one shingle; repeated rows share their class; keys are integers or text that can be cast to long; a null
key counts as the greatest and comes out as null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.components import merge
from lumenframe.llm.hashing import MIX_A, Remembered, mix, seeds, word_hash
from lumenframe.llm.shared import drop_scratch, freed, materialize, only

#: Rows of a band, bands, and signature places that are compared at a time.
ROWS, BANDS, BATCH = 4, 20, 16
#: Chance at which a pair may be dropped wrongly, in each batch.
MISS = 1e-4
#: Classes and shingles of a run or block, and hubs of a large bucket.
RUN, RUN_SHINGLES, HUBS = 4_096, 2_000_000, 4
#: Runs of at most so many classes are compared many at a time.
FEW = 128
#: Run members that are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles that are hashed at a time.
CHUNK = 2_048
#: Pairs whose signatures are compared at once.
PAIRS = 200_000
LAST = (1 << 63) - 1

_PLACES = ROWS * BANDS
_MULTIPLY, _ADD = seeds(_PLACES, 1)[:, None], seeds(_PLACES, 2)[:, None]


def shingles(text: str | None, k: int, word: Remembered) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of fewer words, of all of them together."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word.array(words)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * MIX_A + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The least of each hash function over a set, as 32-bit numbers."""
    least = np.full(_PLACES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), CHUNK):
        least = np.minimum(least, ((s[i : i + CHUNK] * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=1))
    return least


@lru_cache(64)
def fewest_matches(threshold: float, places: int) -> int:
    """Matches among so many places below which a pair is dropped."""
    j = np.linspace(0, 1, 20_001)[1:-1]
    for m in range(places + 1):
        log = m * np.log(j) + (places - m) * np.log1p(-j)
        p = np.exp(log - log.max())
        if p[j >= threshold].sum() >= MISS * p.sum():
            return m
    return places


def sketch(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(id, n, d1, d2, bands, sig): set size, set digest, band keys and 16 bits of each signature place."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("t"))

    def run(batches):
        word, mixer = Remembered(word_hash), seeds(BANDS, 3)
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                out = []
                part = batch.slice(start, 1_000)
                for t in part.column(1):
                    s = shingles(t.as_py(), k, word)
                    sig = signature(s)
                    band = np.zeros(BANDS, np.uint64)
                    for i in range(ROWS):
                        band = mix(band * MIX_A + sig[i::ROWS] + mixer)
                    digest = mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + MIX_A)) if len(s) else np.uint64(0)
                    out.append((len(s), *(int(d.astype(np.int64)) for d in digest), band.view(np.int64), (sig & np.uint64(0xFFFF)).astype("<u2").tobytes()))
                n, d1, d2, bands, sigs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(list(bands), pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["id", "n", "d1", "d2", "bands", "sig"],
                )

    return rows.mapInArrow(freed(run), "id long, n long, d1 long, d2 long, bands array<long>, sig binary")


def runs_of(batches, width: int, read):
    """Consecutive rows that share bucket and part, as lists of the rest, the last column read by a function; a run may span batches."""
    head, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(width - 1)), batch.column(width - 1), strict=True):
            if row[:2] != head:
                if rows:
                    yield rows
                head, rows = row[:2], []
            rows.append((*row[2:-1], read(row[-1].as_py())))
    if rows:
        yield rows


class Index:
    """An inverted index over the sets of a run: how many shingles a row shares with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.columns = np.split(column, np.cumsum(self.n)[:-1])
        self.owners = np.repeat(np.arange(len(sets)), self.n)[np.argsort(column, kind="stable")]
        self.counts, self.starts = counts, np.cumsum(counts) - counts

    def shared(self, i: int) -> np.ndarray:
        """Shingles that row i shares with each row."""
        at = self.columns[i]
        counts, starts = self.counts[at], self.starts[at]
        places = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        return np.bincount(self.owners[places], minlength=len(self.n))

    def alike(self, i: int, j: np.ndarray, percent: int) -> np.ndarray:
        """Those of the rows j whose sets reach the threshold with row i's."""
        both = self.shared(i)[j]
        return j[100 * both >= percent * (self.n[i] + self.n[j] - both)]


def survivors(i: int, j: np.ndarray, n: np.ndarray, places: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the rows j that no batch of signature places rules out as row i's likes."""
    j = j[np.minimum(n[i], n[j]) >= (threshold - 1e-9) * np.maximum(n[i], n[j])]
    matches = np.zeros(len(j), np.int64)
    for start in range(0, _PLACES, BATCH):
        part = slice(start, start + BATCH)
        matches += (places[j, part] == places[i, part]).sum(axis=1)
        keep = matches >= fewest_matches(threshold, start + BATCH)
        j, matches = j[keep], matches[keep]
    return j


def join_run(role: np.ndarray, ident: np.ndarray, comp: np.ndarray, n: np.ndarray, places: np.ndarray, threshold: float, confirm=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the components of a run: role 2 meets itself, role 0 meets role 1.

    Each pair is looked at once, unless its rows are joined already.
    """
    old = np.unique(comp, return_inverse=True)[1]
    label, one, two = old.copy(), role == 1, role == 2
    for i in np.flatnonzero(~one):
        other = label != label[i]
        if not other.any():
            if not (label != label[0]).any():
                break
            continue
        if role[i] == 2:
            other &= two
            other[: i + 1] = False
        else:
            other &= one
        j = survivors(i, np.flatnonzero(other), n, places, threshold)
        if len(j) and confirm:
            j = confirm(i, j)
        if len(j):
            label[np.isin(label, label[j])] = label[i]
    first = np.unique(old, return_index=True)[1]  # a row of each old component
    _, lead, group = np.unique(label[first], return_index=True, return_inverse=True)
    target = first[lead][group]
    moved = target != first
    return ident[first[moved]], ident[target[moved]]


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places is linked to by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        if (label[i] == least).all() and (label[j] == least).all():
            return label
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]


def whole_runs(batches):
    """Columns of whole runs at a time: bounds of the runs, role, id, comp, set size and signature places."""
    rest = None
    for batch in batches:
        c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        c.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u2").reshape(-1, _PLACES))
        if rest is not None:
            c = [np.concatenate(x) for x in zip(rest, c, strict=True)]
        starts = np.flatnonzero(np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])]))
        rest = [x[starts[-1] :] for x in c]
        if len(starts) > 1:
            yield starts, [x[: starts[-1]] for x in c[2:]]
    if rest is not None and len(rest[0]):
        yield np.array([0, len(rest[0])]), rest[2:]


@lru_cache(2 * FEW)
def _all_pairs(n: int):
    return np.triu_indices(n, 1)


def pairs_of(bounds: np.ndarray, role: np.ndarray):
    """Places (i, j) of the pairs to compare in runs of FEW rows at most, some runs at a time."""
    sizes = np.diff(bounds)
    two = bounds[:-1][(sizes == 2) & (role[bounds[:-1]] == 2)]
    out, n = [(two, two + 1)], len(two)
    for start, size in zip(bounds[:-1].tolist(), sizes.tolist(), strict=True):
        if size > FEW:
            continue
        if role[start] == 2:
            if size < 3:
                continue
            i, j = _all_pairs(size)
        else:
            r = role[start : start + size]
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(r == 0), np.flatnonzero(r == 1), indexing="ij"))
        out.append((i + start, j + start))
        n += len(i)
        if n > PAIRS:
            yield tuple(map(np.concatenate, zip(*out, strict=True)))
            out, n = [], 0
    if out:
        yield tuple(map(np.concatenate, zip(*out, strict=True)))


def _links(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links_by_signature(threshold: float):
    """Links that join the classes of each run which no batch of signature places has ruled out."""

    def run(batches):
        for bounds, (role, ident, comp, n, places) in whole_runs(batches):
            large = np.diff(bounds) > FEW
            for start, end in zip(bounds[:-1][large], bounds[1:][large], strict=True):
                at = slice(start, end)
                yield _links(*join_run(role[at], ident[at], comp[at], n[at], places[at], threshold))
            left, right = [], []
            for i, j in pairs_of(bounds, role):
                keep = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= (threshold - 1e-9) * np.maximum(n[i], n[j]))
                i, j = i[keep], j[keep]
                matches = np.zeros(len(i), np.int64)
                for start in range(0, _PLACES, BATCH):
                    part = slice(start, start + BATCH)
                    matches += (places[i, part] == places[j, part]).sum(axis=1)
                    keep = matches >= fewest_matches(threshold, start + BATCH)
                    i, j, matches = i[keep], j[keep], matches[keep]
                left.append(i)
                right.append(j)
            if not left:
                continue
            label = components(len(ident), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield _links(ident[moved], ident[label[moved]])

    return run


def links_by_sets(k: int, percent: int):
    """Links that join the classes of each run whose signatures survive and whose full sets are alike."""

    def run(batches):
        word = Remembered(word_hash)
        for rows in runs_of(batches, 7, lambda text: shingles(text, k, word)):
            if len(rows) < 2:
                continue
            role, ident, comp, sig, sets = zip(*rows, strict=True)
            index: list[Index] = []

            def confirm(i, j, index=index, sets=sets):
                if not index:
                    index.append(Index(list(sets)))
                return index[0].alike(i, j, percent)

            columns = (np.array(x, np.int64) for x in (role, ident, comp, [len(s) for s in sets]))
            places = np.frombuffer(b"".join(sig), "<u2").reshape(-1, _PLACES)
            yield _links(*join_run(*columns, places, percent / 100, confirm))

    return run


def links(rows: DataFrame, payload: list[str], run) -> DataFrame:
    """Links (a, b) that run finds in the runs of rows (bucket, part, role, id, comp, *payload)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("bucket", "part", "role", "id", "comp", *payload).repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part")
    return materialize(dealt.mapInArrow(freed(run), "a long, b long"), "links")


def deal(members: DataFrame, labels: DataFrame, exact: bool) -> DataFrame:
    """Runs (bucket, part, role, id, comp) of the buckets of members (bucket, size, blocks, id).

    At first, buckets of one block are one run each, and larger ones are dealt into runs that share a few
    hubs. Exact runs bring every class outside a large bucket's largest component together with all others.
    """
    rows = members.join(labels, "id")
    if not exact:
        small = rows.where("blocks = 1").select("bucket", F.lit(0).cast("long").alias("part"), F.lit(2).alias("role"), "id", "comp")
        large = rows.where("blocks > 1")
        picks = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id", "comp")).alias(f"h{i}") for i in range(HUBS)]
        hubs = large.groupBy("bucket").agg(F.max("blocks").alias("blocks"), *picks)
        hubs = hubs.select("bucket", "blocks", F.explode(F.array_distinct(F.array(*[F.struct(f"h{i}.id", f"h{i}.comp") for i in range(HUBS)]))).alias("h"))
        hubs = hubs.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), F.lit(2).alias("role"), "h.id", "h.comp")
        return small.union(large.select("bucket", F.pmod(F.xxhash64("id", "bucket"), "blocks").alias("part"), F.lit(2).alias("role"), "id", "comp")).union(hubs)
    rows = materialize(rows.select("bucket", "size", "blocks", "id", "comp"), "rows")
    most = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket")
    most = materialize(most.agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.max("c").alias("c"), F.count("*").alias("comps")).where("comps > 1"), "most")
    rows = rows.join(most, "bucket")
    few, blocks = F.ceil((F.col("size") - F.col("c")) * F.col("blocks") / F.col("size")), F.col("blocks")
    few_block, block = F.pmod(F.xxhash64("bucket", "id"), few), F.pmod(F.xxhash64("id", "bucket"), blocks)
    all_parts = F.transform(F.sequence(F.lit(0).cast("long"), few - 1), lambda i: i * blocks + block)
    few_parts = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: few_block * blocks + j)
    every = rows.select("bucket", F.explode(all_parts).alias("part"), F.lit(1).alias("role"), "id", "comp")
    return every.union(rows.where("comp <> most").select("bucket", F.explode(few_parts).alias("part"), F.lit(0).alias("role"), "id", "comp"))


def joined(members: DataFrame, find) -> DataFrame:
    """Labels (id, comp) of the components that find(runs) links within the buckets of members."""
    labels = materialize(members.select("id").distinct().select("id", F.col("id").alias("comp")), "labels")
    found = find(deal(members, labels, exact=False))
    labels = merge(labels, found)
    drop_scratch(found)
    large = members.where("blocks > 1")
    if not large.isEmpty():
        found = find(deal(large, labels, exact=True))
        labels = merge(labels, found)
        drop_scratch(found)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): documents linked by sets whose Jaccard index is percent / 100 or more."""
    docs, threshold = only(docs, key, text), percent / 100
    sketches = materialize(sketch(docs, k, key, text), "sketches")
    first = F.min(F.struct("id", "n", "bands", "sig")).alias("s")
    classes = materialize(sketches.where("n > 0").groupBy("d1", "d2").agg(first).select("d1", "d2", "s.*"), "classes")
    banded = classes.select("id", F.posexplode("bands").alias("band", "bkey")).select("id", F.xxhash64("band", "bkey").alias("bucket"))
    same = (F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), *same).where("size > 1")
    blocks = F.ceil(F.col("size") / RUN).alias("blocks")
    buckets = materialize(buckets.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size", blocks), "buckets")
    members = materialize(banded.join(buckets, "bucket").select("bucket", "size", "blocks", "id"), "members")
    drop_scratch(buckets)

    def by_signature(runs: DataFrame) -> DataFrame:
        rows = runs.join(classes.select("id", "n", "sig"), "id")
        return links(rows, ["n", "sig"], links_by_signature(threshold))

    def by_sets(runs: DataFrame) -> DataFrame:
        runs = materialize(runs.join(classes.select("id", "sig"), "id"), "runs")
        side = F.broadcast(runs) if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else runs
        texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(text).alias("t"))
        found = links(texts.join(side, "id"), ["sig", "t"], links_by_sets(k, percent))
        drop_scratch(runs)
        return found

    clusters = joined(members, by_signature)
    sized = clusters.join(classes.select("id", "n"), "id").groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / RUN), F.ceil(F.col("shingles") / RUN_SHINGLES)).alias("blocks")
    sized = materialize(sized.select("comp", "size", blocks), "sized")
    drop_scratch(members)
    members = materialize(clusters.join(sized, "comp").select(F.col("comp").alias("bucket"), "size", "blocks", "id"), "members")
    for used in (sized, clusters):
        drop_scratch(used)
    labels = joined(members, by_sets)
    drop_scratch(members)
    comps = labels.where("id <> comp").select(F.col("id").alias("rep"), "comp")
    reps = classes.select("d1", "d2", F.col("id").alias("rep")).join(comps, "rep", "left")
    reps = materialize(reps.select("d1", "d2", F.coalesce("comp", "rep").alias("component")), "components")
    drop_scratch(classes)
    out = sketches.select("id", "n", "d1", "d2").join(reps, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(_known("id").alias(key), F.col("n").alias("n_shingles"), F.when(component < LAST, component).alias("component_id"))


def _known(c: str):
    """Null keys were counted as the greatest; they are null again."""
    return F.when(F.col(c) < LAST, F.col(c))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  WHERE 100 * least(nx.n, ny.n) >= 80 * greatest(nx.n, ny.n)
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
  HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
