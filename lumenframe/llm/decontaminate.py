"""Benchmark decontamination by winnowing.

Of the k-gram hashes of a text, the least of every run of ``window - k + 1`` is kept. Any span of
``window`` words that a text shares with a benchmark item then has a kept hash in both, so the
join of kept hashes finds every text that shares a span. Hits are extended: of the texts found, all windows around
a shared hash are looked up among the items' windows, word by word. Items with fewer words than a window are one
window of all their words; their hashes are looked up at every place, apart from the others.

A text's hashes that no item has are mostly dropped before the join, by a table of fixed size that holds the places
of the items' hashes. Equal texts are judged once. All of it is built-in functions.

Edge cases: null and wordless texts have no words and no hits; repeated documents come back as
often as they went in; repeated items count once by id; a null item id counts as ''; an empty
table on either side gives no hits; extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.shared import ascii_lower, drop_scratch, materialize, only, small

#: Whatever ends a word: the ASCII characters that are neither letters nor digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places of the table that tells which hashes items have.
PLACES = 1 << 18


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column, k: int) -> Column:
    """The hash of every run of k words, given the words' hashes."""
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= k, each).otherwise(F.array().cast("array<bigint>"))


def winnowed(hashes: Column, k: int, run: int) -> Column:
    """The distinct least hashes of all runs of so many k-grams."""

    def least(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(h) - run + 1), lambda i: F.array_min(F.slice(h, i, run)))
        return F.when(F.size(h) >= run, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return let(grams(hashes, k), least)


def has_place(table: Column, h: Column) -> Column:
    """Whether the table marks a hash's place."""
    return F.substring(table, F.pmod(h, F.lit(PLACES)).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


def hit_words(spans: Column) -> Column:
    """How many words an array of (start, end) spans covers, ends excluded."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    total = F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(F.greatest(a.end, s.end).alias("end"), (a.n + F.greatest(F.lit(0), s.end - F.greatest(a.end, s.start))).alias("n")),
    )
    return total.n.cast("long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 5, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, items): the words inside occurring windows, and the sorted ids of their items."""
    run = window - k + 1
    bench = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text)).alias("w"))
    bench = materialize(bench.where(F.size("w") > 0).withColumn("m", F.least(F.lit(window), F.size("w"))), "bench")
    short = sorted(r.m for r in bench.where(F.col("m") < window).select("m").distinct().collect())  # fewer than a window of numbers

    long_prints = bench.where(F.col("m") == window).select(F.explode(winnowed(hashed(F.col("w")), k, run)).alias("print"))
    prints = [long_prints, *(bench.where(F.col("m") == m).select(F.explode(grams(hashed(F.col("w")), m)).alias("print")) for m in short)]
    for other in prints[1:]:
        long_prints = long_prints.union(other)
    prints = materialize(long_prints.distinct(), "prints")
    marked = bytearray(PLACES)
    for r in prints.select(F.pmod("print", F.lit(PLACES)).alias("place")).distinct().collect():
        marked[r.place] = 1
    table = F.lit(marked)

    def kept_of(w: Column) -> Column:
        parts = lambda h: [F.filter(p, lambda x: has_place(table, x)) for p in (winnowed(h, k, run), *(grams(h, m) for m in short))]
        return let(hashed(w), lambda h: F.array_distinct(F.concat(*parts(h))))

    body = F.coalesce(F.col(text), F.lit(""))
    pair = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), kept_of(w).alias("kept")))
    kept = only(docs, key, text).select(F.col(key).alias("id"), F.unhex(F.md5(body)).alias("same"), pair.alias("p"))
    kept = materialize(kept.select("id", "same", F.col("p.n").alias("n_words"), F.col("p.kept").alias("kept")), "kept")
    met = kept.select("same", F.explode("kept").alias("print")).join(small(prints), "print", "left_semi")
    met = materialize(met.groupBy("same").agg(F.collect_set("print").alias("met")), "met")  # of one text's own hashes

    texts = docs.select(F.unhex(F.md5(body)).alias("same"), body.alias("body")).join(small(met.select("same")), "same", "left_semi")
    texts = texts.groupBy("same").agg(F.first("body").alias("body")).join(small(met), "same")

    def places(h: Column, n: int) -> Column:
        """Where an n-gram begins whose hash was met."""
        at = let(grams(h, n), lambda g: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(F.col("met"), F.get(g, i))))
        return F.when(F.size(h) >= n, at).otherwise(F.array().cast("array<int>"))

    def windows_at(w: Column, starts: Column, m: int) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + m).alias("end"), F.array_join(F.slice(w, i + 1, m), " ").alias("win")))

    def around(h: Column) -> Column:
        """Where the windows begin that hold a k-gram that was met."""
        last = F.size(h) - window
        each = F.transform(places(h, k), lambda p: F.when(p - run + 1 <= last, F.sequence(F.greatest(F.lit(0), p - run + 1), F.least(p, last))).otherwise(F.array().cast("array<int>")))
        return F.when(last >= 0, F.array_distinct(F.flatten(each))).otherwise(F.array().cast("array<int>"))

    tried = let(words_of(F.col("body")), lambda w: let(hashed(w), lambda h: F.concat(windows_at(w, around(h), window), *(windows_at(w, places(h, m), m) for m in short))))
    tried = texts.select("same", F.explode(tried).alias("x")).select("same", "x.start", "x.end", "x.win")

    m = F.col("m")
    owned = bench.select("item", "m", F.explode(F.sequence(F.lit(1), F.size("w") - m + 1)).alias("i"), "w").select("item", F.array_join(F.slice("w", F.col("i"), m), " ").alias("win"))
    owned = materialize(owned.distinct(), "owned")
    hits = materialize(tried.join(small(owned.select("win").distinct()), "win", "left_semi"), "found")
    spans = hits.groupBy("same").agg(F.collect_list(F.struct("start", "end")).alias("spans")).select("same", hit_words(F.col("spans")).alias("n_hit"))
    of_items = hits.select("same", "win").distinct().join(small(owned), "win").groupBy("same").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = materialize(spans.join(of_items, "same"), "hits")
    for used in (bench, prints, met, owned, hits):
        drop_scratch(used)
    out = kept.select("id", "same", "n_words").join(small(found), "same", "left")
    return out.select(
        F.col("id").alias(key), "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b0 AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
b AS (SELECT *, least(13, len(w)) AS m FROM b0 WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM b)),
dw AS (
  SELECT rn, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS win
  FROM (SELECT d.*, l.m, unnest(range(1, len(w) - l.m + 2)) AS p FROM d, (SELECT DISTINCT m FROM b) l)),
hit AS (SELECT rn, item_id, dw.m, p FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
n AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM (SELECT rn, unnest(range(p, p + m)) AS pos FROM hit) GROUP BY rn),
i AS (
  SELECT rn, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rn, item_id FROM hit) GROUP BY rn)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN n USING (rn) LEFT JOIN i USING (rn)
"""
