"""Alignment of two tokenizers' tokens by their bytes, in relational steps.

The steps, for blocks of whole documents: both sides' tokens are laid out with their positions; running sums of their lengths give
the byte at which each ends; the equi-join of both sides on document and end finds the cuts; the running count of cuts before a
token is the number of its group; and the different ids of a group's sides, each with how often it occurs, are joined by group, so
a long group of a few repeated ids gives a few rows and not all pairs of occurrences. ``align`` takes these steps on columns of
Arrow batches, where a block's tokens never leave the task that encoded them; ``align_relational`` takes them with Spark's own
operators, which sort every token twice and gather it once. Both give the same rows.

Only id pairs with their numbers of documents are shuffled, one row for each pair and task. They are broadcast if they are few; else
documents' links are joined from a written table, whose frequent pairs Spark can split.

Edge cases: texts that are null or empty, and those whose tokens' joined bytes differ from space+text on either side, have no
tokens; repeated rows and keys are documents of their own, null keys too; empty tables give empty results; extra columns are ignored.
A document is one task's work: its links take memory with its different id pairs.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.bpe import PATTERN, byte_letters
from lumenframe.llm.shared import freed, held, materialize, only, small

#: Characters of texts whose tokens are held at a time in a worker.
BLOCK_CHARS = 1_000_000
#: Vocabularies of up to so many tokens have ids of two bytes, less half of it.
SHORT_IDS = 1 << 16
#: Bytes of text whose tokens one task sorts, about, so that they fit into its memory; partitions at most, beyond which sorts spill.
TASK_BYTES, MOST_TASKS = 1_000_000, 100_000


class Pair:
    """A byte-level vocabulary (JSON) and a piece model, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [spec["model"]["vocab"][m if isinstance(m, str) and " " not in m else "".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids must be in the order of the merges")
        self.encode_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_a = {i: b for b, i in ranks.items()}
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = model.encode
        self.bytes_b = [self.piece(model, i) for i in range(model.get_piece_size())]

    @cached_property
    def widths_a(self) -> list[int]:
        return self.widths[0].tolist()

    @staticmethod
    def piece(model, i: int) -> bytes:
        text = model.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides; nothing where either side's bytes are not those of space+text."""
        if not text:
            return [], []
        a, b, want = self.encode_a(" " + text), self.encode_b(text), (" " + text).encode()
        # A's tokens are slices of the text, in order: they are all of it if they are as long
        if sum(map(self.widths_a.__getitem__, a)) != len(want) or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return [], []
        return a, b

    def lengths(self) -> tuple[int, list[tuple[int, int]]]:
        """How far A's ids go, and (code, length in bytes) of every token; codes are A's ids, and B's behind them."""
        most = max(self.bytes_a, default=-1) + 1
        return most, [*((i, len(b)) for i, b in self.bytes_a.items()), *((most + i, len(b)) for i, b in enumerate(self.bytes_b))]

    @cached_property
    def widths(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of every token of both sides, by id."""
        a = np.zeros(max(self.bytes_a, default=-1) + 1, np.int64)
        a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        return a, np.array([len(x) for x in self.bytes_b], np.int64)

    @cached_property
    def words(self) -> np.ndarray:
        """Ids as decimal text with each of the separators ``,|;`` behind them, a row for each separator."""
        return np.array([[f"{i}{c}" for i in range(max(map(len, self.widths)))] for c in ",|;"], object)


@held
@lru_cache(1)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def joined(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of two columns that have equal values; right is sorted."""
    first = np.searchsorted(right, left, "left")
    n = np.searchsorted(right, left, "right") - first
    each = np.repeat(np.arange(len(left)), n)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(n) - n - first, n)


def ordered(first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The order of rows by first and then by pairs of ids; in one sort where both fit into one integer."""
    bits = [int(x.max(initial=0)).bit_length() for x in (first, pairs >> 32, pairs & 0xFFFFFFFF)]
    if sum(bits) > 62:
        return np.lexsort((pairs, first))
    return np.argsort(((first << bits[1] | pairs >> 32) << bits[2]) | (pairs & 0xFFFFFFFF))


def counted(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (group, id) in order, and how often each occurs."""
    keys, n = np.unique(groups << 32 | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


def block(both: Pair, texts: list[str | None]) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups and links of some documents."""
    found = [both.tokens(t) for t in texts]
    n_a, n_b = (np.array([len(f[side]) for f in found], np.int64) for side in (0, 1))
    a, b = (np.array(list(chain.from_iterable(f[side] for f in found)), np.int64) for side in (0, 1))
    # both sides of a document have the same bytes, so ends within the block are equal just where those within a document are
    end_a, end_b = both.widths[0][a].cumsum(), both.widths[1][b].cumsum()
    ends = np.zeros((2, (end_a[-1] if len(a) else 0) + 1), bool)
    ends[0, end_a] = ends[1, end_b] = True
    cut_a, cut_b = ends[1, end_a], ends[0, end_b]
    g_a, g_b = cut_a.cumsum() - cut_a, cut_b.cumsum() - cut_b
    doc = np.repeat(np.arange(len(texts)), n_a)[cut_a]  # of each group
    in_a, in_b = np.bincount(g_a, minlength=len(doc)), np.bincount(g_b, minlength=len(doc))
    n_groups = np.bincount(doc, minlength=len(texts))
    links, last = np.append(0, np.cumsum(in_a * in_b)), np.cumsum(n_groups)
    told = group_texts(both, a, b, g_a, g_b, in_a, in_b, n_a + n_b)
    return [*map(pa.array, (n_a, n_b, n_groups, links[last] - links[last - n_groups])), pa.array(told, pa.string()), document_links(a, b, g_a, g_b, in_a, in_b, doc, len(texts))]


def group_texts(both: Pair, a, b, g_a, g_b, in_a, in_b, n) -> list[str]:
    """The groups of each document as text; n are documents' tokens on both sides."""
    before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
    words = np.empty(len(a) + len(b), object)
    # a token's place is behind all tokens of earlier groups, and B's are behind A's of the same group
    words[np.arange(len(a)) + before_b[g_a]] = both.words[(np.diff(g_a, append=len(in_a)) > 0).astype(int), a]
    words[np.arange(len(b)) + before_a[g_b]] = both.words[(np.diff(g_b, append=len(in_b)) > 0) * 2, b]
    ends, words = np.cumsum(n).tolist(), words.tolist()
    return ["".join(words[start:end])[:-1] for start, end in zip([0, *ends], ends)]


def document_links(a, b, g_a, g_b, in_a, in_b, doc, n_docs: int) -> pa.Array:
    """Each document's different links as (pair, n)."""
    one = (in_a == 1) & (in_b == 1)  # groups of one token a side need no join
    (g_of_a, id_a, size_a), (g_of_b, id_b, size_b) = (counted(g[~one[g]], ids[~one[g]]) for g, ids in ((g_a, a), (g_b, b)))
    i, j = joined(g_of_a, g_of_b)
    of = np.concatenate([doc[one], doc[g_of_a[i]]])
    pairs = np.concatenate([a[one[g_a]] << 32 | b[one[g_b]], id_a[i] << 32 | id_b[j]])
    n = np.concatenate([np.ones(one.sum(), np.int64), size_a[i] * size_b[j]])
    order = ordered(of, pairs)
    of, pairs, n = of[order], pairs[order], n[order]
    starts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(pairs, prepend=-1) != 0))
    sums = np.add.reduceat(n, starts) if len(starts) else n
    links = pa.StructArray.from_arrays([pa.array(pairs[starts]), pa.array(sums)], ["pair", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[starts], np.arange(n_docs + 1)).astype(np.int32)), links)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups, links) of every document; groups is its text, links are its different (pair, n)."""
    rows = numbered(docs, key, text)
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def run(batches):
        for batch in batches:
            row, key, text = batch.columns
            some, held = [], 0
            for i, value in enumerate(text):
                some.append(value.as_py())
                held += len(some[-1] or "")
                if held >= BLOCK_CHARS or i == len(text) - 1:
                    start = i + 1 - len(some)
                    yield pa.RecordBatch.from_arrays([row.slice(start, len(some)), key.slice(start, len(some)), *block(pair(a_path, b_path), some)], names)
                    some, held = [], 0

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(freed(run), f"row long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair:bigint,n:bigint>>")


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return only(docs, key, text).toDF("key", "text").select(F.monotonically_increasing_id().alias("row"), "key", "text")


def encoded(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(row, key, n_a, ids): A's and then B's ids of (row, key, text)."""
    a_size, codes = pair(a_path, b_path).lengths()
    short = max(a_size, len(codes) - a_size) <= SHORT_IDS
    kind, less = (np.int16, SHORT_IDS // 2) if short else (np.int32, 0)

    def ids_of(row, key, some: list[str | None]) -> pa.RecordBatch:
        found = [pair(a_path, b_path).tokens(t) for t in some]
        ids = np.concatenate([np.empty(0, kind), *[(np.array(x, np.int32) - less).astype(kind) for ab in found for x in ab]])
        ends = np.cumsum([0, *[len(a) + len(b) for a, b in found]]).astype(np.int32)
        n_a = pa.array([len(a) for a, _ in found], pa.int32())
        return pa.RecordBatch.from_arrays([row, key, n_a, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["row", "key", "n_a", "ids"])

    def run(batches):
        for batch in batches:
            row, key, text = batch.columns
            some, held = [], 0
            for i, value in enumerate(text):
                some.append(value.as_py())
                held += len(some[-1] or "")
                if held >= BLOCK_CHARS or i == len(text) - 1:
                    start = i + 1 - len(some)
                    yield ids_of(row.slice(start, len(some)), key.slice(start, len(some)), some)
                    some, held = [], 0

    schema = f"row long, key {rows.schema['key'].dataType.simpleString()}, n_a int, ids array<{'smallint' if short else 'int'}>"
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(max(-(-size // TASK_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
    return rows.mapInArrow(freed(run), schema).repartition(tasks, "row").withColumn("less", F.lit(less))


def grouped(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, g, a, b): the ids of both sides' tokens of every group, in order. A document without tokens has one row with empty lists."""
    rows = numbered(docs, key, text)
    a_size, codes = pair(a_path, b_path).lengths()
    lengths = F.broadcast(docs.sparkSession.createDataFrame(codes, "code int, len int"))  # a row for each token of the vocabularies
    each = encoded(rows, a_path, b_path).select("row", "key", "n_a", "less", F.posexplode_outer("ids").alias("pos", "id"))
    each = each.select("row", "key", (F.col("pos") >= F.col("n_a")).alias("is_b"), "pos", (F.col("id").cast("int") + F.col("less")).alias("id"))
    each = each.withColumn("code", F.col("id") + F.when(F.col("is_b"), a_size).otherwise(0)).join(lengths, "code", "left")
    before = Window.partitionBy("row", "is_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.select("row", "key", "is_b", "id", F.sum("len").over(before).alias("end"))
    merged = Window.partitionBy("row").orderBy("end", "is_b")
    cuts = ends.withColumn("cut", F.coalesce(F.col("end") == F.lag("end").over(merged), F.lit(False)).cast("int"))
    found = cuts.withColumn("g", F.sum("cut").over(merged.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cut"))

    def side(b: bool) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("is_b") == b, F.struct("end", "id")))), lambda t: t["id"])

    return found.groupBy("row", "g").agg(F.first("key").alias("key"), side(False).alias("a"), side(True).alias("b"))


def linked(a: Column, b: Column) -> Column:
    """A group's links as (pair, n): both ids in one integer, and how many pairs of occurrences there are."""

    def times(ids: Column, x: Column) -> Column:
        return (F.size(ids) - F.size(F.array_remove(ids, x))).cast("long")

    return F.flatten(
        F.transform(
            F.array_distinct(a),
            lambda x: F.transform(F.array_distinct(b), lambda y: F.struct(packed(x, y).alias("pair"), (times(a, x) * times(b, y)).alias("n"))),
        )
    )


def align_relational(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``align`` by Spark's operators alone, after the encoding; a link that several groups have comes once for each."""
    told = F.concat_ws("|", F.array_join("a", ","), F.array_join("b", ","))
    each = grouped(docs, a_path, b_path, key, text).select(
        "row", "g", "key", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.when(F.size("a") > 0, told).alias("told"), linked(F.col("a"), F.col("b")).alias("links")
    )
    return each.groupBy("row").agg(
        F.first("key").alias("key"),
        F.sum("n_a").alias("n_a"),
        F.sum("n_b").alias("n_b"),
        F.count("told").alias("n_groups"),
        F.sum(F.col("n_a") * F.col("n_b")).alias("n_links"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("told").isNotNull(), F.struct("g", "told")))), lambda x: x["told"]), ";").alias("groups"),
        F.flatten(F.collect_list("links")).alias("links"),
    )


def packed(a: Column, b: Column) -> Column:
    """Both ids in one integer."""
    return F.shiftleft(a.cast("long"), 32) + b


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents each id pair is linked, and whether no other pair of its A id is in more."""
    pairs = F.array_distinct("links.pair")
    counts = aligned.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "docs", (F.col("docs") == most).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned with n_best and count_sum in place of links."""
    links = aligned.select("row", F.inline("links"))
    sums = links.join(small(counts), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    return aligned.drop("links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_paths())
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = materialize(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = materialize(pair_counts(aligned), "pairs")
    return scored(aligned, counts).select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
