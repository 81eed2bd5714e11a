"""URL filter, sharding and decontamination: SQL, brute force and odd inputs."""

import random
import re
import time
import zlib

import pytest
from compare import rows
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, quantile, sharding, url_filter


@pytest.mark.parametrize("name,module", [("op3_url_filter", url_filter), ("op10_decontamination", decontaminate)])
def test_equals_sql(spark, oracle, small, name, module):
    assert rows(getattr(module, name)(spark, small).toPandas()) == rows(oracle.execute(module.SQL).df())


def brute_rule(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "/en/x", "block"), ("com", "", "block"), ("b.com", "/", "allow"), ("b.com", "/", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET/en/xy?u=://z", "x://www.a.net", "x://a.net/en", "q://b.com#f", "q://B.com/", "http://É.net/"]
    urls += ["http://" + rng.choice(["a.net", "w.a.net", "b.com", "c.org", "xb.com"]) + rng.choice(["", "/", "/en/", "/en/x/y", "/e"]) + rng.choice(["", "?a", "#b"]) for _ in range(100)]
    data = [(i // 2, u, "clash", "clash") for i, u in enumerate(urls)] + [(7, "http://a.net/", "c", "c")] * 5
    pages = spark.createDataFrame(data, "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted(map(str, map(tuple, url_filter.filter_urls(pages, table).select("page_id", "host", "path", "rule", "verdict").collect())))
    want = sorted(str((i, *brute_rule(u, rules))) for i, u, *_ in data)
    assert got == want


def test_urls_empty(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.rules_table(spark)).count() == 0


def test_very_long_url(spark):
    """Expressions are no more than the kinds of rules."""
    host, path = ".".join(["l"] * 800) + ".net", "/" + "/".join(["p"] * 800)
    pages = spark.createDataFrame([(1, f"http://{host}{path}"), (2, "http://a.net/")] + [(3, "http://hot.net/x")] * 50, "page_id long, url string")
    rules = url_filter.rules_table(spark)
    url_filter.filter_urls(pages, rules).collect()
    start = time.time()
    got = url_filter.filter_urls(pages, rules).collect()
    assert time.time() - start < 20 and len(got) == 52 and all(r.rule == "net/" for r in got)


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert {tuple(r) for r in url_filter.filter_urls(pages, url_filter.rules_table(spark).where("false")).collect()} == {(1, "a.net", "/", None, "allow"), (None, "", "", None, "allow")}


def test_quantile_search(spark):
    rng = random.Random(1)
    data = [(g, rng.randrange(1 << 40), rng.randrange(1, 50)) for g in range(3) for _ in range(300)]
    df = spark.createDataFrame(data, "g int, k long, w long")
    targets = {g: quantile.Search(0, 1 << 41, sum(w for h, _, w in data if h == g) * 0.3) for g in range(3)}
    for g, s in quantile.search(df, F.col("g"), F.col("k"), F.col("w"), targets, buckets=16).items():
        assert abs(sum(w for h, k, w in data if h == g and k < s.cut) - s.target) <= 50


def check_shards(found, n, key="doc_id"):
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(n))
    for some in shards.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    return shards


def test_shards_of_documents(spark, small):
    found = sharding.op8_sharding(spark, small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(found) == len(docs)
    shards = check_shards(found, 24)
    for r in found:
        body = (docs[r.doc_id] or "").encode()
        assert r["size"] == len(body) + 8 and r.text_crc32 == zlib.crc32(body)
    weights = [sum(r["size"] for r in s) for s in shards.values()]
    assert len(shards) == 24 and max(weights) <= sum(weights) / 24 + 2 * max(r["size"] for r in found)


def test_shards_of_hot_groups_are_even(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    found = sharding.kd_shards(rows, sharding.document_dims(rows), n_shards=5).collect()
    weights = [sum(r["size"] for r in s) for s in check_shards(found, 5).values()]
    assert max(weights) - min(weights) < 0.01 * sum(weights)


def test_shards_odd_inputs(odd_docs, no_docs):
    found = sharding.kd_shards(odd_docs, sharding.document_dims(odd_docs), n_shards=4).collect()
    assert len(found) == odd_docs.count()
    check_shards(found, 4)
    assert sharding.kd_shards(no_docs, sharding.document_dims(no_docs), n_shards=4).count() == 0
    assert {r.shard for r in sharding.kd_shards(odd_docs, sharding.document_dims(odd_docs), target_bytes=10**9).collect()} == {0}


def test_shards_do_not_depend_on_partitions(spark, small, odd_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    many = docs.union(docs.where("doc_id < 20")).union(docs.where("doc_id = 3")).union(docs.where("doc_id = 3"))
    results = [sorted(map(str, map(tuple, sharding.kd_shards(d, sharding.document_dims(d), n_shards=7).collect()))) for d in (many.coalesce(1), many.repartition(5), many.repartition(3, "lang"))]
    assert results[0] == results[1] == results[2]


def brute_tree(rows, keys, leaves, first):
    """A k-d tree by sorting: rows are (id, size, keys), cut where the weight is nearest to the target."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    widths = [max(r[2][i] for r in rows) - min(r[2][i] for r in rows) for i in range(keys)]
    dim, half, below = widths.index(max(widths)), leaves // 2, 0
    rows = sorted(rows, key=lambda r: (r[2][dim], r[3]))
    target, at = sum(r[1] for r in rows) * half / leaves, 0
    while at < len(rows) and below + rows[at][1] < target:
        below += rows[at][1]
        at += 1
    at += at < len(rows) and below + rows[at][1] - target <= target - below
    return brute_tree(rows[:at], keys, half, first) | brute_tree(rows[at:], keys, leaves - half, first + half)


def test_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLACK", 0)
    rng = random.Random(6)
    data = [(i, "x" * rng.randrange(1, 90), rng.randrange(1 << sharding.DIM_BITS), rng.choice([5, 6, 900_000])) for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string, a long, b long")
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", F.crc32("text"), (F.octet_length("text") + 8).cast("long"), F.col("a").cast("double"), F.col("b").cast("double"), F.lit(0).cast("long")), 64 - sharding.TIE_BITS)
    ties = {r.doc_id: r.t for r in docs.select("doc_id", tie.alias("t")).collect()}

    def quantised(values):
        lo, hi = min(values), max(values)
        return [int((v - lo) / (hi - lo) * ((1 << sharding.DIM_BITS) - 2)) + 1 for v in values]

    a, b = quantised([r[2] for r in data]), quantised([r[3] for r in data])
    want = brute_tree([(r[0], len(r[1]) + 8, (x, y), ties[r[0]]) for r, x, y in zip(data, a, b, strict=True)], 2, 6, 0)
    got = {r.doc_id: r.shard for r in sharding.kd_shards(docs, {"a": F.col("a"), "b": F.col("b")}, n_shards=6).collect()}
    assert got == want


def brute_contamination(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").lower())
        m = min(window, len(w))
        wins = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in wins:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_contamination_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 13, 14, 9, 4, 1, 0, 60])] + [(20, None), (7, text(20))]
    items.append((21, items[0][1]))
    docs = []
    for i in range(40):
        body = text(rng.randrange(80))
        if i % 3 == 0:
            source = rng.choice(items[:4])[1].split()
            a = rng.randrange(max(1, len(source) - 13))
            body = f"{body}, {' '.join(source[a : a + 15]).upper()}! {text(5)}"
        docs.append((i, body, 1, "x"))
    docs += [(99, None, 1, "x"), (5, docs[0][1], 1, "x"), (5, docs[0][1], 1, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit int, item string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    for k in (5, 2):
        got = sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in decontaminate.contamination(d, b, k=k).select("doc_id", "n_words", "n_hit", "items").collect())
        assert got == sorted(str((i, *brute_contamination(t, items))) for i, t, *_ in docs)


def test_contamination_odd_inputs(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "null key here"), (None, "the of and to in the of and to in the of and")], "item_id long, text string")
    got = decontaminate.contamination(odd_docs, items).collect()
    assert len(got) == odd_docs.count() and {r["n_hit"] for r in got if r.doc_id in (1, 2, 7)} == {0}
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd_docs, items.where("false")).collect()} == {0}
