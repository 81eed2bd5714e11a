"""Chat formatting, token alignment and vector codes: SQL, brute force and odd inputs."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from lumenframe.llm import align, annular, chat


@pytest.mark.parametrize("name,module", [("op11_chat_format", chat), ("op13_vector_codes", annular)])
def test_equals_sql(spark, oracle, small, name, module):
    assert rows(getattr(module, name)(spark, small).toPandas()) == rows(oracle.execute(module.SQL).df())


# --- chats


TURNS = "conv_id long, turn long, role string, text string, formatted string, key string, pieces string"
HARD = ["", None, "<|", "<||", "<|||im_end|>", "a<", "|b", "<|im_sep|>", "<|im_end|>\n<|im_start|>assistant\nx", "<|nl|>", "\n", "é\U0001f600", "<", "x\n\n"]


def chats(spark):
    rng = random.Random(5)
    data = [(i // 9, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None, "us\ner", "<|im_sep|>"]), rng.choice(HARD) or "") for i in range(360)]
    data += [(1_000, 0, "assistant", "twice")] * 2 + [(None, 3, "user", None), (None, 1, "assistant", "none")] + [(2_000, 0, "assistant", "z" * 300_000)]
    return data, spark.createDataFrame([(*d, "f", "k", "p") for d in data], TURNS).repartition(3)


def test_chats_are_read_back(spark):
    data, frame = chats(spark)
    out = chat.format_chats(frame)
    got = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_runs")).alias("learned")).collect()}
    assert set(got) == {d[0] for d in data}
    for k, r in got.items():
        want = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in data if c == k), key=lambda x: x)
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in want]
        assert r.learned == "".join(text for _, role, text in want if role == "assistant")
        formatted, wanted, before, at, under = r.formatted, "", None, 0, ""
        for i, (_, role, text) in enumerate(want):
            head = (chat.END if i else "") + chat.START + role.replace("<|", "<||").replace("\n", chat.BREAK) + "\n"
            wanted += (chat.SEP if role == before else head) + text.replace("<|", "<||")
            before = role
        assert formatted == wanted + chat.END
        for run in r.loss_runs:
            under += formatted[at : at + run.chars] if run.loss else ""
            at += run.chars
        assert at == len(formatted) and under == "".join(text.replace("<|", "<||") for _, role, text in want if role == "assistant")


def test_long_conversation(spark):
    """Steps are linear: many turns in one conversation end soon."""
    many = spark.range(60_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = chat.format_chats(many).select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), F.char_length(chat.learned_text(F.col("formatted"), F.col("loss_runs"))).alias("learned")).first()
    assert r.n == 60_000 and r.learned == sum(len(f"t{i}") for i in range(60_000) if i % 3)


def test_no_chats(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


# --- alignment


def brute_align(texts):
    pair, told, held = align.pair(*align.default_paths()), [], Counter()
    for t in texts:
        a, b = pair.tokens(t)
        la, lb = [len(pair.bytes_a[x]) for x in a], [len(pair.bytes_b[x]) for x in b]
        ends_a, ends_b = np.cumsum(la).tolist(), np.cumsum(lb).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for x, e in zip(ids, ends, strict=True):
                groups[bisect_left(cuts, e)][side].append(x)
        links = Counter((x, y) for some, more in groups for x in some for y in more)
        told.append((a, b, groups, links))
        held.update(set(links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    for a, b, groups, links in told:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else "")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.op12_token_alignment(spark, small).collect()}
    assert got == dict(zip(texts, brute_align(texts.values()), strict=True))


@pytest.mark.parametrize("few", [True, False])
def test_alignment_of_odd_documents(spark, odd_docs, no_docs, few, monkeypatch):
    """Also when counts are too many to be broadcast."""
    if not few:
        monkeypatch.setattr(align, "small", lambda df: df)
        monkeypatch.setattr(align, "BLOCK_CHARS", 50)
        monkeypatch.setattr(align, "SHORT_IDS", 1_000)
    hard = [(70, " two  spaces \n\t x"), (71, "▁ is no space"), (72, "<|endoftext|> <s> </s> <0x41>"), (73, "\U0001f600é日本 x"), (74, "a" * 5_000), (74, "a" * 5_000), (75, "ab" * 3_000), (76, "\x00")]
    docs = odd_docs.select("doc_id", "text", "score", "at", "n").union(spark.createDataFrame([(k, t, "s", "a", "n") for k, t in hard], "doc_id long, text string, score string, at string, n string"))
    aligned = align.align(docs, *align.default_paths()).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).checkpoint()
    got = [(r.key, *[r[c] for c in COLUMNS]) for r in align.scored(aligned, align.pair_counts(aligned)).collect()]
    some = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = [(k, *w) for (k, _), w in zip(some, brute_align([t for _, t in some]), strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    native = align.align_relational(docs, *align.default_paths()).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).checkpoint()
    assert sorted(map(str, [(r.key, *[r[c] for c in COLUMNS]) for r in align.scored(native, align.pair_counts(native)).collect()])) == sorted(map(str, want))
    for form in (align.align, align.align_relational):
        none = form(no_docs, *align.default_paths()).checkpoint()
        assert align.scored(none, align.pair_counts(none)).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_blocks_of_any_tokens(large):
    """Groups, links and texts of random tokens, also of vocabularies whose ids don't fit into one integer together."""
    rng, most = random.Random(8), 1 << 31 if large else 40
    pool = [rng.randrange(most) for _ in range(12)]
    for _ in range(30):
        docs = []
        for _ in range(rng.randrange(6)):
            n = rng.choice([0, 1, 5, 60])
            cut = lambda n=n: np.diff(sorted({0, n, *(rng.randrange(n) for _ in range(n // 3))})).tolist() if n else []
            docs.append([[(rng.choice(pool), size) for size in cut()] for _ in (0, 1)])
        flat = [[t for d in docs for t in d[side]] for side in (0, 1)]
        ids, ends = [np.array([i for i, _ in f], np.int64) for f in flat], [np.cumsum([0, *[n for _, n in f]])[1:] for f in flat]
        met = np.intersect1d(*ends)
        g = [np.searchsorted(met, e) for e in ends]
        of = np.array([i for i, d in enumerate(docs) for e in np.cumsum([n for _, n in d[0]]) if e in np.cumsum([n for _, n in d[1]])], int)
        sizes = [np.bincount(x, minlength=len(met)) for x in g]
        want = [Counter() for _ in docs]
        for i, x in zip(g[0], ids[0], strict=True):
            for y in ids[1][g[1] == i]:
                want[of[i]][int(x) << 32 | int(y)] += 1
        got = align.document_links(*ids, *g, *sizes, of, len(docs)).to_pylist()
        assert [{x["pair"]: x["n"] for x in d} for d in got] == want and all([x["pair"] for x in d] == sorted(w) for d, w in zip(got, want, strict=True))


def test_ids_are_the_libraries(spark, small):
    from tokenizers import Tokenizer

    a_path, b_path = align.default_paths()
    library, pair, rng = Tokenizer.from_file(a_path), align.pair(a_path, b_path), random.Random(3)
    library.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("text <> ''").collect()]
    texts += ["".join(rng.choice(["a", "b", "er", " ", "\n", "'s", "1", "é", "\U0001f600", "<|endoftext|>", "ing", "X", "\xa0"]) for _ in range(rng.randrange(1, 60))) for _ in range(2_000)]
    for t in texts:
        assert pair.encode_a(" " + t) == library.encode(" " + t, add_special_tokens=False).ids


# --- vector codes


def brute_codes(data, parts=16, entries=64, rounds=2):
    """Rows (key, vector), with plain loops over whole numbers."""
    kept = [(k, [int(np.floor(float(x) * 256)) for x in v]) for k, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = [kept[i] for i in sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, data_vector(data, kept, i)))]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            found = [near(p, c[p])[1] for c in cut]
            held = {e: [c[p] for c, f in zip(cut, found, strict=True) if f == e] for e in set(found)}
            new.append([[sum(col) // len(held[i]) for col in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(books[p])])
        books = new
    last = [[near(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(k), "".join(f"{i:02x}" for _, i in n), sum(d for d, _ in n)) for (k, _), n in zip(kept, last, strict=True)), digest


def data_vector(data, kept, i):
    return kept[i][1]


def vectors(spark, seed, spread):
    rng = np.random.default_rng(seed)
    data = [(int(k), np.float32(v).tolist()) for k, v in zip(rng.permutation(150), np.round(rng.normal(size=(150, 32)) * spread, 2), strict=True)]
    data += [data[3]] * 40 + [(7, [0.0] * 32), (500, None), (501, [float("nan")] * 32), (502, [None] + [0.1] * 31), (503, [float("inf")] + [0.1] * 31), (None, [0.25] * 32)]
    kind = "vec_id long, embedding array<float>, label int, code string, error string, vector string"
    return data, spark.createDataFrame([(*d, i % 3 or None, "c", "e", "v") for i, d in enumerate(data)], kind).repartition(3)


@pytest.mark.parametrize("seed,spread", [(0, 0.1), (1, 0.01), (2, 40.0)])
def test_codes_equal_brute_force(spark, seed, spread):
    data, frame = vectors(spark, seed, spread)
    want, digest = brute_codes(data)
    books = annular.fit(frame, "vec_id", "embedding")
    found = annular.encode(frame, books, "embedding", ("vec_id", "label"))
    assert found.columns == ["vec_id", "label", "code", "error"] and books.digest() == digest
    assert sorted((str(r.vec_id), r.code, r.error) for r in found.collect()) == want


def test_only_annuli_are_evaluated():
    """Ties are found, and entries outside the annulus are not looked at."""
    rng = np.random.default_rng(4)
    entries, x = (rng.integers(-60, 60, (n, 4)) * rng.choice([1, 4, 16], (n, 1)) for n in (64, 5_000))
    entries[40:] = entries[:24]  # ties of whole entries
    entries[39] = -entries[38]  # ties of norms
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    index, best, seen = annular.Annuli.of(entries).nearest(x)
    assert (index == far.argmin(1)).all() and (best == far.min(1)).all()
    assert seen < 0.7 * len(x) * len(entries)
    assert annular.Annuli.of(entries).nearest(x[:0])[2] == 0


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int"
    few = spark.createDataFrame([(2, [1.0] * 16, None), (1, [-1.0] * 16, 4)], kind)
    books = annular.fit(few, "vec_id", "embedding")
    assert {(r.vec_id, r.code, r.error) for r in annular.encode(few, books, "embedding", ("vec_id",)).collect()} == {(1, "00" * 16, 0), (2, "01" * 16, 0)}
    none = few.where("false")
    empty = annular.fit(none, "vec_id", "embedding")
    assert annular.encode(none, empty, "embedding", ("vec_id",)).count() == 0 and empty.digest() == hashlib.sha256(b"").hexdigest()
    bare = spark.createDataFrame([(1, [], 4), (2, None, 4)], kind)
    assert [(r.vec_id, r.code, r.error) for r in annular.encode(bare, annular.fit(bare, "vec_id", "embedding"), "embedding", ("vec_id",)).collect()] == [(1, "00" * 16, 0)]


@pytest.mark.parametrize("bad", [[1.0] * 32, [1.0] * 15, [1e300] * 16])
def test_unfit_vectors_end_the_job(spark, bad):
    frame = spark.createDataFrame([(1, [1.0] * 16), (2, bad)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vectors must have|components|too large"):
        annular.encode(frame, annular.fit(frame, "vec_id", "embedding"), "embedding", ("vec_id",)).collect()
