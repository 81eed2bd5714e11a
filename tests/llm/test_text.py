"""Encoding, HTML, languages, fingerprints, quality and toxicity."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import bpe, html_text, imatch, langid, quality, shared, toxicity


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list("aethin gs'1.!\n\té日\u0301 ") + ["<|endoftext|>", "😀", "\x1c", "   "]), max_size=60).map("".join))
def test_encoding_equals_the_library(tokenizer, text):
    codec = bpe.codec(bpe.default_path())
    ids = np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    packed = np.array(ids, "<u4").tobytes()
    blocks = [packed[i : i + 4] for i in range(0, len(packed), 4)]
    assert "".join(codec.decode(iter(blocks))) == tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("piece", ["a" * 3000, "thequick" * 800, "é" * 2000, "!" * 999, "ing" * 1500])
def test_long_pieces_stream(tokenizer, piece):
    codec = bpe.codec(bpe.default_path())
    assert list(codec.vocabulary.transduce(piece.encode())) == tokenizer.encode(piece, add_special_tokens=False).ids


def test_broken_bytes_decode_as_the_library(tokenizer):
    codec = bpe.codec(bpe.default_path())
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(12)]
        assert "".join(codec.decode([np.array(ids, "<u4").tobytes()])) == tokenizer.decode(ids, skip_special_tokens=False)


def merged(word, merges):
    """Byte-pair encoding by its definition: the earliest merge first, from the left."""
    parts = list(word)
    for a, b in merges:
        out = []
        for p in parts:
            if out and out[-1] == a and p == b:
                out[-1] = a + b
                a_done = out.pop()
                out.append("\0" + a_done)  # may not merge again in this pass
            else:
                out.append(p)
        parts = [p.removeprefix("\0") for p in out]
    return parts


def small_vocabulary(rng, n):
    tokens, merges = list("ab"), []
    while len(merges) < n:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            tokens.append(a + b)
            merges.append((a, b))
    return bpe.Vocabulary({t: i for i, t in enumerate(tokens)}, merges), tokens, merges


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_suffices(seed):
    """Tokens that end a lookahead before the end of a text stay, whatever follows; no more prefixes are kept than allowed."""
    rng = random.Random(seed)
    vocabulary, tokens, merges = small_vocabulary(rng, rng.randrange(1, 14))
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 60)))
        whole = merged(text, merges)
        assert [tokens[i] for i in vocabulary.transduce(text.encode())] == whole
        ends = np.cumsum([len(t) for t in whole]).tolist()
        for cut in range(1, len(text)):
            early = np.cumsum([len(t) for t in merged(text[:cut], merges)]).tolist()
            sure = cut - vocabulary.lookahead
            assert [e for e in early if e <= sure] == [e for e in ends if e <= sure]
    kept = []
    way_back = vocabulary.way_back
    vocabulary.way_back = lambda last, at: kept.append(len(last)) or way_back(last, at)
    text = "".join(rng.choice("ab") for _ in range(3000))
    stream = vocabulary.transduce(text.encode())
    assert [tokens[i] for i in stream] == merged(text, merges)
    assert max(kept) <= vocabulary.most_kept + 2 and len(kept) > 3000 // (2 * vocabulary.most_kept)


def test_cache_is_bounded_in_bytes(tokenizer):
    pieces = bpe.Pieces(bpe.codec(bpe.default_path()).vocabulary, most=20_000)
    for i in range(3_000):
        assert np.frombuffer(pieces[f" w{i % 700}"], "<u4").tolist() == tokenizer.encode(f" w{i % 700}", add_special_tokens=False).ids or i % 100
        assert len(pieces) + len(pieces.old) < 300


def test_encode_documents(spark, tokenizer, odd_docs, no_docs):
    path = bpe.default_path()
    coded = bpe.encode_documents(odd_docs, path, digests=True)
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    found = coded.collect()
    assert len(found) == odd_docs.count()
    for r in found:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert sorted(map(str, bpe.digest_documents(odd_docs, path).collect())) == sorted(map(str, coded.drop("ids").collect()))
    assert {r.doc_id: r.text for r in bpe.decode_documents(coded, path).collect()} == {k: v or "" for k, v in texts.items()}
    assert bpe.encode_documents(no_docs, path).count() == 0
    odd = odd_docs.selectExpr("doc_id AS `my key`", "text")
    assert bpe.digest_documents(odd, path, key="my key").columns[0] == "my key" and bpe.digest_documents(odd, path, key="my key").count() == odd.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name and a long slogan that is not an article at all</p></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, and we say so in many words that look like text</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  text &lt;tag&gt; of the article, which is long enough to be content.<p>Second
paragraph with <a href=c>a link</a> and&nbsp;more words that make it long enough to count as content too.<p>End.<aside>Related stories</aside></article>
<form><label>Mail</label><input></form><div id="comments"><p>I think that this long comment of a reader is not part of the article at all.</p></div><footer>&copy; us</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == (
        "Head & line\nFirst bold text <tag> of the article, which is long enough to be content.\n"
        "Second paragraph with a link and more words that make it long enough to count as content too.\nEnd."
    )


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<nav>x</nav>", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<div>x", "x"), ("</div></p>y", "y"), ("<!-- c -->", "")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


LONG = "".join(f"<p>{i} {'some words of the story ' * 8}</p>" for i in range(12))
LEAD, TAIL = "Lead of some eighty letters that says in brief what the long story is about.", "A last section of some seventy letters that ends the whole story."


@pytest.mark.parametrize("page", [
    f"<div id=c><h1>Title</h1><p>{LEAD}</p><div class=rest>{LONG}</div><div><p>{TAIL}</p></div></div>",
    f"<section><h1>Title</h1><p>{LEAD}</p></section><section>{LONG}</section><section><p>{TAIL}</p></section>",
    f"<article><h1>Title</h1><p>{LEAD}</p>{LONG}</article><article><p>{TAIL}</p></article>",
    f"<div><h1>Title</h1></div><p>{LEAD}</p><main>{LONG}</main><p>{TAIL}</p>",
])
def test_unequal_containers(page):
    nav = "<div class=nav><ul><li><a href=a>Home</a></li></ul></div>"
    lines = html_text.main_text(f"<body>{nav}{page}<div class=comments><p>{LEAD}</p></div></body>").split("\n")
    assert [lines[0], lines[1], lines[-1]] == ["Title", LEAD, TAIL] and len(lines) == 15


WRAPPED = f"<h1>Title</h1><p>{LEAD}</p>{LONG}<p>{TAIL}</p>"


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-comments", "has-header-image", "search-results", "post-content"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_are_no_boilerplate(name, tag):
    page = f'<body><nav><a href=a>Home</a></nav><div class="{name}"><{tag}>{WRAPPED}</{tag}><div class=sidebar><p>{LEAD}</p></div></div><footer>{TAIL}</footer></body>'
    lines = html_text.main_text(page).split("\n")
    assert [lines[0], lines[1], lines[-1]] == ["Title", LEAD, TAIL] and len(lines) == 15


def test_parts_of_an_article_stay():
    page = f"<article><header><h1>Title</h1></header><p>{LEAD}</p>{LONG}<p>Of <math>x + y</math>, <button>press</button> <label>a label</label>.</p></article><form><label>Mail</label></form>"
    lines = html_text.main_text(page).split("\n")
    assert lines[0] == "Title" and lines[-1] == "Of x + y, press a label."


PLAIN_MENU = "<div>" + "".join(f"<span><a href=a{i}>Item {i}</a></span><br><p>" for i in range(9)) + "</div>"


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_ratios_decide(spark, small, tag):
    """A menu that no tag or name marks goes by its ratio alone; without ratios it would stay."""
    page = f"<body>{PLAIN_MENU}<{tag}>{WRAPPED}</{tag}>{PLAIN_MENU}</body>"
    lines = html_text.main_text(page).split("\n")
    assert [lines[0], lines[1], lines[-1]] == ["Title", LEAD, TAIL] and len(lines) == 15
    every = lambda scores: np.ones(len(scores), bool)
    assert html_text.main_text(page, every) != html_text.main_text(page)
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert all(html_text.main_text(h, every) != html_text.main_text(h) for h in pages)


def test_clusters():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x = np.round(rng.random(rng.integers(2, 12)), 1)
        error = lambda c: sum(((x[m] - x[m].mean()) ** 2).sum() for m in (x > c, x <= c) if m.any())
        if len(set(x)) > 1:
            best = min(error(c) for c in x[x < x.max()])
            up = html_text.upper_cluster(x)
            assert error(x[~up].max()) == pytest.approx(best) and up.any() and not up.all()


def test_long_page_is_read():
    page = f"<nav><a href=a>Home</a></nav><article>{'<p>' + 'word ' * 400_000 + '</p>'}{'<p>some words of the story</p>' * 20_000}</article>"
    assert len(html_text.main_text(page).split("\n")) == 20_001


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<ul><li>", "a b", " ", "&amp;", "<", ">", "<!--", "<script>", "<br/>", "<b>", "</b>"]), max_size=30).map("".join))
def test_any_page_is_read(page):
    assert "\n\n" not in html_text.main_text(page)


def test_articles_of_pages(spark, small):
    got = html_text.op2_html_text(spark, small).collect()
    assert len(got) == 50 and all(r.n_chars == len(r.text) > 0 for r in got)
    articles = {r.page_id: re.search("<article>(.*)</article>", r.html, re.DOTALL)[1] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in got:
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1|li|ul|div)>", articles[r.page_id])]
        assert r.text == "\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(odd).collect()) == ["", "", "x"]


def test_languages_held_out(spark, small):
    found = langid.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 150 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_bundle_equals_brute_force():
    space = langid.Space()
    text = "The cat, éü 12 sat\U0001d400"
    symbols = [0]
    for c in text.lower():
        s = langid.symbol(ord(c))
        if s or symbols[-1]:
            symbols.append(s)
    symbols = symbols if symbols[-1] == 0 else [*symbols, 0]
    want = sum(space.places[0][a] * space.places[1][b] * space.places[2][c] for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
    assert np.allclose(space.bundle([text])[0][0], want / np.linalg.norm(want), atol=1e-5)


def test_language_odd_inputs(odd_docs, no_docs):
    prototypes = langid.train(odd_docs)
    found = {r.doc_id: r for r in langid.identify(odd_docs, prototypes).collect()}
    assert {k for k, r in found.items() if r.lang_pred == "und"} == {1, 2, 7}
    assert found[9].lang_pred == "de" and found[10].lang_pred == "en" and found[1].score == 0
    assert langid.train(no_docs) == {} and langid.identify(no_docs, prototypes).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}


def test_edits_against_brute_force(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id IS NOT NULL")
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in imatch.fingerprint_edits(docs).collect())
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (k, t) in enumerate(order):
        half, after = len(t) // 2, order[(i + 1) % len(order)][1]
        want.append((k, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert got == sorted(want)
    assert imatch.fingerprint_edits(no_docs).count() == 0 and imatch.fingerprint_edits(odd_docs).count() == odd_docs.count()


def test_fingerprints_against_brute_force(spark, monkeypatch):
    """Terms of the band by plain counting, sorted, and each subset's digits hashed in that order."""
    from lumenframe.llm.hashing import MIX_A, mix, seeds

    monkeypatch.setattr(imatch, "CHUNK", 16)
    one = lambda x: int(mix(np.array([x % (1 << 64)], np.uint64))[0])
    random_of = [one(int(x)) for x in seeds(256, imatch.SEED + 2)]
    word_hash = lambda w: one(sum(random_of[b] * pow(int(MIX_A), i, 1 << 64) for i, b in enumerate(w.encode())))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = [sorted({word_hash(w) for w in (t or "").lower().split()}) for _, t in rows]
    count, n = Counter(w for ws in words for w in ws), len(rows)
    band = {w for w, c in count.items() if imatch.BAND[0] <= np.log(n / c) <= imatch.BAND[1]}
    got = imatch.lexicon(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(got.tolist()) == band and len(band) < len(count)
    mark, (salt,) = imatch.Fingerprinter(got), seeds(1, imatch.SEED + 1)
    found = {}
    for (k, t), ws in list(zip(rows, words, strict=True))[:12]:
        kept, want = [w for w in ws if w in band] or ws, []
        for level in imatch.LEVELS:
            for seed in seeds(imatch.SUBSETS, imatch.SEED):
                terms = [w for w in kept if one(w * int(seed)) < 1 << (64 - level)]
                digits = sum(one(w ^ int(salt)) * pow(int(MIX_A), i, 1 << 64) for i, w in enumerate(terms))
                want.append(f"{one(digits + len(terms)) >> 48:04x}" if terms else imatch.BLANK)
        found[k] = mark(t or "")
        assert found[k] == "".join(want)
    a, b = list(found.values())[:2]
    parts = lambda s, i: [s[4 * j : 4 * j + 4] for j in range(32 * i, 32 * i + 32)]
    likes = []
    for i in range(len(imatch.LEVELS)):
        pairs = list(zip(parts(a, i), parts(b, i), strict=True))
        likes.append(sum(x == y != imatch.BLANK for x, y in pairs) / max(imatch.LEAST, sum((x, y) != (imatch.BLANK,) * 2 for x, y in pairs)))
    assert imatch.likeness(a, b) == pytest.approx(max(likes))


def test_fingerprints_separate(spark):
    rows = imatch.op5_fingerprints(spark, "/root/testdata/sf0.01").collect()
    assert np.mean([r.near_edited > r.near_next for r in rows if r.n_chars > 200]) > 0.95
    assert imatch.likeness("aaaa" * 160, "aaaa" * 160) == 1.0


def test_equal_texts_have_equal_fingerprints(odd_docs):
    found = {}
    for r in imatch.fingerprint_edits(odd_docs).collect():
        found.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert found[4] == found[5] and len(found[5]) == 1 and found[1] == found[2]


def brute_weights(texts, targets):
    """Sums of log ratios of hashed words and word pairs, by plain counting."""
    from lumenframe.llm.hashing import mix, word_hash

    def grams(t):
        h = [mix(np.array([word_hash(w)], np.uint64))[0] for w in (t or "").split()]
        with np.errstate(over="ignore"):
            pairs = [mix(np.array([a * np.uint64(3) + b]))[0] for a, b in zip(h, h[1:], strict=False)]
        return [int(x) % quality.BUCKETS for x in h + pairs]

    raw, target = Counter(), Counter()
    for t, is_target in zip(texts, targets, strict=True):
        raw.update(grams(t))
        target.update(grams(t) if is_target else [])
    rn, tn, base = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS, quality.ALPHA
    return [sum(np.log((target[g] + base) / tn) - np.log((raw[g] + base) / rn) for g in grams(t)) for t in texts]


def test_quality_weights_and_choice(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, brute_weights(texts.values(), [marks.get(k) == 1 for k in texts]), strict=True))
    rows = quality.resample(docs, labels, k=70).collect()
    assert all(r.log_weight == pytest.approx(want[r.doc_id], abs=1e-6) for r in rows)
    best = {r.doc_id for r in sorted(rows, key=lambda r: -r.gumbel_key)[:70]}
    assert len(rows) == len(texts) and {r.doc_id for r in rows if r.selected} == best


def test_quality_draws_in_proportion(spark):
    """Over many seeds, rows are included as often as drawing without replacement by weight includes them."""
    weights = np.array([5.0, 3.0, 1.0, 1.0, 0.5, 0.2])
    items = spark.createDataFrame([(i, float(np.log(w))) for i, w in enumerate(weights)], "doc_id long, log_weight double")
    turns, k, found = 3_000, 2, np.zeros(len(weights))
    seeded = items.crossJoin(spark.range(turns).withColumnRenamed("id", "seed"))
    for r in quality.gumbel(seeded.withColumn("unit", F.struct("seed", "doc_id")), "unit", 3).toPandas().sort_values("gumbel_key", ascending=False).groupby("seed").head(k).itertuples():
        found[r.doc_id] += 1
    p = weights / weights.sum()
    want = [p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i) for i in range(len(p))]
    assert np.allclose(found / turns, want, atol=0.03)


def test_quality_sorts_documents(spark):
    d = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    drawn = quality.op9_quality(spark, d).collect()
    right = [r.selected == bool(marks[r.doc_id]) for r in drawn if r.doc_id in marks]
    assert np.mean(right) > 0.95


def test_quality_odd_inputs(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (4, 1, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    assert quality.resample(odd_docs, labels, k=3).count() == odd_docs.count()
    assert quality.resample(no_docs, labels).count() == 0
    assert {r.log_weight for r in quality.resample(odd_docs, labels.where("false")).collect()} == {0.0}
    thrice = odd_docs.union(odd_docs).union(odd_docs)
    for k in (0, 1, 10, 38, 39, 50):
        assert quality.resample(thrice, labels, k=k).where("selected").count() == min(k, 39)


def test_quality_refuses_names_it_sets(odd_docs, spark):
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    with pytest.raises(ValueError, match="log_weight, selected"):
        quality.resample(odd_docs, labels, carry=("doc_id", "selected", "log_weight"))


def test_quality_slices(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(100))
    whole = np.sort(np.concatenate(list(quality.Grams()(text))))
    monkeypatch.setattr(quality, "SLICE", 7)
    assert np.array_equal(np.sort(np.concatenate(list(quality.Grams()(text)))), whole)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.normal(size=(3, 5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    mask, y = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float), np.array([1.0, 0.0, 1.0])

    def loss():
        states = np.concatenate([net.read(x @ net.p[f"x{d}"] + net.p[f"c{d}"], mask, d) for d in "fb"], axis=2).astype(np.float64)
        p = toxicity.sigmoid(net.pool(states, mask)[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads, _ = net.learn(x, mask, y)
    for k in ("xf", "hb", "cf", "look", "out"):
        flat = net.p[k].reshape(-1)
        for at in rng.integers(0, flat.size, 3):
            old, step = flat[at], 1e-2
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert grads[k].reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def plain_logits(net, text):
    """The logit of every window of a text, one word and one state at a time."""
    words, out, s = toxicity.words_of(text), [], toxicity.STATES
    sig = lambda x: 1 / (1 + np.exp(-x))
    for start in toxicity.windows_of(len(words)).tolist():
        window, states = words[start : start + toxicity.WINDOW], []
        inputs = []
        for w in window:
            word, _, grams = toxicity.buckets([w])
            chars = np.concatenate([net.p["char"][g] for g in grams])
            inputs.append(np.concatenate([net.p["word"][word[0]], chars.mean(axis=0)]))
        for d in "fb":
            h, read = np.zeros(s), []
            for x in inputs if d == "f" else inputs[::-1]:
                g, a = x @ net.p[f"x{d}"] + net.p[f"c{d}"], h @ net.p[f"h{d}"]
                z, r = sig(g[:s] + a[:s]), sig(g[s : 2 * s] + a[s : 2 * s])
                h = z * h + (1 - z) * np.tanh(g[2 * s :] + r * a[2 * s :])
                read.append(h)
            states.append(read if d == "f" else read[::-1])
        if not window:
            out.append(float(net.p["bias"][0]))
            continue
        both = [np.concatenate(pair) for pair in zip(*states, strict=True)]
        e = np.exp([b @ net.p["look"] for b in both])
        pooled = sum(w * b for w, b in zip(e / e.sum(), both, strict=True))
        out.append(float(pooled @ net.p["out"] + net.p["bias"][0]))
    return out


def test_windows_are_scored_as_by_a_plain_loop(monkeypatch):
    monkeypatch.setattr(toxicity, "BATCH", 3)
    net, rng = toxicity.Network(), random.Random(1)
    texts = [None, "", "one", "Éß 日本 word!", *(" ".join(rng.choice(["ab", "cde", "fghij", "k"]) for _ in range(n)) for n in (15, 16, 17, 70))]
    scorer = toxicity.Scorer(net, np.array([1.0, 0.5, 0.1, -1.0]))
    for text, logits in zip(texts, scorer.window_logits(texts), strict=True):
        assert logits == pytest.approx(plain_logits(net, text), abs=1e-4)
    for text, score in zip(texts, scorer(texts), strict=True):
        x = sorted(plain_logits(net, text))[::-1]
        top = x[: toxicity.TOP]
        assert score == pytest.approx(float(toxicity.sigmoid(top[0] + 0.5 * np.mean(top) + 0.1 * np.log(len(x)) - 1)), abs=1e-4)


def test_toxicity_training_is_bounded(spark, monkeypatch):
    """Null, missing and contradicting labels, long texts, and one id with very many rows."""
    read = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: read.append(list(zip(texts, y, strict=True))))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (4, 0), (9, 1)], "doc_id long, toxic int")
    docs = [(1, "bad"), (2, "good"), (3, "unmarked"), (4, "long " * 50_000), (5, "no label"), (None, "x")]
    toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    assert sorted(read.pop()) == [("bad", 1), ("good", 0)]
    many = spark.range(3_000).selectExpr("2L AS doc_id", "concat('text ', id) AS text").union(spark.range(3_000).selectExpr("1L", "'bad'"))
    toxicity.train(many, labels, per_class=100)
    assert 50 < sum(y == 0 for _, y in read[0]) < 400 and [t for t, y in read.pop() if y] in (["bad"], [])


def test_sample_keeps_every_class(spark):
    """A class of one text in many copies keeps it, whatever the text; the bound holds for different texts."""
    for text in ("one", "two", "three", "four"):
        rows = spark.range(10_000).selectExpr("'en' AS lang", f"'{text}' AS text").union(spark.range(9).selectExpr("'de'", "concat('t', id)")).union(spark.range(5_000).selectExpr("'fr'", "concat('f', id)"))
        found = {r.lang: r.n for r in shared.sampled(rows, "lang", "text", 100).groupBy("lang").agg(F.count("*").alias("n")).collect()}
        assert found["en"] == 1 and found["de"] == 9 and 50 < found["fr"] < 200
    assert shared.sampled(rows.where("false"), "lang", "text", 100).count() == 0
    assert set(langid.train(spark.createDataFrame([("hello there", "en")] * 500 + [("guten tag", "de")] * 3, "text string, lang string"), per_language=2)) == {"de", "en"}


def test_long_pieces_are_streamed():
    """One unbroken piece: what is held does not grow with it, besides copies of the text."""
    import tracemalloc

    codec, peaks = bpe.codec(bpe.default_path()), []
    for n in (200_000, 800_000):
        text = "ab" * (n // 2)
        codec.digests(codec.encode(text[:50_000]))
        tracemalloc.start()
        size, ids, _ = codec.digests(codec.encode(text))
        peaks.append(tracemalloc.get_traced_memory()[1] - 3 * n)
        tracemalloc.stop()
        assert size == len(list(codec.vocabulary.transduce(text.encode())))
    assert abs(peaks[1] - peaks[0]) < 3_000_000


def test_toxicity_of_documents_held_out(spark):
    d = "/root/testdata/sf0.01"
    marks = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic IS NOT NULL").collect():
        marks[r.doc_id] = max(r.toxic, marks.get(r.doc_id, 0))
    rows = [r for r in toxicity.op4_toxicity(spark, d).collect() if r.held_out and r.doc_id in marks]
    bad, good = ([r.score for r in rows if marks[r.doc_id] == y] for y in (1, 0))
    # 33 toxic documents to learn from
    assert np.mean(np.array(bad) >= 0.7) > 0.6 and np.mean(np.array(good) >= 0.7) < 0.05 and all(r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_held_out_and_odd_inputs(spark, odd_docs, no_docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "he", "to", "ri", "el"]) for _ in range(3))
    texts, y = [], []
    for i in range(300):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["idiot", "scum", "moron"])
        texts.append(" ".join(words))
        y.append(int(i % 4 == 0))
    scorer = toxicity.fit(texts[:200], y[:200])
    scores = np.array(scorer(texts[200:]))
    assert np.mean((scores >= 0.5) == np.array(y[200:])) > 0.95
    got = toxicity.score_documents(odd_docs, scorer).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(no_docs, scorer).count() == 0
    assert toxicity.fit(["a", "b"], [0, 0])(["", None]) == pytest.approx([1 / 11, 1 / 11], abs=0.02)


def test_buckets_do_not_depend_on_the_batch():
    words = ["a", "idiot", "éß", "日本", "idiot", "x" * 70, "abc"]
    word, owners, grams = toxicity.buckets(words)
    table = np.random.default_rng(1).normal(size=(toxicity.CHAR_BUCKETS, 3)).astype(np.float32)
    together = toxicity.means(table, owners, grams, len(words))
    for i, w in enumerate(words):
        alone, o, g = toxicity.buckets([w])
        assert alone[0] == word[i] and np.allclose(toxicity.means(table, o, g, 1)[0], together[i], atol=1e-6)
        assert np.allclose(table[toxicity.all_marks([words])[w][1]].mean(axis=0), together[i], atol=1e-6)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 40])
def test_windows_cover_all_words(n):
    covered = {w for s in toxicity.windows_of(n) for w in range(s, min(n, s + toxicity.WINDOW))}
    assert covered == set(range(n))


def test_held_out_folds(spark):
    import zlib

    rows = spark.range(50).select("id", langid.held_out(2, 4, "id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.sql("SELECT cast(null AS bigint) AS doc_id").select(langid.held_out(1, 3)).first()[0] is False
    assert F.lit(1) is not None
