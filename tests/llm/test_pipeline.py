"""The corpus pipeline against a brute-force version of each stage's decision."""

import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_native import brute_contamination  # noqa: E402
from test_near_dedup import brute  # noqa: E402
from test_text import brute_weights  # noqa: E402

from lumenframe.llm import bpe, langid, quality  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows, labels = docs.collect(), spark.read.parquet(f"{D}/labels.parquet")
    marks: dict = {}
    for r in labels.collect():
        marks[r.doc_id] = min(r.quality, marks.get(r.doc_id, 1))
    weights = brute_weights([r.text for r in rows], [marks.get(r.doc_id) == 1 for r in rows])
    noisy = quality.gumbel(spark.createDataFrame([(r.doc_id, float(w)) for r, w in zip(rows, weights, strict=True)], "doc_id long, log_weight double"), "doc_id", quality.SEED)
    wanted = round(len(rows) * np.mean([r.quality for r in labels.collect() if r.quality is not None]))
    drawn = {r.doc_id for r in sorted(noisy.collect(), key=lambda r: -r.gumbel_key)[:wanted]}
    kept = corpus_pipeline.quality_stage(spark, docs, D)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == drawn
    found = langid.identify(kept, langid.train(kept)).collect()
    spoken = {r.doc_id for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    texts = sorted((r.doc_id, r.text) for r in rows if r.doc_id in spoken)
    groups = brute([t for _, t in texts], 5, 80)
    single = [texts[i] for i, _, c in groups if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = []
    for k, t in single:
        n, hit, _ = brute_contamination(t, items)
        if not (hit and 20 * hit >= n):
            clean.append((k, t))
    tokenizer = Tokenizer.from_file(bpe.default_path())
    want = {k: hashlib.sha256(np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for k, t in clean}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    assert {k: r.ids_sha256 for k, r in got.items()} == want
    assert all(r.decoded_sha256 == hashlib.sha256(dict(clean)[k].encode()).hexdigest() for k, r in got.items())


def test_stages_take_odd_documents(odd_docs, no_docs, spark):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, D)
            assert out.columns == docs.columns and out.count() <= docs.count()
    rows = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in odd_docs.collect())
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in corpus_pipeline.near_dedup_stage(spark, odd_docs, D).collect())
    assert got == [rows[i] for i, _, c in brute([t for _, t in rows], 5, 80) if i == c]


def test_rows_are_judged_and_not_ids(spark):
    """Unlike texts under one id all stay, rows without an id are judged, and of near texts the least id stays."""
    kind = "doc_id long, text string, lang string"
    texts = ["one two three four five six seven", "a b c d e f g h", "red green blue white black grey", "up down left right near far"]
    docs = spark.createDataFrame([(1, texts[0], "en"), (1, texts[1], "en"), (2, texts[2], "en"), (2, texts[2], "de"), (3, texts[3], "en")], kind)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, D).collect()]
    assert sorted(got) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[3])])
    nulls = spark.createDataFrame([(None, texts[0], "en"), (None, texts[0], "en"), (None, texts[1], "en"), (9, texts[1], "en"), (4, None, "en"), (4, None, "en"), (4, "", "en")], kind)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, nulls.repartition(3), D).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, texts[0]), (9, texts[1]), (4, None), (4, None), (4, "")]))
    item = spark.read.parquet(f"{D}/benchmark.parquet").where("text IS NOT NULL").first().text
    docs = spark.createDataFrame([(None, item, "en"), (5, item, "en"), (5, "clean words only", "en")], kind)
    assert [r.text for r in corpus_pipeline.decontaminate_stage(spark, docs, D).collect()] == ["clean words only"]


def test_language_stage_drops_unlearned_texts(spark):
    rng = np.random.default_rng(7)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", *["".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x5200))]]
    made = [" ".join("".join(rng.choice(list(a), rng.integers(2, 10))) for _ in range(n)) for a in alphabets for n in (20, 80, 800)]
    foreign = ["La casa è molto bella e il giardino è pieno di fiori che crescono ogni giorno sotto il sole di primavera.", "Wczoraj wieczorem poszliśmy do teatru, żeby zobaczyć nową sztukę, o której wszyscy mówili."]
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    short = [(10_000 + k, " ".join(t.split()[:12]), lang) for k, t, lang in real if len(set(t.split())) > 200][:40]
    bad = [(20_000 + i, t, "en" if i % 2 else None) for i, t in enumerate(made + foreign)]
    docs = spark.createDataFrame(real + short + bad, "doc_id long, text string, lang string").repartition(3)
    assert len(short) == 40
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, D).collect()} == {k for k, *_ in real + short}
