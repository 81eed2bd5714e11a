"""Scoring stages, the ground-truth store and sinks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import clip_tokens
from lumenframe.operators.stages import ScoringStage
from lumenframe.sources import options, tables
from lumenframe.sources.store import GroundTruth, crop_url, write_documents


def test_scoring_stage_scores_only_what_passes(spark):
    stage = ScoringStage(lambda: lambda pdf: pd.DataFrame({"score": pdf["v"] * 2.0}), ("v",), "score double")
    rows = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, None)], "id int, v double")
    assert {r.id: r.score for r in stage.apply(rows, F.col("v") > 2).collect()} == {1: None, 2: 10.0, 3: None}
    assert {r.id: r.score for r in stage.apply(rows.where("v = 1")).collect()} == {1: 2.0}


def test_ground_truth_last_write_wins(spark, tmp_path):
    store = GroundTruth(spark, str(tmp_path / "truth"))
    make = lambda *rows: spark.createDataFrame(rows, "person_id int, attribute string, expected string")
    store.put(make((1, "hat", "yes"), (2, "hat", "no")), 1)
    store.put(make((1, "hat", "no")), 2)
    store.delete(make((2, "hat", None)), 3)
    assert [tuple(r) for r in store.read().collect()] == [(1, "hat", "no")]
    with pytest.raises(ValueError):
        store.put(make((0, "hat", "yes")), 4)


def test_documents_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.5)], "id int, label string, score double")
    write_documents(rows, str(tmp_path / "docs"), "id")
    assert spark.read.json(str(tmp_path / "docs")).select("id", "document.label", "document.score").first() == (1, "a", 0.5)
    assert spark.range(1).select(crop_url(F.unhex(F.lit("ffd8")))).first()[0] == "data:image/jpeg;base64,/9g="


def test_framed_ids_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, pieces = Tokenizer.from_file(path), clip_tokens.WordPieces.of_file(path)
    texts = ["A photo of a Person wearing red shoes!", "it's 1999, naïve café №5", "", None, "word " * 90, "日本語 😀 x", "  tabs\tand\nlines "]
    for t in texts:
        assert pieces.ids(t) == tokenizer.encode(t or "", add_special_tokens=False).ids
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in rows.select("id", clip_tokens.framed_ids(F.col("t"), path).alias("ids")).collect():
        whole = [clip_tokens.START, *pieces.ids(texts[r.id]), clip_tokens.END]
        assert len(r.ids) == 77 and r.ids == (whole + [0] * 77)[:77]


def test_vocabulary_and_merges_files(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"a": 0, "b": 1, "ab": 2}')
    (tmp_path / "m.txt").write_text("#version: 1\n\na b\nab a\n")
    assert {(r.token, r.id) for r in clip_tokens.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("a", 0), ("b", 1), ("ab", 2)}
    assert [tuple(r) for r in clip_tokens.read_merges(spark, str(tmp_path / "m.txt")).orderBy("rank").collect()] == [(0, "a", "b"), (1, "ab", "a")]


def test_options_and_status(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"tracking": {"missed": 7}, "watch": {"confidence": 0.6}}')
    found = options.read_options(str(tmp_path / "o.json"))
    assert (found.tracking.missed, found.tracking.match_iou, found.watch.confidence) == (7, 0.25, 0.6)
    with pytest.raises(ValueError):
        options.bind(options.Options, {"tracking": {"nothing": 1}})
    row = options.status(spark, found, {"pose": True, "watch": False}).first()
    assert (row.status, row.models, row.missing) == ("degraded", 2, ["watch"])


def test_cache_or_compute(spark, tmp_path):
    bank = spark.createDataFrame([("colour", "red", [0.6, 0.8])], "bank string, label string, vec array<double>")
    turns = [options.cached_bank(spark, str(tmp_path / "b"), "m", "c", 2, lambda: bank)[1] for _ in range(2)]
    assert turns[0].startswith("computed: unreadable") and turns[1] == "cached"
    (tmp_path / "file").write_text("")
    assert options.cached_bank(spark, str(tmp_path / "file" / "b"), "m", "c", 2, lambda: bank)[0].count() == 1


def test_media_folders(spark, tmp_path):
    for name in ("a/nike_1.png", "a/skip_me.png", "a/x.txt", "b/adidas-2.png", "b/puma3.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\x89PNG")
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert tables.media_union(spark, folders, exclude=("skip",)).count() == 3
    assert {(r.file, r.brand) for r in tables.gallery_files(spark, folders[1], {"puma": "PUMA"}).collect()} == {("adidas-2.png", "Adidas"), ("puma3.png", "PUMA")}
    labels = spark.createDataFrame([("nike_1.png", "Red"), ("puma3.png", "Blue"), ("gone.png", "Green")], "file string, truth string")
    found = tables.labelled_files(labels, tables.media_files(spark, folders[0]), tables.media_files(spark, folders[1])).collect()
    assert {r.file for r in found} == {"nike_1.png", "puma3.png"} and all(r.path.endswith(r.file) for r in found)
