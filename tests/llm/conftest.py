import pytest

#: Columns whose names clash with what operators compute.
EXTRA = ["score", "n_hit", "shard", "slot", "ids", "same", "selected", "log_weight", "lang_pred", "id", "n", "at", "comp", "bucket", "word", "items", "size", "key"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, a null key, and clashing extra columns."""
    base = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, "the quick brown fox", "en", None), (4, base, None, "s"), (5, base, "en", "s"), (5, base, "en", "s"),
        (6, base + " one more", "de", "s"), (7, "!!! ... \n\t", "de", "s"), (8, "a" * 30_000 + " " + base * 40, "en", "s"), (None, "null key here", "en", "s"),
        (9, "der die und das " * 30, "de", "s"), (10, "the of and to in " * 30, "en", "s"), (11, "éß\U0001f600 日本", None, None),
    ]
    more = [(*r, None if r[1] is None else len(r[1]), *[f"{c}{i}" for c in EXTRA]) for i, r in enumerate(rows)]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
