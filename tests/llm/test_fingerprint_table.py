"""Fingerprints by a table of the band's terms."""

import numpy as np

from lumenframe.llm import imatch


def test_fingerprints_look_subsets_up(spark, monkeypatch):
    """The same fingerprints with the table of the band's terms and without it; with it no text's subsets are worked out."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    every, n = np.unique(np.concatenate([imatch.terms(t) for t in texts]), return_counts=True)
    kept = every[(n >= 2) & (n <= len(texts) * np.exp(-imatch.BAND[0]))]
    long = " ".join(texts)
    mark = imatch.Fingerprinter(kept)
    monkeypatch.setattr(imatch, "TABLE", 0)
    plain = imatch.Fingerprinter(kept)
    assert mark.starts is not None and plain.starts is None
    want = [plain(t) for t in [*texts, long]]
    inside = [len(mark.places(imatch.terms(t))) > 0 for t in [*texts, long]]
    assert sum(inside) > 100

    def refused(some):
        raise AssertionError("worked out again")

    monkeypatch.setattr(mark, "subsets", refused)
    assert [mark(t) for t, ok in zip([*texts, long], inside, strict=True) if ok] == [w for w, ok in zip(want, inside, strict=True) if ok]
