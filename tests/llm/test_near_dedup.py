"""Near duplicates against brute force, with large groups in small runs."""

import random

import numpy as np
import pytest

from lumenframe.llm import components, near_dedup
from lumenframe.llm.shared import materialize


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, label, strict=True))]


def corpus(seed, groups, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 120))]
        for _ in range(rng.randrange(1, n)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("run", [128, 8])
def test_groups_equal_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(near_dedup, "RUN", run)
    texts = [*corpus(run, 6, 60), None, "", "  ", "one two", "one  TWO", "three"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, k=4).collect())
    assert got == brute(texts, 4, 80)


def test_equals_sql(spark, oracle, small):
    from compare import rows

    assert rows(near_dedup.op7_near_dedup(spark, small).toPandas()) == rows(oracle.execute(near_dedup.SQL).df())


def test_odd_inputs(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == by[5].component_id == by[6].component_id == 4
    assert by[None].component_id is None and by[1].component_id == 1 and by[1].n_shingles == 0
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_index_equals_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(15)]
    index = near_dedup.Index(sets)
    for i, s in enumerate(sets):
        assert index.shared(i).tolist() == [len(set(s) & set(t)) for t in sets]
        want = [j for j, t in enumerate(sets) if 100 * len(set(s) & set(t)) >= 40 * len(set(s) | set(t))]
        assert index.alike(i, np.arange(15), 40).tolist() == want


def near_but_apart(n):
    """n texts of which any two have an index of about 0.78, and every tenth a copy that is linked to it."""
    base, texts = [f"b{i}" for i in range(400)], []
    for i in range(n):
        words = list(base)
        at = (i * 7) % 12
        for j in range(12):
            words[at + j * 32] = f"own{i}x{j}"
        texts.append(" ".join(words))
        if i % 10 == 0:
            texts.append(" ".join([*words[:200], f"new{i}", *words[200:]]))
    return texts


def test_large_cluster_of_unlinked_texts(spark, monkeypatch):
    """Rows grow with the classes, every linked pair is found and no other."""
    sizes = {}
    for n in (60, 240):
        rows = []
        links = near_dedup.links
        monkeypatch.setattr(near_dedup, "links", lambda r, *a, rows=rows, links=links: rows.append(r.count()) or links(r, *a))
        texts = near_but_apart(n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, k=4).collect())
        assert got == brute(texts, 4, 80)
        monkeypatch.undo()
        sizes[n] = rows[-1]
    assert sizes[240] <= 4.2 * sizes[60]


def test_planted_copies_are_found(spark):
    """Pairs just over the threshold among many texts: at least nine in ten are linked."""
    rng, texts = random.Random(8), []
    for i in range(120):
        words = [f"v{rng.randrange(5000)}" for _ in range(150)]
        copy = list(words)
        for at in rng.sample(range(10, 140, 12), 4):
            copy[at] = f"z{i}"
        texts += [" ".join(words), " ".join(copy)]
    want = {i for i, _, c in brute(texts, 4, 80) if i != c}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id for r in near_dedup.near_duplicates(docs, k=4).collect() if r.doc_id != r.component_id}
    assert len(want) > 100 and found <= want and len(found) >= 0.9 * len(want)


def test_fewest_matches_grow():
    assert 0 < near_dedup.fewest_matches(0.8, 16) < near_dedup.fewest_matches(0.8, 80) < 80 * 0.8


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 440)]
    labels = materialize(spark.range(450).selectExpr("id", "id AS comp"), "labels")
    got = {r.id: r.comp for r in components.merge(labels, spark.createDataFrame(links, "a long, b long")).collect()}
    want = list(range(450))
    for a, b in links:
        lo, hi = sorted((want[a], want[b]))
        want = [lo if x == hi else x for x in want]
    assert got == dict(enumerate(want))
