"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vector of a trigram binds (multiplies) its
letters' vectors, each permuted (rotated) by its place; a text bundles (adds) the vectors of its
trigrams. A language's prototype is the sum of its training texts' unit vectors, rounded to integers so that
the sum does not depend on the order. A text gets the language of the greatest cosine.

Training reads about ``PER_LANGUAGE`` different texts of each language at most, and one at least, chosen by a hash.

The cosine to expect of a text grows with its size n, the number of trigrams that are not repeats: a language of spread k gives about
1 / sqrt(1 + k / n). Spreads are medians over the training texts. A text that is unlike its language falls
below half of that by more than chance, for which 2 / sqrt(n) is allowed.

Edge cases: null texts and texts without letters are ``und`` with score 0, as are all texts if
there is nothing to learn from; ties go to the language that sorts first; long texts are read in
slices; repeated rows come back as often as they went in; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.shared import freed, held, quoted, sampled, with_text

SYMBOLS, DIM, SEED = 64, 512, 20_240
#: Training texts of each language, about; characters of a slice; trigrams whose vectors are held at once; texts
#: whose counts are held at once.
PER_LANGUAGE, SLICE, ROWS, GROUP = 3_000, 200_000, 4_096, 64
#: Unit vectors are rounded to multiples of one in so many.
SCALE = 1 << 20


def symbol(cp: int) -> int:
    """0 for what is no letter; 1 to 26 for a to z; the other letters share the rest."""
    return 0 if not chr(cp).isalpha() else cp - 96 if 97 <= cp <= 122 else 27 + cp % 37


def size(slices: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The number of trigrams that are as good as different: the squared sum of counts over the sum of squares."""
    if not slices:
        return 0.0
    counts = slices[0][1]
    if len(slices) > 1:
        at = np.unique(np.concatenate([codes for codes, _ in slices]), return_inverse=True)[1]
        counts = np.bincount(at, np.concatenate([n for _, n in slices]))
    counts = counts.astype(np.float64)
    return counts.sum() ** 2 / (counts @ counts)


def least(sizes: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The least cosine of texts of these sizes in languages of these spreads."""
    n = np.maximum(sizes, 1e-9)
    return 0.5 / np.sqrt(1 + spread / n) - 2 / np.sqrt(n)


class Space:
    """The letter vectors and what is made of them."""

    def __init__(self):
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIM))
        self.places = [np.roll(letters, 2 - i, axis=1) for i in range(3)]
        self.pairs = (self.places[0][:, None] * self.places[1][None]).reshape(-1, DIM)
        self.table = np.array([0 if 0xD800 <= c < 0xE000 else symbol(c) for c in range(1 << 16)], np.int32)

    def symbols(self, text: str) -> np.ndarray:
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        out = self.table[np.minimum(cps, 65_535)]
        for at in np.flatnonzero(cps > 65_535):
            out[at] = symbol(int(cps[at]))
        return out

    def trigrams(self, text: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
        """Distinct trigram codes and counts of each slice, and whether the text has letters."""
        out, carry, seen = [], np.zeros(1, np.int32), False
        for start in range(0, len(text), SLICE):
            s = self.symbols(text[start : start + SLICE])
            seen = seen or bool(s.any())
            s = np.concatenate([carry, s, np.zeros(int(start + SLICE >= len(text)), np.int32)])
            s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
            carry = s[-2:]
            if len(s) > 2:
                out.append(np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True))
        return (out, True) if seen else ([], False)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigrams."""
        return self.pairs[codes // SYMBOLS] * self.places[2][codes % SYMBOLS]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' unit vectors (0 without letters), and whether they have letters."""
        return self.measured(texts)[:2]

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What bundle gives, and the texts' sizes."""
        found = [self.trigrams(t or "") for t in texts]
        total = np.zeros((len(texts), DIM), np.float64)
        if every := [codes for slices, _ in found for codes, _ in slices]:
            distinct = np.unique(np.concatenate(every))
            for k in range(0, len(distinct), ROWS):
                some = distinct[k : k + ROWS]
                counts = np.zeros((len(texts), len(some)), np.float32)
                for row, (slices, _) in zip(counts, found, strict=True):
                    for codes, n in slices:
                        a, b = np.searchsorted(codes, [some[0], some[-1] + 1])
                        row[np.searchsorted(some, codes[a:b])] += n[a:b]
                total += counts @ self.vectors(some)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return total / np.where(norm > 0, norm, 1), np.array([seen for _, seen in found], bool), np.array([size(slices) for slices, _ in found])


def groups(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in order, some at a time: up to GROUP, and fewer if they are long."""
    out, size = [], 0
    for t in texts:
        out.append(t.as_py())
        size += len(out[-1] or "")
        if len(out) == GROUP or size > SLICE:
            yield out
            out, size = [], 0
    if out:
        yield out


@held
@lru_cache(1)
def space() -> Space:
    return Space()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes of the languages in labelled rows."""
    rows = sampled(labelled, lang, text, per_language).select(text, lang)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = iter(batch.column(1).to_pylist())
            for texts in groups(batch.column(0)):
                for v in np.rint(space().bundle(texts)[0] * SCALE).astype(np.int64):
                    k = next(langs)
                    sums[k] = sums.get(k, 0) + v
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [k] * DIM, "dim": pa.array(range(DIM), pa.int32()), "v": v})

    found: dict[str, np.ndarray] = {}
    parts = rows.mapInArrow(freed(run), "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    for r in parts.collect():
        found.setdefault(r.lang, np.zeros(DIM))[r.dim] = r.v
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def spreads(labelled: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> dict[str, float]:
    """The spread of each language, from the rows that train reads."""
    rows = sampled(labelled, lang, text, per_language).select(text, lang)

    def run(batches):
        for batch in batches:
            langs, found = iter(batch.column(1).to_pylist()), {"lang": [], "k": []}
            for texts in groups(batch.column(0)):
                for v, ok, n in zip(*space().measured(texts), strict=True):
                    if (name := next(langs)) in prototypes and ok:
                        found["lang"].append(name)
                        found["k"].append(n * (1 / max(round(v @ prototypes[name], 9), 1e-3) ** 2 - 1))
            yield pa.RecordBatch.from_pydict(found, pa.schema({"lang": pa.string(), "k": pa.float64()}))

    return {r.lang: r.k for r in rows.mapInArrow(freed(run), "lang string, k double").groupBy("lang").agg(F.percentile("k", 0.5).alias("k")).collect()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", carry: tuple[str, ...] = ("doc_id",), spread: dict[str, float] | None = None) -> DataFrame:
    """The carried columns, with lang_pred and score, the cosine with its prototype; given spreads, also least, the least score."""
    names, matrix = list(prototypes), np.array(list(prototypes.values())).reshape(-1, DIM)
    by = np.array([np.inf if spread is None else spread.get(k, np.inf) for k in names])
    more = ["lang_pred", "score"] if spread is None else ["lang_pred", "score", "least"]
    (rows, at), n = with_text(docs, carry, text), len(carry)

    def run(batches):
        for batch in batches:
            langs, scores, leasts = [], [], []
            for texts in groups(batch.column(at)):
                if not names:
                    langs += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    leasts += [0.0] * len(texts)
                    continue
                v, seen, sizes = space().measured(texts)
                cos = np.round(v @ matrix.T, 9)
                best = cos.argmax(axis=1)
                langs += [names[b] if ok else "und" for b, ok in zip(best, seen, strict=True)]
                scores += np.where(seen, np.clip(cos.max(axis=1), 0, 1), 0.0).tolist()
                leasts += least(sizes, by[best]).tolist()
            columns = [*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(leasts, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns[: n + len(more)], names=[*carry, *more])

    fields = [f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in carry]
    return rows.mapInArrow(freed(run), ", ".join([*fields, "lang_pred string", *(f"{c} double" for c in more[1:])]))


def held_out(fold: int, of: int, key: str = "doc_id") -> Column:
    """Whether the key's fold is the one that training leaves out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == fold, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = train(docs.where(~held_out(2, 4)).select("text", "lang"))
    return identify(docs, prototypes).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
