"""Toxicity with a bidirectional gated recurrent network and attention pooling, in numpy.

A word's input is its hashed word vector beside the mean of its hashed character n-gram vectors. Both
directions of a gated recurrent network read every window of words, attention pools their states,
and a linear layer gives the window's logit. Windows overlap by half and cover the whole text.
A document's score is a calibrated logistic function of its greatest window logits.

Labels belong to documents, so training picks windows: of a toxic document those that score
highest so far, of others the highest and a random one, over several turns. The vectors start from
smoothed log odds of the training documents. Training reads at most about ``PER_CLASS`` documents of
each label, each of at most ``FIT_BYTES`` (bounds on the sample; what it reads it reads whole, and scoring reads every whole text), of
which a third only calibrate. Where labelled documents are repeated, the repeated rows are cut to twice that number.

Edge cases: null, empty and wordless texts have one window without words; contradicting labels count as toxic; with one
class or no labels every score is the smoothed share of toxic labels; repeated rows come back as often as they went in;
extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.hashing import MIX_A, MIX_B, mix
from lumenframe.llm.langid import held_out
from lumenframe.llm.shared import only

#: Buckets and sizes of word and character vectors, states of each direction.
WORD_BUCKETS, WORD_DIM, CHAR_BUCKETS, CHAR_DIM, STATES = 1 << 14, 6, 1 << 15, 10, 8
#: N-grams of the bytes of a word with its borders.
GRAMS = (4, 5)
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 16, 8
#: Training documents of each label, about; turns of picking windows, passes over them, windows of a step.
PER_CLASS, TURNS, EPOCHS, STEP, RATE = 2_000, 4, 5, 128, 0.01
#: Bytes of a training document at most.
FIT_BYTES = 200_000
#: Greatest logits that the calibration sees, and the score from which a document counts as toxic.
TOP, THRESHOLD = 3, 0.7
#: Words whose inputs are remembered, and windows that are scored at once.
CACHE_WORDS, BATCH = 250_000, 8_192

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def buckets(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Buckets of words, and owners and buckets of their byte n-grams, owners in order within each n.

    Words are letters and digits only, so ^ and $ mark their borders. A word that is shorter than all
    n-grams is one itself.
    """
    data = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-8", "surrogatepass"), np.uint8)
    start = np.flatnonzero(data == ord("^"))
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(start, len(data))))
    size = np.diff(np.append(start, len(data)))
    value = data.astype(np.uint64) + np.uint64(1)
    place = np.arange(len(data)) - start[owner]
    whole = np.add.reduceat(value * powers(int(size.max()))[place], start)
    owners, grams = [], []
    for n in GRAMS:
        h = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for k in range(n):
            h = h * MIX_A + value[k : k + len(h)]
        inside = owner[: len(h)] == owner[n - 1 :]
        owners.append(owner[: len(h)][inside])
        grams.append(mix(h[inside] + np.uint64(n)))
    short = np.flatnonzero(size < min(GRAMS))
    owners.append(short)
    grams.append(mix(whole[short]))
    spread = lambda h, m: (h >> np.uint64(20)).astype(np.int64) % m
    return spread(mix(whole), WORD_BUCKETS), owners, [spread(g, CHAR_BUCKETS) for g in grams]


@lru_cache(64)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, MIX_B, np.uint64))


def powers(n: int) -> np.ndarray:
    """Powers of a fixed odd number, at least n of them."""
    return _powers(1 << max(6, (n - 1).bit_length()))


def means(table: np.ndarray, owners: list[np.ndarray], grams: list[np.ndarray], n: int) -> np.ndarray:
    """The mean row of each owner's grams."""
    total, count = np.zeros((n, table.shape[1]), np.float32), np.zeros(n, np.float32)
    for o, g in zip(owners, grams, strict=True):
        if len(o):
            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            total[o[first]] += np.add.reduceat(table[g], first, axis=0)
            count[o[first]] += np.diff(np.append(first, len(o)))
    return total / count[:, None]


def windows_of(n: int) -> np.ndarray:
    """Where the windows of n words start; one empty window without words."""
    return np.array([*range(0, max(1, n - WINDOW + STRIDE), STRIDE)], np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The parameters, what they make of windows, and how they learn."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        x, h = WORD_DIM + CHAR_DIM, STATES
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.p = {"word": draw(WORD_BUCKETS, WORD_DIM) * np.float32(0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM) * np.float32(0.1)}
        for d in "fb":
            self.p |= {f"x{d}": draw(x, 3 * h), f"h{d}": draw(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"look": draw(2 * h), "out": draw(2 * h), "bias": np.full(1, -1, np.float32)}
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.t = 0

    def read(self, gx: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each word: gx has words' projected inputs, (windows, words, gates)."""
        n, steps, _ = gx.shape
        u, h, s = self.p[f"h{d}"], np.zeros((n, STATES), np.float32), STATES
        out = np.empty((n, steps, STATES), np.float32)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            g, a = gx[:, t], h @ u
            zr = 1 / (1 + np.exp(-(g[:, : 2 * s] + a[:, : 2 * s])))
            z, r = zr[:, :s], zr[:, s:]
            new = np.tanh(g[:, 2 * s :] + r * a[:, 2 * s :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, new, a[:, 2 * s :], m))
            h = h + m * (1 - z) * (new - h)
            out[:, t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention and pooled states; pads get no attention."""
        e = np.where(mask > 0, states @ self.p["look"], np.float32(-30))
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        c = np.einsum("nt,nth->nh", a, states)
        return c @ self.p["out"] + self.p["bias"][0], a, c

    def learn(self, inputs: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean logistic loss, and of the inputs (windows, words, features)."""
        p, kept = self.p, {"f": [], "b": []}
        states = np.concatenate([self.read(inputs @ p[f"x{d}"] + p[f"c{d}"], mask, d, kept[d]) for d in "fb"], axis=2)
        logits, a, c = self.pool(states, mask)
        dl = ((sigmoid(logits) - y) / len(y)).astype(np.float32)
        g = {"out": c.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dc = dl[:, None] * p["out"]
        da = np.einsum("nh,nth->nt", dc, states)
        de = a * (da - (a * da).sum(axis=1, keepdims=True)) * (mask > 0)
        g["look"] = np.einsum("nt,nth->h", de, states)
        ds = a[:, :, None] * dc[:, None] + de[:, :, None] * p["look"]
        dx, s = np.zeros_like(inputs), STATES
        for i, d in enumerate("fb"):
            g |= {f"{k}{d}": np.zeros_like(p[f"{k}{d}"]) for k in "xhc"}
            back = np.zeros((len(y), s), np.float32)
            for t, h, z, r, new, an, m in reversed(kept[d]):
                dh = back + ds[:, t, i * s : (i + 1) * s]
                dn = dh * m * (1 - z) * (1 - new * new)
                dz = dh * m * (h - new) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                gates = np.concatenate([dz, dr, dn], axis=1)
                dah = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"h{d}"] += h.T @ dah
                g[f"x{d}"] += inputs[:, t].T @ gates
                g[f"c{d}"] += gates.sum(axis=0)
                dx[:, t] += gates @ p[f"x{d}"].T
                back = dh * (1 - m * (1 - z)) + dah @ p[f"h{d}"].T
        return g, dx

    def update(self, k: str, g: np.ndarray, rows=slice(None)) -> None:
        """One step of Adam on some rows of a parameter."""
        m, v = self.m[k]
        m[rows] = 0.9 * m[rows] + 0.1 * g
        v[rows] = 0.99 * v[rows] + 0.01 * g * g
        scale = RATE * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        self.p[k][rows] -= (scale * m[rows] / (np.sqrt(v[rows]) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores windows of texts with a network whose input layer is folded into tables."""

    def __init__(self, net: Network, calibration: np.ndarray):
        self.net, self.calibration = net, calibration
        p = net.p
        gates = np.concatenate([p["xf"], p["xb"]], axis=1)
        self.word, self.char = p["word"] @ gates[:WORD_DIM], p["char"] @ gates[WORD_DIM:]
        self.bias = np.concatenate([p["cf"], p["cb"]])
        self.reset()

    def reset(self, size: int = CACHE_WORDS):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((max(size, CACHE_WORDS) + 1, 6 * STATES), np.float32)  # the last row pads

    def indices(self, words: list[str]) -> np.ndarray:
        """Rows of words; what is remembered goes if the new ones don't fit."""
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if len(self.at) + len(new) >= len(self.rows):
            new = list(dict.fromkeys(words))
            self.reset(len(new))
        if new:
            start = len(self.at)
            word, owners, grams = buckets(new)
            self.rows[start : start + len(new)] = self.word[word] + means(self.char, owners, grams, len(new)) + self.bias
            self.at.update(zip(new, range(start, start + len(new)), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def window_logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """The logits of all windows of each text."""
        lists = [words_of(t) for t in texts]
        index = self.indices([w for words in lists for w in words])
        pad = np.full(WINDOW, len(self.rows) - 1, np.int64)
        done, pieces, owners, size, at = [[] for _ in texts], [], [], 0, 0
        for i, words in enumerate(lists):
            padded = np.concatenate([index[at : at + len(words)], pad])
            at += len(words)
            starts = windows_of(len(words))
            for k in range(0, len(starts), BATCH):
                pieces.append(padded[starts[k : k + BATCH, None] + np.arange(WINDOW)])
                owners.append(i)
                size += len(pieces[-1])
                if size >= BATCH:
                    self.score(pieces, owners, done)
                    pieces, owners, size = [], [], 0
        self.score(pieces, owners, done)
        return [np.concatenate(d) for d in done]

    def score(self, pieces, owners, done) -> None:
        if not pieces:
            return
        index = np.concatenate(pieces)
        mask = (index < len(self.rows) - 1).astype(np.float32)
        gx = self.rows[index]
        states = np.concatenate([self.net.read(gx[:, :, i * 3 * STATES : (i + 1) * 3 * STATES], mask, d) for i, d in enumerate("fb")], axis=2)
        logits = self.net.pool(states, mask)[0]
        at = 0
        for piece, owner in zip(pieces, owners, strict=True):
            done[owner].append(logits[at : at + len(piece)])
            at += len(piece)

    def __call__(self, texts: list[str | None]) -> list[float]:
        return [float(sigmoid(summary(x) @ self.calibration)) for x in self.window_logits(texts)]


def summary(logits: np.ndarray) -> np.ndarray:
    """The greatest logit, the mean of the TOP greatest, the windows on a log scale, and 1."""
    top = np.sort(logits)[::-1][:TOP]
    return np.array([top[0], top.mean(), np.log(len(logits)), 1.0])


def fit(texts: list[str], y: list[int]) -> Scorer:
    """A scorer from labelled texts."""
    net, y = Network(), np.array(y, np.float64)
    flat = np.zeros(4)
    flat[3] = np.log((y.sum() + 1) / (len(y) - y.sum() + 8))
    if len(set(y.tolist())) < 2:
        return Scorer(net, flat)
    lists = [words_of(t) for t in texts]
    for_fit = np.array([i % 3 != 2 for i in range(len(texts))])
    rng = np.random.default_rng(6)
    known = all_marks(lists)
    start_from_odds(net, [w for w, ok in zip(lists, for_fit, strict=True) if ok], y[for_fit], known)
    for turn in range(TURNS):
        chosen, marks = [], []
        fitted = np.flatnonzero(for_fit)
        every = logits_of(net, [texts[i] for i in fitted]) if turn else [odds_by_window(net, lists[i], known) for i in fitted]
        for i, logits in zip(fitted, every, strict=True):
            order, starts = np.argsort(-logits, kind="stable"), windows_of(len(lists[i]))
            picks = order[: 1 if turn < 2 else 2] if y[i] else [order[0], rng.integers(len(order))]
            for k in picks:
                chosen.append(lists[i][starts[k] : starts[k] + WINDOW])
                marks.append(y[i])
        marks = np.array(marks, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), STEP):
                some = order[k : k + STEP]
                step(net, [chosen[i] for i in some], marks[some], known)
    features = np.array([summary(x) for x in logits_of(net, [t for t, ok in zip(texts, for_fit, strict=True) if not ok])])
    scorer = Scorer(net, flat)
    scorer.calibration = logistic(features, y[~for_fit]) if 0 < y[~for_fit].sum() < (~for_fit).sum() else flat
    return scorer


def logits_of(net: Network, texts: list[str]) -> list[np.ndarray]:
    """The window logits of each text under the network as it is."""
    scorer = Scorer(net, np.zeros(4))
    return [x for k in range(0, len(texts), 64) for x in scorer.window_logits(texts[k : k + 64])]


def all_marks(lists: list[list[str]]) -> dict[str, tuple[int, np.ndarray]]:
    """The buckets of every word of the sample and of its n-grams."""
    words = list(dict.fromkeys(w for words in lists for w in words))
    out: dict[str, tuple[int, np.ndarray]] = {}
    for k in range(0, len(words), 50_000):
        some = words[k : k + 50_000]
        word, owners, grams = buckets(some)
        order = np.argsort(np.concatenate(owners), kind="stable")
        owner, gram = np.concatenate(owners)[order], np.concatenate(grams)[order]
        parts = np.split(gram, np.searchsorted(owner, np.arange(1, len(some))))
        out.update(zip(some, zip(word.tolist(), parts, strict=True), strict=True))
    return out


def start_from_odds(net: Network, lists: list[list[str]], y: np.ndarray, known: dict) -> None:
    """The first place of each vector: smoothed log odds of the documents that hold its bucket."""
    for k, size in (("word", WORD_BUCKETS), ("char", CHAR_BUCKETS)):
        counts = np.zeros((2, size))
        for words, label in zip(lists, y, strict=True):
            marks = [known[w] for w in set(words)]
            held = np.unique([m[0] for m in marks] if k == "word" else np.concatenate([m[1] for m in marks])) if marks else []
            counts[int(label), held] += 1
        n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
        odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
        sure = counts.sum(axis=0) / (counts.sum(axis=0) + 4)
        net.p[k][:, 0] = np.clip(odds * sure, -3, 3)


def odds_by_window(net: Network, words: list[str], known: dict) -> np.ndarray:
    """What the starting vectors alone say of each window: its greatest word."""
    values = np.array([net.p["word"][w, 0] + net.p["char"][g, 0].mean() for w, g in (known[x] for x in words)] or [0.0])
    return np.array([values[s : s + WINDOW].max() for s in windows_of(len(words))])


def step(net: Network, windows: list[list[str]], y: np.ndarray, known: dict) -> None:
    """One step of learning on a few windows."""
    distinct = list(dict.fromkeys(w for win in windows for w in win))
    at = {w: i for i, w in enumerate(distinct)}
    if not distinct:
        return
    marks = [known[w] for w in distinct]
    word = np.array([w for w, _ in marks], np.int64)
    sizes = np.array([len(g) for _, g in marks], np.int64)
    flat = np.concatenate([g for _, g in marks])
    owner = np.repeat(np.arange(len(distinct)), sizes)
    chars = np.add.reduceat(net.p["char"][flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
    inputs = np.concatenate([net.p["word"][word], chars / sizes[:, None]], axis=1).astype(np.float32)
    inputs = np.concatenate([inputs, np.zeros((1, inputs.shape[1]), np.float32)])
    index = np.full((len(windows), WINDOW), len(distinct), np.int64)
    for row, win in zip(index, windows, strict=True):
        row[: len(win)] = [at[w] for w in win]
    mask = (index < len(distinct)).astype(np.float32)
    g, dx = net.learn(inputs[index], mask, y)
    net.t += 1
    for k, v in g.items():
        net.update(k, v)
    total = np.zeros_like(inputs)
    np.add.at(total, index, dx)
    rows, where = np.unique(word, return_inverse=True)
    of_words = np.zeros((len(rows), WORD_DIM), np.float32)
    np.add.at(of_words, where, total[:-1, :WORD_DIM])
    net.update("word", of_words, rows)
    rows, where = np.unique(flat, return_inverse=True)
    of_chars = np.zeros((len(rows), CHAR_DIM), np.float32)
    np.add.at(of_chars, where, (total[:-1, WORD_DIM:] / sizes[:, None])[owner])
    net.update("char", of_chars, rows)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Scorer:
    """Fit on a bounded sample of the labelled documents in docs."""
    judged = labels.select(F.col(key).alias("t_key"), label).where(F.col(label).isNotNull()).groupBy("t_key").agg(F.max(label).alias("y"))
    counts = {r.y: r.n for r in judged.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, per_class / n).otherwise(share)
    judged = judged.where(F.pmod(F.xxhash64("t_key"), F.lit(1_000_000)) / 1e6 < share)
    rows = docs.select(F.col(key).alias("t_key"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= FIT_BYTES).join(F.broadcast(judged), "t_key")
    met = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    for y, n in met.items():  # an id may have any number of rows
        if n > 2 * per_class:
            rows = rows.where((F.col("y") != y) | (F.pmod(F.xxhash64("t_key", "t"), F.lit(1_000_000)) / 1e6 < 2 * per_class / n))
    rows = rows.select("t", "y").dropDuplicates(["t", "y"]) if any(n > 2 * per_class for n in met.values()) else rows.select("t", "y")
    found = sorted((crc32(r.t.encode("utf-8", "surrogatepass")), r.t, int(r.y > 0)) for r in rows.collect())
    return fit([t for _, t, _ in found], [y for *_, y in found])


def score_documents(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): how likely each whole text is toxic."""
    rows = only(docs, key, text)
    net, calibration = scorer.net.p, scorer.calibration
    shared = docs.sparkSession.sparkContext.broadcast((net, calibration))

    def run(batches):
        own = Network()
        own.p, calibration = shared.value
        scorer = Scorer(own, calibration)
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, 64):
                out += scorer(batch.column(1).slice(start, 64).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[key, "score"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = train(docs.where(~held_out(1, 3)), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(1, 3)))
    scored = score_documents(docs, scorer)
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
