"""Quality classifier: attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of PASSAGE words. A passage is described by shares of symbols, digits, capitals,
repeated and distinct words, word lengths, and a hashed histogram of word shapes; an encoder layer turns that into H
numbers. Gated attention, softmax(w . (tanh(V h) * sigmoid(U h))), learned from document labels alone, weighs the passages,
and the document's score is read off the weighted sum of their encodings.

It learns from a bounded sample of labelled rows (`SAMPLE_PER_CLASS` of each class); scale and shift are set on a part of
it that training leaves out. Neither labels, lang, source nor ids are inputs.

Defined results: a null or empty text is a bag of one empty passage; without labels of both classes every score is 1, so
nothing is rejected; texts of any length are described in chunks of passages; repeated rows score alike, and of an id with
several texts the smallest one is learnt from; a score of 0.5 exactly counts as good; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .learning import HELD_OUT, SAMPLE_PER_CLASS, WordTable, crc, fold, platt, sigmoid, training_sample

PASSAGE = 64
SHAPES = 48
H, A = 24, 16
EPOCHS = 12
THRESHOLD = 0.5
#: Passages that are described at once, which bounds memory on long texts.
CHUNK = 512

_WORD_FEATURES = 10


def word_features(w: str) -> np.ndarray:
    """Of a word: length, symbols, digits, capitals, punctuation at the end, ... and a one-hot hashed shape."""
    out = np.zeros(_WORD_FEATURES + SHAPES, np.float32)
    n, alpha, digits, first, last = len(w), sum(map(str.isalpha, w)), sum(map(str.isdigit, w)), w[0], w[-1]
    out[:_WORD_FEATURES] = (min(n, 40) / 10, n > 15, (n - alpha - digits) / n, digits / n, first.isupper(), last in ".!?", last in ",;:", alpha == 0, w.isupper(), last in ".,;:!?")
    shape = ("A" if first.isupper() else "a" if first.isalpha() else "0" if first.isdigit() else first) + ("a" if alpha == n else "x") + ("a" if last.isalpha() else "0" if last.isdigit() else last) + str(min(n // 3, 4))
    out[_WORD_FEATURES + crc(shape) % SHAPES] = 1
    return out


class Kinds:
    """Words of one kind (length, capitals, last sign) have the same features; kinds are few and described once."""

    def __init__(self):
        self.kinds: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []

    def __call__(self, words: list[str]) -> np.ndarray:
        out = []
        for w in words:
            n, last = len(w), w[-1]
            head = w if last.isalpha() else w[:-1]
            kind = (n, last.isalpha() or last, w[0].isupper(), w.isupper()) if head.isalpha() else w
            if (k := self.kinds.get(kind)) is None:
                k = self.kinds[kind] = len(self.rows)
                self.rows.append(word_features(w))
            out.append(k)
        return np.array(out, np.int32)[:, None]


class Describer:
    """Passages of a text as rows of numbers."""

    width = _WORD_FEATURES + SHAPES + 5

    def __init__(self):
        self.kinds = Kinds()
        self.table = WordTable(self.kinds, np.int32, 300_000)
        self.matrix = np.zeros((0, _WORD_FEATURES + SHAPES), np.float32)

    def passages(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros((1, self.width), np.float32)
        return np.concatenate([self._some(words[at : at + PASSAGE * CHUNK]) for at in range(0, len(words), PASSAGE * CHUNK)])

    def _some(self, words: list[str]) -> np.ndarray:
        if len(self.kinds.rows) > 100_000:  # odd words, each a kind of its own
            self.__init__()
        ids = self.table.rows(words)
        starts = np.arange(0, len(ids), PASSAGE)
        sizes = np.diff(np.append(starts, len(ids))).astype(np.float32)[:, None]
        if len(self.kinds.rows) > len(self.matrix):
            self.matrix = np.concatenate((self.matrix, np.array(self.kinds.rows[len(self.matrix) :])))
        means = np.add.reduceat(self.matrix[self.table.matrix[ids, 0]], starts, axis=0) / sizes
        bag = np.full(len(starts) * PASSAGE, -1, np.int32)
        bag[: len(ids)] = ids
        bag = bag.reshape(-1, PASSAGE)
        real = bag >= 0
        same = ((bag[:, 1:] == bag[:, :-1]) & real[:, 1:]).sum(axis=1)[:, None] / sizes
        ordered = np.sort(bag, axis=1)
        distinct = (((ordered[:, 1:] != ordered[:, :-1]) & (ordered[:, 1:] >= 0)).sum(axis=1) + (ordered[:, 0] >= 0))[:, None] / sizes
        skip = ((bag[:, 2:] == bag[:, :-2]) & real[:, 2:]).sum(axis=1)[:, None] / sizes
        return np.concatenate((means, same, distinct, skip, np.minimum(sizes, PASSAGE) / PASSAGE, np.log1p(sizes) / 5), axis=1).astype(np.float32)


class GatedAttention:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d = Describer.width
        self.p = {"W": draw(d, H), "b": np.zeros(H, np.float32), "V": draw(H, A), "U": draw(H, A), "w": draw(A), "c": draw(H), "k": np.zeros(1, np.float32)}
        self.mean, self.std = np.zeros(d, np.float32), np.ones(d, np.float32)
        self.scale, self.shift, self.trained = 1.0, 0.0, False

    def _forward(self, bag: np.ndarray):
        p, x = self.p, np.clip((bag - self.mean) / self.std, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        a = np.exp(e - e.max())
        a /= a.sum()
        return x, h, t, s, a, a @ h

    def logit(self, bag: np.ndarray) -> float:
        return float(self._forward(bag)[-1] @ self.p["c"] + self.p["k"][0])

    def attention(self, bag: np.ndarray) -> np.ndarray:
        return self._forward(bag)[4]

    def train(self, rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.01) -> None:
        """Adam, eight bags a step."""
        p, m = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        v2, step, order = {k: np.zeros_like(v) for k, v in self.p.items()}, 0, np.random.default_rng(4)
        every = np.concatenate([b for b, _ in rows])
        self.mean, self.std = every.mean(axis=0), every.std(axis=0) + 1e-3
        n1 = max(1, sum(y for _, y in rows))
        weight = {1: len(rows) / (2 * n1), 0: len(rows) / (2 * max(1, len(rows) - n1))}
        for _ in range(epochs):
            turn = order.permutation(len(rows))
            for at in range(0, len(rows), 8):
                g = {k: np.zeros_like(v) for k, v in p.items()}
                for i in turn[at : at + 8]:
                    bag, y = rows[i]
                    x, h, t, s, a, z = self._forward(bag)
                    d = np.float32((sigmoid(float(z @ p["c"] + p["k"][0])) - y) * weight[y])
                    g["c"] += d * z
                    g["k"] += d
                    dz = d * p["c"]
                    da = h @ dz
                    de = a * (da - a @ da)
                    g["w"] += (t * s).T @ de
                    gate = de[:, None] * p["w"]
                    dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
                    g["V"] += h.T @ dt
                    g["U"] += h.T @ ds
                    dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
                    g["W"] += x.T @ dh
                    g["b"] += dh.sum(axis=0)
                step += 1
                for k in p:
                    gk = g[k] / 8 + 1e-4 * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v2[k] = 0.999 * v2[k] + 0.001 * gk * gk
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        self.trained = True

    def score(self, bag: np.ndarray) -> float:
        return float(sigmoid(self.scale * self.logit(bag) + self.shift)) if self.trained else 1.0


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS) -> GatedAttention:
    net, describer = GatedAttention(), Describer()
    if len({y for _, y in sample}) < 2:
        return net
    rows = [(describer.passages(t), y) for t, y in sample]
    rest, train = rows[4::5], [r for i, r in enumerate(rows) if i % 5 != 4]
    net.train(train, epochs)
    rest = rest if len({y for _, y in rest}) == 2 else rows
    net.scale, net.shift = platt(np.array([net.logit(b) for b, _ in rest]), np.array([y for _, y in rest]))
    return net


def quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; one pass, no shuffle."""
    net = fit([(t, y) for t, _, y in training_sample(docs, labels, "quality", per_class)])
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer()
        for b in batches:
            scores = [model.value.score(describer.passages(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
