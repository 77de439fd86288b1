"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of the embeddings of its hash and of the hashes of its first 3, 4 and 5 letters. Filters of widths 1,
2 and 3 run over the words, each filter's maximum over the whole text goes through a rectifier, and a linear layer
gives the score. It learns from a bounded sample of labelled rows (`SAMPLE_PER_CLASS` of each class).

For scoring, a filter's share in each embedding is multiplied out once, so that a text's filters are sums of table rows.
Texts of any length go in overlapping chunks, which leaves maxima as they are.

`score` never sees lang, source or ids. The thresholds by language, which decide `flagged`, are set on a part of the
sample that training leaves out.

Defined results: a null or empty text has no word and gets the score of a text without any filter's response; without
labels of both classes every score is 0; repeated rows score alike, and of an id with several texts the smallest one is
learnt from; a score at a threshold exactly counts as toxic; an empty table gives no rows; other columns are ignored, or
carried along by `drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .learning import HELD_OUT, SAMPLE_PER_CLASS, WordTable, crc, fold, platt, sigmoid, training_sample

BUCKETS = 1 << 15
DIM = 16
FILTERS = {1: 12, 2: 8, 3: 8}
PREFIXES = (3, 4, 5)
EPOCHS = 5
THRESHOLD = 0.7
CHUNK = 20_000
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_ids(word: str) -> list[int]:
    """Embedding rows of a word: 0 stands for none."""
    bare = word.strip(_EDGES) or word
    n = len(bare)
    return [1 + crc(bare) % (BUCKETS - 1)] + [_prefixes[bare[:k]] if n >= k else 0 for k in PREFIXES]


class _Prefixes(dict):
    """Embedding row of each prefix met; far fewer than words."""

    def __missing__(self, prefix: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[prefix] = 1 + crc(f"{len(prefix)}{prefix}") % (BUCKETS - 1)
        return found


_prefixes = _Prefixes()


class ConvNet:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.e[0] = 0
        self.w = {k: (rng.standard_normal((k, DIM, n)) * 0.3).astype(np.float32) for k, n in FILTERS.items()}
        self.b = {k: np.zeros(n, np.float32) for k, n in FILTERS.items()}
        self.v = (rng.standard_normal(sum(FILTERS.values())) * 0.3).astype(np.float32)
        self.c, self.scale, self.shift = np.float32(0), 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.trained = False

    def _forward(self, ids: np.ndarray):
        x = self.e[ids].sum(axis=1)
        if len(x) < max(FILTERS):
            x = np.concatenate((x, np.zeros((max(FILTERS) - len(x), DIM), np.float32)))
        best, at = [], []
        for k, w in self.w.items():
            z = sum(x[j : len(x) - k + 1 + j] @ w[j] for j in range(k))
            p = z.argmax(axis=0)
            best.append(z[p, np.arange(z.shape[1])] + self.b[k])
            at.append(p)
        return x, np.concatenate(best), at

    def logit(self, ids: np.ndarray) -> float:
        return float(np.maximum(self._forward(ids)[1], 0) @ self.v + self.c)

    def train(self, rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.1) -> None:
        """Adagrad, one text at a time; gradients reach the words at the filters' maxima alone."""
        n1 = max(1, sum(y for _, y in rows))
        weight = {1: len(rows) / (2 * n1), 0: len(rows) / (2 * max(1, len(rows) - n1))}
        seen_e, seen_v, seen_c = np.full(BUCKETS, 1e-2, np.float32), np.full_like(self.v, 1e-2), 1e-2
        seen_w, seen_b = {k: np.full_like(w, 1e-2) for k, w in self.w.items()}, {k: np.full_like(b, 1e-2) for k, b in self.b.items()}
        order = np.random.default_rng(6)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                ids, y = rows[i]
                x, pre, at = self._forward(ids)
                h = np.maximum(pre, 0)
                g = np.float32((sigmoid(float(h @ self.v + self.c)) - y) * weight[y])
                if abs(g) < 1e-3:
                    continue
                gh = g * self.v * (pre > 0)
                seen_v += (g * h) ** 2
                self.v -= rate * g * h / np.sqrt(seen_v)
                seen_c += g * g
                self.c -= rate * g / np.sqrt(seen_c)
                first = 0
                for (k, w), p in zip(self.w.items(), at):
                    gk = gh[first : first + w.shape[2]]
                    first += w.shape[2]
                    seen_b[k] += gk * gk
                    self.b[k] -= rate * gk / np.sqrt(seen_b[k])
                    for j in range(k):
                        rows_e = [(int(q), f) for f, q in enumerate(p + j) if gk[f] and q < len(ids)]
                        gw = x[p + j].T * gk
                        back = {}
                        for q, f in rows_e:
                            back[q] = back.get(q, 0) + gk[f] * w[j][:, f]
                        seen_w[k][j] += gw * gw
                        w[j] -= rate * gw / np.sqrt(seen_w[k][j])
                        for q, ge in back.items():
                            for r in ids[q]:
                                if r:
                                    seen_e[r] += float(ge @ ge) / DIM
                                    self.e[r] -= rate * ge / np.sqrt(seen_e[r])
        self.trained = True

    def tables(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(embedding rows, taps): each filter's share in each embedding, and (width, first column, filters) of each width."""
        columns = [self.w[k][j] for k in self.w for j in range(k)]
        where, at = [], 0
        for k, n in FILTERS.items():
            where.append((k, at, n))
            at += k * n
        return self.e @ np.concatenate(columns, axis=1), where


class Scorer:
    def __init__(self, net: ConvNet):
        self.net, (self.table, self.where) = net, net.tables()
        self.words = WordTable(lambda ws: self.table[np.array([word_ids(w) for w in ws])].sum(axis=1))

    def score(self, text: str | None) -> float:
        net, words = self.net, words_of(text)
        if not net.trained:
            return 0.0
        most = None
        for at in range(0, max(1, len(words)), CHUNK):
            ids = self.words.rows(words[at : at + CHUNK + max(FILTERS) - 1])
            r = self.words.matrix[ids] if len(ids) else np.zeros((0, self.table.shape[1]), np.float32)
            if len(r) < max(FILTERS):
                r = np.concatenate((r, np.zeros((max(FILTERS) - len(r), r.shape[1]), np.float32)))
            found = np.concatenate([sum(r[j : len(r) - k + 1 + j, c + j * n : c + (j + 1) * n] for j in range(k)).max(axis=0) + net.b[k] for k, c, n in self.where])
            most = found if most is None else np.maximum(most, found)
        return float(sigmoid(net.scale * float(np.maximum(most, 0) @ net.v + net.c) + net.shift))


def fit(sample: list[tuple[str, str, int]], epochs: int = EPOCHS) -> ConvNet:
    """Four fifths of the sample train the net; the rest, which they leave out, set scale and thresholds."""
    net = ConvNet()
    if len({y for _, _, y in sample}) < 2:
        return net
    rows = [(np.array([word_ids(w) for w in words_of(t)] or [[0] * (1 + len(PREFIXES))]), lang, y) for t, lang, y in sample]
    rest, train = [r for i, r in enumerate(rows) if i % 5 == 4], [r for i, r in enumerate(rows) if i % 5 != 4]
    net.train([(ids, y) for ids, _, y in train], epochs)
    rest = rest if len({y for *_, y in rest}) == 2 else rows
    logits, y = np.array([net.logit(ids) for ids, *_ in rest]), np.array([y for *_, y in rest])
    net.scale, net.shift = platt(logits, y)
    scores = sigmoid(net.scale * logits + net.shift)
    for lang in sorted({lang for _, lang, _ in rest if lang}):
        own = np.array([lang == x for _, x, _ in rest])
        net.thresholds[lang] = best_threshold(scores[own], y[own])
    return net


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold of highest F1 on a grid, the one nearest to THRESHOLD among equals."""
    def f1(t: float) -> float:
        hit = scores >= t
        return 2 * float((hit & (y == 1)).sum()) / max(1.0, float(hit.sum() + y.sum()))

    return min(np.arange(0.3, 0.96, 0.05).round(2).tolist(), key=lambda t: (-round(f1(t), 6), abs(t - THRESHOLD)))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= THRESHOLD), flagged (score >= its language's threshold)."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select("doc_id", F.col("text"), lang.alias("lang"))
    flags = _scored(own, fit(training_sample(docs, labels, "toxic", per_class)))
    return flags.withColumn("held_out", fold() == HELD_OUT).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "flagged")


def _scored(docs: DataFrame, net: ConvNet) -> DataFrame:
    """`docs` with score and flagged; its first columns are passed through."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")
    rest = [i for i in range(len(names)) if i != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in batches:
            scores = [scorer.score(t.as_py()) for t in b.column(text)]
            flagged = [s >= model.value.thresholds.get(x, THRESHOLD) for s, x in zip(scores, b.column(lang).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(scores, pa.float64()), pa.array(flagged, pa.bool_())], names=[*(names[i] for i in rest), "score", "flagged"])

    fields = ", ".join(f"`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}" for i in rest)
    return docs.mapInArrow(run, f"{fields}, score double, flagged boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The documents, all columns, that score below their language's threshold, THRESHOLD where none was fitted or no `lang`
    is given; no shuffle."""
    net = fit(training_sample(docs, labels, "toxic", per_class))
    model = docs.sparkSession.sparkContext.broadcast(net)
    text, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in batches:
            langs = [None] * b.num_rows if lang is None else b.column(lang).to_pylist()
            keep = [scorer.score(t.as_py()) < scorer.net.thresholds.get(x, THRESHOLD) for t, x in zip(b.column(text), langs)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
