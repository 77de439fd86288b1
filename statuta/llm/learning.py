"""What the two text classifiers share: their training sample, word features kept by worker, calibration."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Labelled rows of each class that a classifier learns from, at most.
SAMPLE_PER_CLASS = 1500
FOLDS, HELD_OUT = 3, 1


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[str, str, int]]:
    """(text, lang, label) of `per_class` rows of each class at most, the same ones each time; never of the held-out fold.

    Only ids are ranked, and the chosen ones, 2 * per_class at most, are then looked up in the documents."""
    own = labels.select(F.col("doc_id").alias("d"), F.col(label).alias("y")).filter(F.col("d").isNotNull() & F.col("y").isin(0, 1)).filter(fold("d") != HELD_OUT)
    own = own.groupBy("d").agg(F.max("y").alias("y"))
    chosen = [own.filter(F.col("y") == y).orderBy(F.xxhash64("d"), "d").limit(per_class) for y in (0, 1)]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("d"))
    # of an id that occurs twice, the smallest text
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "y", "t.text", "t.lang")
    return [(r.text, r.lang, r.y) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]


class WordTable(dict):
    """Word -> row of a feature matrix. New words get their features together; a full table starts anew."""

    def __init__(self, features: Callable[[list[str]], np.ndarray], dtype=np.float32, limit: int = 250_000):
        self.features, self.dtype, self.limit, self.pending = features, dtype, limit, []
        self.matrix: np.ndarray | None = None

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.pending.append(word)
        return n

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of the words in `matrix`, which holds until the next call."""
        if len(self) > self.limit:
            self.clear()
            self.pending, self.matrix = [], None
        at = len(self)
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.pending:
            new = self.features(self.pending)
            if self.matrix is None or len(self) > len(self.matrix):
                grown = np.zeros((max(1024, len(self) * 3 // 2), new.shape[1]), self.dtype)
                if self.matrix is not None:
                    grown[:at] = self.matrix[:at]
                self.matrix = grown
            self.matrix[at : len(self)] = new
            self.pending = []
        return ids


def crc(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def platt(logits: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Scale and shift that fit the labels best, with each class weighing the same."""
    a, b = 1.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(rounds):
        g = (sigmoid(a * logits + b) - y) * weight
        a, b = max(0.05, a - 0.5 * float(g @ logits) - 0.001 * a), b - 0.5 * float(g.sum())
    return a, b
