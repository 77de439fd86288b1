"""Language identification: one bit-sliced Bloom filter whose rows are bitmasks of languages.

The filter has ROWS rows of one bit for each language (64 to a word). An n-gram of 1 to 4 characters belongs to a language
if it is among that language's PROFILE most frequent ones; it sets the language's bit in HASHES rows. The conjunction of an n-gram's
rows is the mask of all languages that contain it. Over a text, a popcount for each language says how many of its n-grams
the language contains; some of them are false: a language whose bits fill a share f of the rows answers yes to a foreign
n-gram with probability f^HASHES, so from `hits` of `n` the true number is (hits - p n) / (1 - p). The language of the most
true n-grams is taken, and of equal ones the one with the smaller name.

N-grams are read from lower-cased letters; everything else is one space. A letter is what Unicode calls one.

It learns from a bounded sample: SAMPLE_PER_LANGUAGE rows of each language at most, whole texts, never of the held-out fold.
Neither lang, source nor ids are inputs of a prediction. `score` compares the shares of true n-grams with one another
(exponentials at TEMPERATURE), so it is 0.5 between two languages that fit alike.

Defined results: null text or one without a letter is `und` with score 0, and so is everything where nothing could be learnt;
letters that no language knows give the learnt language of the smallest name, with equal shares as the score; of an id with
several texts the smallest text and language are learnt from; rows without id take part in predictions and are not learnt
from; texts of any length are read in pieces; repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import exactly

FOLDS, HELD_OUT = 4, 2
#: Rows of each language that are learnt from, at most.
SAMPLE_PER_LANGUAGE = 600
#: Parts in which the ids of a language are ranked first.
DEALS = 64
#: N-grams of each language, at most.
PROFILE = 6000
SIZES = (1, 2, 3, 4)
ROWS, HASHES = 2**17, 3
TEMPERATURE = 0.02
UNKNOWN = "und"
#: Characters read at once.
CHUNK = 1 << 17

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in a process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def plain(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one space for each run of anything but letters, and one at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, np.uint32(32))
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
    space = points == 32
    return points[np.concatenate(([True], ~(space[1:] & space[:-1])))]


def grams(points: np.ndarray, starts: int | None = None) -> np.ndarray:
    """A 64-bit number for each n-gram that begins among the first `starts` places (all if not given), repeats included; a
    space stands only at the ends of an n-gram."""
    out = []
    wide = points.astype(np.uint64)
    word = points != 32
    for n in SIZES:
        count = min(len(points) - n + 1, starts or len(points))
        if count <= 0:
            break
        h = np.full(count, np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), np.uint64)
        for j in range(n):
            h = (h ^ wide[j : j + count]) * np.uint64(0x100000001B3)
        inner = word[:count].copy() if n == 1 else np.ones(count, bool)
        for j in range(1, n - 1):
            inner &= word[j : j + count]
        out.append(h[inner])
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams of a text of any length, CHUNK places at once, each n-gram once."""
    for at in range(0, len(points), CHUNK):
        yield grams(points[at : at + CHUNK + max(SIZES) - 1], CHUNK)


class Filter:
    """The bit-sliced filter: row -> words of language bits."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.words = -(-len(self.names) // 64)
        self.rows = np.zeros((ROWS, max(1, self.words)), np.uint64)
        for i, name in enumerate(self.names):
            bit = np.uint64(1 << (i % 64))
            for at in self.probes(profiles[name]):
                self.rows[at, i // 64] |= bit
        filled = self._popcounts(self.rows) / ROWS
        self.false = filled**HASHES

    @staticmethod
    def probes(h: np.ndarray) -> Iterator[np.ndarray]:
        first, step = h & np.uint64(ROWS - 1), (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield (first + np.uint64(k) * step) & np.uint64(ROWS - 1)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """[n-gram, word]: the languages that contain each n-gram."""
        out = None
        for at in self.probes(h):
            found = self.rows[at]
            out = found if out is None else out & found
        return out

    def _popcounts(self, masks: np.ndarray) -> np.ndarray:
        """For each language, in how many masks its bit is set."""
        return np.array([int(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum()) for i in range(len(self.names))], np.float64)

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """Popcounts of all n-grams of a text, and their number."""
        hits, n = np.zeros(len(self.names)), 0
        for h in pieces(plain(text)):
            hits, n = hits + self._popcounts(self.masks(h)), n + len(h)
        return hits, n

    def true_hits(self, text: str) -> tuple[np.ndarray, int]:
        hits, n = self.hits(text)
        return np.maximum(hits - self.false * n, 0) / (1 - self.false), n

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names:
            return UNKNOWN, 0.0
        true, n = self.true_hits(text)
        if n == 0:
            return UNKNOWN, 0.0
        best = int(true.argmax())
        return self.names[best], float(1 / np.exp((true - true[best]) / n / TEMPERATURE).sum())


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))


def training_rows(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """lang, text of the rows to learn from. Only ids are ranked, first within DEALS parts of each language and then what is
    left of these, so that no task ranks all rows of a common language; the ids chosen are then looked up in the documents."""
    own = exactly(docs, "doc_id", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).filter(fold() != HELD_OUT)
    own = own.withColumn("deal", F.xxhash64("doc_id")).dropDuplicates(["doc_id", "lang"])
    for part in (F.pmod("deal", F.lit(DEALS)), F.lit(0)):
        best = Window.partitionBy("lang", part).orderBy("deal", "doc_id")
        own = own.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= per_language).drop("n")
    chosen = own.groupBy(F.col("doc_id").alias("d")).agg(F.min("lang").alias("l"))
    texts = exactly(docs, "doc_id", "lang", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l")))
    return texts.groupBy("d", "l").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(F.col("l").alias("lang"), "text")


def profiles(sample: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> its most frequent n-grams. Tasks count the n-grams of their rows, Spark adds the counts up and ranks them;
    `size` numbers of each language come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for h in pieces(plain(text)):
                    found, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= size)
    found = top.groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams")).collect()
    return {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in found}


def languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; one pass, no shuffle."""
    filter_ = Filter(profiles(training_rows(docs, per_language)))
    model = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.value.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = exactly(docs, "doc_id", "text")
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "lang_pred", "score")
