"""Vector code compression: product codes from Lloyd's rounds with Hamerly's bounds, in whole numbers.

Each component x becomes floor(256 * x). A vector is cut into PARTS equal parts; each part position has a codebook of
ENTRIES entries, which starts as that part of the vectors with the smallest ids. A round assigns every part to the nearest
entry of its codebook (squared Euclidean distance, ties to the lower index) and moves each entry to the floor of the mean of
its parts; an entry without parts stays. After ROUNDS rounds the parts are assigned once more.

Every part keeps its entry and two bounds from one assignment to the next, in a written table: an upper bound of the distance
to its own entry and a lower bound of the distance to the second nearest. When the entries move, the upper bound grows by the
move of its own entry and the lower one shrinks by the largest move among the others. An upper bound strictly under the
lower one, or under half the distance from its entry to the next entry, proves that the entry is the only nearest one.
Otherwise the upper bound is made exact and tried again, and only then is the codebook scanned whole. Distances are whole
numbers; bounds are their roots, rounded outwards, so a tie is never decided by a bound.

Codebooks are broadcast: their size is PARTS * ENTRIES * width whatever the data. A task sums its parts for each entry, Spark
adds these sums up, and one number for each component of a codebook comes to the driver.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped; other vectors of a length
unlike that of the smallest kept id, or not a multiple of PARTS, cannot be cut and get null code and error; components beyond
2^27 after scaling count as 2^27 with their sign; fewer vectors than ENTRIES make smaller codebooks; of equal ids the smaller vector comes first,
and null ids come last; repeated rows each count; without vectors there are no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, exactly

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components are held within this, so that squared distances over a vector stay whole in 64 bits.
LIMIT = 2**27
#: Vectors handled at once in a task.
CHUNK = 4096
#: Pieces that the rows of one label are dealt to when the label's sum is joined.
SALTS = 16


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: whole numbers, for the vectors that are kept."""
    has_label = "label" in vectors.columns
    rows = exactly(vectors, "vec_id", "embedding", *(["label"] if has_label else []))
    label = F.col("label") if has_label else F.lit(None).cast("int")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    held = lambda x: F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return rows.filter(sound).select("vec_id", label.alias("label"), F.transform(wide, lambda x: F.floor(held(x)).cast("int")).alias("v"))


def cut(column: pa.Array, parts: int) -> np.ndarray:
    """Vectors of a batch as [row, part, component]."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), parts, -1)


def packed_rows(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    a = np.ascontiguousarray(a)
    return pa.Array.from_buffers(pa.binary(a.itemsize * a.shape[1]), len(a), [None, pa.py_buffer(a)]).cast(pa.binary())


def unpacked_rows(column: pa.Array, dtype, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype, (offsets[-1] - offsets[0]) // np.dtype(dtype).itemsize, offsets[0]).reshape(len(column), width)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the entries of a book, exact. Products are summed in floating point where
    everything stays below 2^53, which is exact, and in whole numbers elsewhere."""
    reach = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * x.shape[1] * reach * reach < 2**53:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
    x, book = x.astype(np.int64), book.astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for c in range(x.shape[1]):
        out += (x[:, c : c + 1] - book[:, c]) ** 2
    return out


def own_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its own entry, in whole numbers."""
    return ((x.astype(np.int64) - entries.astype(np.int64)) ** 2).sum(axis=-1)


def above(d2: np.ndarray) -> np.ndarray:
    """A root that is not too small, in 32 bits."""
    return np.nextafter(np.sqrt(d2.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def below(d2: np.ndarray) -> np.ndarray:
    """A root that is not too large, in 32 bits."""
    return np.maximum(np.nextafter(np.sqrt(d2.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Moves:
    """What bounds need to know of a codebook and of how far its entries have moved."""

    def __init__(self, book: np.ndarray, old: np.ndarray | None):
        self.step = above(own_distances(book, old)) if old is not None else np.zeros(len(book), np.float32)
        order = np.argsort(-self.step, kind="stable")
        self.farthest, self.most = order[0], self.step[order[0]]
        self.next_most = self.step[order[1]] if len(book) > 1 else np.float32(0)
        apart = np.array(distances(book, book), np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.nextafter(below(apart.min(axis=1)) / np.float32(2), np.float32(-np.inf))

    def moved(self, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        others = np.where(near == self.farthest, self.next_most, self.most)
        up = np.nextafter(upper + self.step[near], np.float32(np.inf))
        return up, np.nextafter(lower - others, np.float32(-np.inf))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equal ones), upper and lower bound."""
    d2 = np.array(distances(x, book))
    near, rows = d2.argmin(axis=1), np.arange(len(x))
    own = d2[rows, near]
    if len(book) == 1:
        return near, above(own), np.full(len(x), np.inf, np.float32)
    d2[rows, near] = np.iinfo(np.int64).max if d2.dtype == np.int64 else np.inf
    return near, above(own), below(d2.min(axis=1))


def assigned(x: np.ndarray, book: np.ndarray, moves: Moves, near: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The assignment of one part position after its entries moved, with bounds; and how many rows were scanned."""
    near, (upper, lower) = near.copy(), moves.moved(near, upper, lower)
    bound = np.maximum(lower, moves.half[near])
    open_ = np.flatnonzero(~(upper < bound))
    if len(open_):
        upper[open_] = above(own_distances(x[open_], book[near[open_]]))
        open_ = open_[~(upper[open_] < bound[open_])]
    if len(open_):
        near[open_], upper[open_], lower[open_] = scan(x[open_], book)
    return near, upper, lower, len(open_)


def _sums(x: np.ndarray, near: np.ndarray, entries: int) -> np.ndarray:
    """[part, entry, component + 1]: sums and, last, counts."""
    n, parts, width = x.shape
    cell = (near + np.arange(parts) * entries).ravel()
    out = np.empty((parts * entries, width + 1), np.int64)
    out[:, width] = np.bincount(cell, minlength=parts * entries)
    for c in range(width):
        out[:, c] = np.bincount(cell, weights=x[:, :, c].ravel(), minlength=parts * entries)
    return out


def _pass(rows: DataFrame, id_type: str, label_type: str, books: np.ndarray, old: np.ndarray | None, last: bool) -> DataFrame:
    """One assignment of all vectors. Rows of the result are vectors with their entries and bounds, and one row a task
    with its sums; or, at the last assignment, vectors with code and error."""
    parts, entries = books.shape[:2]
    shared = rows.sparkSession.sparkContext.broadcast((books, old))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, before = shared.value
        moves, total = [Moves(b, before[p] if before is not None else None) for p, b in enumerate(book)], 0
        names = ["vec_id", "label", "code", "error"] if last else ["vec_id", "label", "v", "near", "upper", "lower", "sums"]
        types = None
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                b = whole.slice(at, CHUNK)
                types = b.schema
                x = cut(b.column("v"), parts)
                if before is None:
                    found = [scan(x[:, p], book[p]) for p in range(parts)]
                else:
                    near, upper, lower = unpacked_rows(b.column("near"), np.uint8, parts), unpacked_rows(b.column("upper"), np.float32, parts), unpacked_rows(b.column("lower"), np.float32, parts)
                    found = [assigned(x[:, p], book[p], moves[p], near[:, p].astype(np.int64), upper[:, p], lower[:, p]) for p in range(parts)]
                near = np.stack([f[0] for f in found], axis=1)
                if last:
                    error = sum(own_distances(x[:, p], book[p][near[:, p]]) for p in range(parts))
                    codes = [bytes(r).hex() for r in near.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=names)
                    continue
                total = total + _sums(x, near, entries)
                upper, lower = np.stack([f[1] for f in found], axis=1), np.stack([f[2] for f in found], axis=1)
                state = [packed_rows(near.astype(np.uint8)), packed_rows(upper), packed_rows(lower)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), *state, pa.nulls(len(b), pa.list_(pa.int64()))], names=names)
        if not last and types is not None:
            nothing = [pa.nulls(1, types.field(c).type) for c in ("vec_id", "label", "v")] + [pa.nulls(1, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=names)

    found = "code string, error long" if last else "v array<int>, near binary, upper binary, lower binary, sums array<long>"
    return rows.mapInArrow(run, f"vec_id {id_type}, label {label_type}, {found}")


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at the floor of the mean of their parts; entries without parts stay."""
    parts, entries, width = books.shape
    sums = state.filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    for r in sums.collect():
        flat[r["at"]] = r["n"]
    cells = flat.reshape(parts, entries, width + 1)
    counts = cells[:, :, width :]
    return np.where(counts > 0, cells[:, :, :width] // np.maximum(counts, 1), books.astype(np.int64)).astype(np.float64)


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks [part, entry, component]."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is one byte: 1 to 256 entries")
    spark, kept = vectors.sparkSession, scaled(vectors)
    scratch = Scratch(spark)
    id_type, label_type = kept.schema["vec_id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()
    first = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    width = len(first[0]) if first else 0
    if width == 0 or width % parts:
        uncut = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return uncut, np.zeros((parts, 0, 0))
    fits = F.size("v") == width
    books = np.array([v for v in first if len(v) == width], np.float64).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    state, old = kept.filter(fits), None
    for r in range(rounds):
        state = scratch.written(f"state{r}", _pass(state, id_type, label_type, books, old, False))
        if r:
            scratch.dropped(f"state{r - 1}")
        books, old = moved_books(state, books), books
        state = state.filter(F.col("sums").isNull())
    coded = scratch.written("codes", _pass(state, id_type, label_type, books, old, True))
    scratch.dropped(*(n for n in list(scratch.paths) if n != "codes"))
    other = kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the errors summed over equal labels, nulls together; a label's rows meet its sum in SALTS places."""
    sums = coded.groupBy(F.col("label").alias("__l")).agg(F.sum("error").alias("label_error"))
    sums = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("__l")) & (F.col("__salt") == F.col("__s")), "left").drop("__l", "__s", "__salt")


def decoded(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """The vectors that codes stand for, unscaled: `approx` beside each code; null where there is no code."""
    parts, _, width = books.shape
    table = F.array(*[F.array(*[F.array(*[F.lit(float(c) / SCALE) for c in e]) for e in b]) for b in books])
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("approx", F.when(F.col("code").isNotNull(), F.flatten(F.array(*[table[p][entry(p)] for p in range(parts)]))))
