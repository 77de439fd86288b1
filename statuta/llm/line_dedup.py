"""Line dedup that can be undone: exact reference counts behind sharded cuckoo filters.

The index is a table of reference counts, `hi, lo, n_docs`: the 128-bit hash of a line's key and the number of
documents that hold it. Adding and deleting documents adds signed counts. Keys that reach the threshold are put into
cuckoo filters, one for each shard of keys; keys that fall below it are deleted from their filter, so filters follow the
counts both ways. A filter has no false negatives; its false positives are all found by probing it with the whole table
of counts, and kept beside it as exceptions. Filter and exceptions together therefore decide every line exactly.

At every size, lines travel to the filters and not filters to the lines: each line's hash goes to a task that holds its
shard's filter, with the number of its row and of its line, and what is to be dropped comes back to the row. A shard is
served by several tasks, dealt by row, so that a line of a third of all documents meets no single one. A task holds one
filter at a time, of about `SHARD_KEYS` keys.

Defined results: a null or empty text is one empty line, whose empty key is never dropped; texts of any length are split
whole; equal lines of a text fall or stay together; rows repeated in full are documents of their own, decided alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_128_intdigest

from .common import written

MIN_DOCS = 10
MIN_CHARS = 1
#: Frequent keys of one filter, about, and all keys of its shard: one in 8000 of them may be an exception at worst.
SHARD_KEYS, SHARD_ALL_KEYS = 100_000, 500_000_000
#: Tasks that serve a shard, at least.
SALTS = 32
SLOTS = 4
MAX_KICKS = 500


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """A text's lines and their keys. bytes.strip and bytes.lower know ASCII alone, as asked."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def _hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2): the 128-bit hashes as pairs of signed longs."""
    data = b"".join(xxh3_128_intdigest(k).to_bytes(16, "little") for k in keys)
    return np.frombuffer(data, np.int64).reshape(-1, 2)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, each reachable from the other by its fingerprint."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized_for(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85))))))

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        """A filter with all keys; one that overflows is built anew at twice the size."""
        found = cls.sized_for(len(hi))
        while not all(found.insert(h, x) for h, x in zip(hi.tolist(), lo.tolist())):
            found = cls(found.buckets * 2)
        return found

    def _places(self, hi, lo):
        """Fingerprint, first and second bucket; for numbers and for arrays."""
        fp = (hi & 0xFFFF) | (1 * ((hi & 0xFFFF) == 0))
        one = lo & (self.buckets - 1)
        return fp, one, one ^ ((fp * 0x5BD1) & (self.buckets - 1))

    def insert(self, hi: int, lo: int) -> bool:
        fp, at, other = self._places(hi, lo)
        for b in (at, other):
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = fp
                return True
        for k in range(MAX_KICKS):
            slot = (k + fp) % SLOTS
            fp, self.slots[other, slot] = int(self.slots[other, slot]), fp
            other ^= (fp * 0x5BD1) & (self.buckets - 1)
            free = np.flatnonzero(self.slots[other] == 0)
            if len(free):
                self.slots[other, free[0]] = fp
                return True
        return False

    def delete(self, hi: int, lo: int) -> bool:
        fp, one, two = self._places(hi, lo)
        for b in (one, two):
            held = np.flatnonzero(self.slots[b] == fp)
            if len(held):
                self.slots[b, held[0]] = 0
                return True
        return False

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(hi, lo)
        fp = fp[:, None]
        return (self.slots[one] == fp).any(axis=1) | (self.slots[two] == fp).any(axis=1)


def reference_counts(docs: DataFrame, text_col: str = "text", sign: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """hi, lo, n_docs of all keys of `min_chars` code points or more; sign -1 counts documents to be taken out."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_hashes([k for k in set(line_keys(t.as_py())[1]) if _long_enough(k, min_chars)]) for t in b.column(0)]
            both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["hi", "lo"])

    lines = docs.select(F.col(text_col).alias("text")).mapInArrow(keys, "hi long, lo long")
    return lines.groupBy("hi", "lo").agg((F.count(F.lit(1)) * sign).alias("n_docs"))


class LineIndex:
    """Reference counts with their filters. `insert` and `delete` give a new index; deleting what was inserted gives
    back the counts, and the decisions, there were. Filters are a written table: shard, buckets, slots, wrong (the
    shard's exceptions, 16 bytes each)."""

    def __init__(self, counts: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        self.counts, self.min_docs, self.min_chars, self.shard_keys = counts, min_docs, min_chars, shard_keys
        self.shards, self._filters = 0, None

    @classmethod
    def of(cls, docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        return cls(written(reference_counts(docs, text_col, 1, min_chars)), min_docs, min_chars, shard_keys)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(docs, text_col, -1)

    def _changed(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        change = written(reference_counts(docs, text_col, sign, self.min_chars))
        both = self.counts.unionByName(change).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"))
        new = LineIndex(written(both.filter("n_docs > 0")), self.min_docs, self.min_chars, self.shard_keys)
        if self._filters is not None:
            old = self.counts.withColumnRenamed("n_docs", "old")
            moved = both.join(change.select("hi", "lo"), ["hi", "lo"], "left_semi").join(old, ["hi", "lo"], "left")
            was, now = F.coalesce("old", F.lit(0)) >= self.min_docs, F.col("n_docs") >= self.min_docs
            new._follow(self, written(moved.filter(was != now).select("hi", "lo", now.alias("frequent"))))
        return new

    def _follow(self, old: LineIndex, moved: DataFrame) -> None:
        """Takes over the filters of `old`, with the keys that crossed the threshold put in or deleted, shard by shard.
        If one overflows, or more keys came than the shards were made for, all are built anew when asked for."""
        if moved.count() > old.shards * self.shard_keys:
            return

        def follow(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if len(filters):
                f = CuckooFilter(int(filters["buckets"].iloc[0]), np.frombuffer(filters["slots"].iloc[0], np.uint16).reshape(-1, SLOTS).copy())
                shard = filters["shard"].iloc[0]
            else:  # a shard without frequent keys so far
                f, shard = CuckooFilter.sized_for(len(keys)), keys["shard"].iloc[0]
            done = all([f.insert(h, x) if up else f.delete(h, x) for h, x, up in zip(keys["hi"].tolist(), keys["lo"].tolist(), keys["frequent"])])
            return pd.DataFrame({"shard": [shard], "buckets": [f.buckets], "slots": [f.slots.tobytes()], "done": [done]})

        keys = moved.withColumn("shard", _shard_of(old.shards))
        after = written(old._filters.drop("wrong").groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(follow, "shard int, buckets long, slots binary, done boolean"))
        if after.filter("NOT done").isEmpty():
            self.shards, self._filters = old.shards, self._with_exceptions(after.drop("done"), old.shards)

    def filters(self) -> DataFrame:
        """The filters, built in one task for each shard when first asked for."""
        if self._filters is None:
            n_all, n = self.counts.agg(F.count(F.lit(1)), F.count(F.when(F.col("n_docs") >= self.min_docs, 1))).first()
            self.shards = max(1, -(-n // self.shard_keys), -(-n_all // SHARD_ALL_KEYS))

            def build(rows: pd.DataFrame) -> pd.DataFrame:
                f = CuckooFilter.of(rows["hi"].to_numpy(), rows["lo"].to_numpy())
                return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "buckets": [f.buckets], "slots": [f.slots.tobytes()]})

            frequent = self.counts.filter(F.col("n_docs") >= self.min_docs).select("hi", "lo", _shard_of(self.shards).alias("shard"))
            built = written(frequent.groupBy("shard").applyInPandas(build, "shard int, buckets long, slots binary"))
            self._filters = self._with_exceptions(built, self.shards)
        return self._filters

    def _with_exceptions(self, filters: DataFrame, shards: int) -> DataFrame:
        """Adds `wrong`: keys below the threshold that the filter holds all the same."""
        rare = self.counts.filter(F.col("n_docs") < self.min_docs).select("hi", "lo", F.xxhash64("hi", "lo").alias("row"), F.lit(0).alias("line"))
        hits = _probed(filters.withColumn("wrong", F.lit(b"")), rare, shards).withColumn("shard", _shard_of(shards))

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "wrong": [np.ascontiguousarray(rows[["hi", "lo"]].to_numpy()).tobytes()]})

        wrong = hits.groupBy("shard").applyInPandas(pack, "shard int, wrong binary")
        return written(filters.join(wrong, "shard", "left").withColumn("wrong", F.coalesce("wrong", F.lit(b""))))

    def drop_lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text. `docs` may be other documents than those counted."""
        filters, least = self.filters(), self.min_chars
        own = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    rows, numbers, keys = [], [], []
                    for row, t in zip(b.column(0)[at : at + 500].to_pylist(), b.column(1)[at : at + 500]):
                        for k, key in enumerate(line_keys(t.as_py())[1]):
                            if _long_enough(key, least):
                                rows.append(row)
                                numbers.append(k)
                                keys.append(key)
                    both = _hashes(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32())], names=["hi", "lo", "row", "line"])

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for t, gone in zip(b.column(1), b.column(2)):
                    all_lines, gone = (t.as_py() or "").split("\n"), set(gone.as_py() or ())
                    out.append((len(all_lines), len(gone), "\n".join([x for k, x in enumerate(all_lines) if k not in gone]) if gone else t.as_py() or ""))
                n, dropped, texts = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

        each = own.select("row", "text").mapInArrow(lines, "hi long, lo long, row long, line int")
        gone = _probed(filters, each, self.shards).groupBy(F.col("row").alias("r")).agg(F.collect_list("line").alias("gone"))
        joined = own.join(gone, F.col("row") == F.col("r"), "left").select("doc_id", "text", "gone")
        return joined.mapInArrow(drop, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string")


def _shard_of(shards: int) -> Column:
    return F.pmod(F.shiftright("hi", 16), F.lit(shards)).cast("int")


def _probed(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """Those rows of `keys` (hi, lo, row, line) that their shard's filter holds and its exceptions do not.

    A shard's filter goes to each of the tasks that serve it, ahead of the keys dealt to that task by row."""
    parts = max(8, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salts = max(SALTS, -(-parts // shards))
    cells = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda salt: F.col("shard").cast("long") * salts + salt)
    cell = F.col("shard").cast("long") * salts + F.pmod(F.xxhash64("row"), F.lit(salts))
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")  # numbers are never null: they go to arrays as they are
    held = filters.select(F.explode(cells).alias("cell"), F.lit(0).alias("kind"), "buckets", "slots", "wrong", zero.alias("hi"), zero.alias("lo"), zero.alias("row"), F.lit(0).alias("line"))
    asked = keys.withColumn("shard", _shard_of(shards)).select(cell.alias("cell"), F.lit(1).alias("kind"), zero.alias("buckets"), none.alias("slots"), none.alias("wrong"), "hi", "lo", "row", "line")
    dealt = held.unionByName(asked).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_probe, "hi long, lo long, row long, line int")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, each cell's filter first; a cell without one holds no frequent key."""
    now, f, wrong = None, None, None
    for b in batches:
        cells, kinds = b.column("cell").to_numpy(), b.column("kind").to_numpy()
        asked = [b.column(c).to_numpy() for c in ("hi", "lo")]
        hit = np.zeros(len(cells), bool)
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if start == end:
                continue
            if cells[start] != now:
                now, f = cells[start], None
            if kinds[start] == 0:
                f = CuckooFilter(b.column("buckets")[start].as_py(), np.frombuffer(b.column("slots")[start].as_py(), np.uint16).reshape(-1, SLOTS))
                wrong = np.frombuffer(b.column("wrong")[start].as_py(), "i8,i8")
                start += 1
            if f is not None and start < end:
                hi, lo = (x[start:end] for x in asked)
                found = f.contains(hi, lo)
                if len(wrong) and found.any():
                    found[found] = ~np.isin(np.stack([hi[found], lo[found]], axis=1).view("i8,i8").ravel(), wrong)
                hit[start:end] = found
        if hit.any():
            yield b.filter(pa.array(hit)).select(["hi", "lo", "row", "line"])


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Counts all documents' keys and drops the lines of frequent ones everywhere."""
    return LineIndex.of(docs, text_col, min_docs, min_chars, shard_keys).drop_lines(docs, id_col, text_col)
