"""Near-dedup by exact Jaccard similarity of word shingles: links are pairs at SIMILARITY or above.

The first candidates come from SimHash, as in op9: a set's fingerprint has the bits that over half of its hashes have, covering masks
find every pair of fingerprints within the radius, and each component of those links is a bucket. Its radius holds few of the pairs at 0.8: they
differ in about 10 of 64 bits, for which covering masks would number over 2**16. What it leaves open gets more candidates from MinHash: BANDS keys, each over ROWS minima, so that a pair at
Jaccard j shares a key with probability 1 - (1 - j**ROWS)**BANDS, which is 0.9998 at 0.8 and more above; buckets that SimHash has
made one component already are left out. Every candidate of both is verified on the whole shingle sets.

Equal sets are folded into one node first; buckets with the same members are compared once, in blocks of bounded size,
and only the edges of a spanning forest leave a block. A bucket of up to FEW blocks is compared in all pairs of them, which
takes no more copies than to split it. In a larger one each member meets its bucket's leaders and its own block, one copy. A bucket whose members are one component then, as
families of copies are, is done. What is still open is split by further minima, BANDS keys within the bucket, which its links
share by the same chance again; after SPLITS of them the rest, if any, is compared in all pairs of blocks.

Defined results: a null or empty text has the empty set, linked to its like; a short text is one shingle, a long one is
hashed in chunks; ids may be of any type that has an order; a null doc_id counts as larger than any; of rows repeated in
full one stays; a pair at the similarity exactly is linked; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from . import simhash
from .common import packed, written
from .simhash import all_blocks, connected_components, led_blocks, unsettled

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 16
SEED = 43
#: Sets of a bucket that are compared with each other in one go.
BLOCK = 512
#: How often an open bucket is split by further minima.
SPLITS = 2
#: Blocks of a bucket up to which all pairs of them take no more copies of a member than a split does.
FEW = BANDS
CHUNK = 4096


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; ASCII case and white space do not count."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def set_key(found: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


@cache
def _hashing(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64), rng.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1)


def band_keys(found: np.ndarray, seed: int = SEED) -> np.ndarray:
    xor, times = _hashing(seed)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[None, at : at + CHUNK] ^ xor) * times).min(axis=1))
    return np.array([xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set as a signed long; that of the empty set is zero."""
    chunks = (found[at : at + simhash.CHUNK] for at in range(0, len(found), simhash.CHUNK))
    return int(np.uint64(simhash.majority(chunks, len(found))).astype(np.int64))


def marks(found: np.ndarray) -> np.ndarray:
    """The fingerprint and, behind it, the MinHash keys."""
    return np.concatenate((np.array([fingerprint(found)], np.int64), band_keys(found)))


def _lists(keys: list[np.ndarray], n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * n, pa.int32()), pa.array(np.concatenate(keys or [np.zeros(0, np.int64)])))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(s) for s in sets], pa.int64()), b.column(2), _lists([marks(s) for s in sets], 1 + BANDS)], names=["doc_id", "fp", "text_key", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "shingles"])


def _finer(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([band_keys(np.frombuffer(s.as_py(), np.uint64), seed) for s in b.column(1)], BANDS)], names=["fp", "bands"])

    return run


def forest(sets: list[np.ndarray], ids: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the given sets, each compared whole."""
    sizes = np.array([len(s) for s in sets])
    edges, left = [], np.arange(len(sets))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            # no pair of more unequal sizes can be similar enough
            fits = np.minimum(sizes[left], sizes[k]) >= similarity * np.maximum(sizes[left], sizes[k])
            asked = left[fits & (sizes[left] > 0)] if sizes[k] else left[:0]
            if not len(asked):
                continue
            flat = np.concatenate([sets[j] for j in asked])
            at = np.minimum(np.searchsorted(sets[k], flat), sizes[k] - 1)
            shared = np.add.reduceat(sets[k][at] == flat, np.concatenate(([0], np.cumsum(sizes[asked])[:-1])), dtype=np.int64)
            found = asked[shared / (sizes[asked] + sizes[k] - shared) >= similarity]
            left = left[~np.isin(left, found)]
            edges += [(ids[k], ids[j]) for j in found]
            front += found.tolist()
    return edges


def _block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block that a batch cuts waits for the rest."""
    now, sets, ids = None, [], []

    def out() -> pa.RecordBatch:
        both = np.array(forest(sets, ids), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], names=["a", "b"])

    for b in batches:
        for block, node, shingles in zip(zip(*(b.column(i).to_pylist() for i in range(4))), b.column(4).to_pylist(), b.column(5)):
            if block != now:
                if len(ids) > 1:
                    yield out()
                now, sets, ids = block, [], []
            sets.append(np.frombuffer(shingles.as_py(), np.uint64))
            ids.append(node)
    if len(ids) > 1:
        yield out()


def _buckets(keyed: DataFrame) -> DataFrame:
    """t, key, fp and blocks of all members of buckets with more than one; of buckets with the same members, one."""
    keyed = written(keyed)
    buckets = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("all")).filter("n > 1")
    buckets = buckets.groupBy("n", "low", "high", "all").agg(F.min(F.struct("t", "key")).alias("x"))
    large = written(buckets.select("x.t", "x.key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")))
    return written(keyed.join(large, ["t", "key"]))


def _simhash_classes(nodes: DataFrame) -> DataFrame:
    """t, key, fp: the component of each set's fingerprint by op9's links, of nodes fp and bands."""
    prints = nodes.select("fp", F.col("bands")[0].alias("print"))
    found = connected_components(simhash.links(written(prints.select(F.col("print").alias("fp")).distinct())))
    return prints.join(found, F.col("print") == F.col("node"), "left").select(F.lit(-1).alias("t"), F.coalesce("component", "print").alias("key"), "fp")


def links(docs: DataFrame, marked: DataFrame, text_col: str = "text") -> DataFrame:
    """Edges a < b between set keys that connect the same nodes as all verified candidates do. marked: see `_marks`."""
    nodes = written(marked.dropDuplicates(["fp"]).select("fp", "bands"))
    near = _buckets(_simhash_classes(nodes))
    wider = _buckets(nodes.select(F.posexplode(F.slice("bands", 2, BANDS)).alias("t", "key"), "fp"))
    asked = near.select("fp").union(wider.select("fp")).distinct()
    wanted = written(marked.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("text_key").alias("text_key")).select("text_key").distinct())
    texts = docs.select(F.col(text_col).alias("text"), _text_key(text_col).alias("text_key")).join(wanted, "text_key", "left_semi").select("text")
    sets = written(texts.mapInArrow(_sets, "fp long, shingles binary").dropDuplicates(["fp"]))
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def compared(blocks: DataFrame) -> DataFrame:
        rows = blocks.join(sets, "fp").select("t", "key", "lo", "hi", "fp", "shingles").repartition(parts, "t", "key", "lo", "hi")
        return rows.sortWithinPartitions("t", "key", "lo", "hi").mapInArrow(_block_edges, "a long, b long").filter("a < b")

    def met(members: DataFrame) -> DataFrame:
        few = F.col("blocks") <= FEW
        return compared(all_blocks(members.filter(few), "t", "key").unionByName(led_blocks(members.filter(~few), "t", "key")))

    found = written(met(near).distinct())
    members = unsettled(wider, found, "t", "key")
    found = written(found.unionByName(met(members)).distinct())
    for depth in range(SPLITS + 1):
        large = members.filter(F.col("blocks") > FEW)
        if large.isEmpty():
            break
        open_ = unsettled(large, found, "t", "key")
        if open_.isEmpty():
            break
        if depth == SPLITS:
            return found.unionByName(compared(all_blocks(open_, "t", "key"))).distinct()
        finer = sets.join(open_.select("fp").distinct(), "fp", "left_semi").mapInArrow(_finer(SEED + 1 + depth), "fp long, bands array<long>")
        keyed = open_.join(finer, "fp").select("t", "key", "fp", F.posexplode("bands").alias("s", "band"))
        members = unsettled(_buckets(keyed.select("fp", F.col("s").alias("t"), F.xxhash64("t", "key", "s", "band").alias("key"))), found, "t", "key")
        found = written(found.unionByName(met(members)).distinct())
    return found


def _text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all its columns; of rows repeated in full, one."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key"))
    marked = written(own.mapInArrow(_marks, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long, text_key long, bands array<long>"))
    found = connected_components(links(docs, marked, text_col))
    grouped = marked.select("doc_id", "fp", "text_key").join(found, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("group"))
    first = grouped.agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first"))
    key = lambda i, text_key: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), text_key)
    kept = first.select(key(F.col("first.doc_id"), F.col("first.text_key")).alias("key"))
    keyed = docs.select(packed(docs), key(F.col(id_col), _text_key(text_col)).alias("key"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
