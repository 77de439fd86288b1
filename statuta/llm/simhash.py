"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Two fingerprints are linked if they
differ in at most RADIUS bits; documents form components over links.

Candidate search loses no pair: every bit position gets a random vector of RADIUS+1 bits, and for each of the
2**(RADIUS+1)-1 nonzero vectors v there is a mask of the positions whose vector has an odd product with v. The vectors
of RADIUS positions cannot span the whole space, so some v is orthogonal to all of them, and its mask leaves out every
position in which two fingerprints within the radius differ: they agree on the masked bits and meet in that table.

Equal fingerprints are folded into one node first. A bucket of up to `BLOCK` fingerprints is compared in one go as it
streams by, and only the edges of a spanning forest leave it. One of up to FEW times as many is compared in all pairs of
blocks, which takes no more copies than to split it. In a larger one every member is compared with its bucket's
leaders and with the block that it falls into, which costs a copy a member. A bucket whose members are one component then,
as families of copies are, holds no link that would join anything else and is done. What is still open is split by the next
family of masks, whose guarantee holds within a bucket as well: its members agree on half of the bits already, so these
buckets are smaller by far. No link is left out: what remains open after the last family is compared in all pairs of blocks.

Defined results: a null or empty text has fingerprint zero, linked like any other; a short text is one shingle, a long
one is counted in chunks; a bit set in exactly half of the hashes is 0; repeated rows share a component; ids may be of
any type that has an order; a null doc_id counts as larger than any; an empty table gives no rows; other columns are
ignored by `near_components` and carried along by `drop_near_copies`.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import packed, written

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Fingerprints of a bucket that are compared with each other in one go.
BLOCK = 1024
#: Seeds of the families of masks, in the order of their use.
FAMILIES = (11, 12, 13)
#: Blocks of a bucket up to which all pairs of them take no more copies of a member than a family of masks does.
FEW = (2 << RADIUS) - 1
#: Members of a large bucket, chosen by hash, that meet all its members.
LEADERS = 32
#: Places of a component's name.
SALTS = 32
#: Shingles whose bits are counted at once, which bounds memory on long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """bytes.lower and bytes.split know ASCII alone, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    return majority((np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])), np.uint64) for at in range(0, n, CHUNK)), n)


def majority(chunks: Iterable[np.ndarray], n: int) -> int:
    """The bits that over half of n hashes have, which come in chunks."""
    ones = np.zeros(BITS, np.int64)
    for h in chunks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2)], names=["doc_id", "fp", "text_key"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_key (a hash of the text, which tells rows of one id apart)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key"))
    return own.mapInArrow(_fingerprints, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long, text_key long")


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = 11) -> list[int]:
    """2**(radius+1)-1 masks, as signed longs. Vectors are drawn in shuffled rounds over all nonzero ones, so every mask
    holds about half of the bits."""
    rng, vectors = random.Random(seed), []
    while len(vectors) < bits:
        vectors += rng.sample(range(1, 2 << radius), (2 << radius) - 1)
    masks = [sum(1 << i for i, v in enumerate(vectors[:bits]) if (v & w).bit_count() % 2) for w in range(1, 2 << radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the given fingerprints: a search from each unvisited node that
    compares the front node with all unvisited ones."""
    edges, left = [], np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[k]) <= radius
            if near.any():
                found, left = left[near], left[~near]
                edges += [(int(ids[k]), int(ids[j])) for j in found]
                front += found.tolist()
    return edges


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Arrays of (key, fp) rows, sorted by key, none of which ends within a key's rows unless it holds over BLOCK of them."""
    waiting = np.empty((0, 2), np.int64)
    for b in batches:
        rows = np.concatenate((waiting, np.stack([c.to_numpy() for c in b.columns], axis=1)))
        last = np.searchsorted(rows[:, 0], rows[-1, 0]) if len(rows) else 0
        whole = len(rows) if len(rows) - last > BLOCK else last
        done, waiting = rows[:whole], rows[whole:]
        if len(done):
            yield done
    if len(waiting):
        yield waiting


def _edges_by_bucket(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a, b) of each bucket; the members of one above BLOCK as (key, fp), `big`."""
        carried = None  # key of a bucket whose first part was too large already
        for rows in _runs(batches):
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)]))
            sizes, fps = np.diff(bounds), rows[:, 1]
            one = bounds[:-1][sizes == 2]
            near = np.bitwise_count((fps[one] ^ fps[one + 1]).view(np.uint64)) <= radius
            edges, big = [np.stack([fps[one[near]], fps[one[near] + 1]], axis=1)], []
            for k in np.flatnonzero((sizes > 2) | (bounds[:-1] == 0)).tolist():
                part = rows[bounds[k] : bounds[k + 1]]
                if len(part) > BLOCK or part[0, 0] == carried:
                    big.append(part)
                    carried = part[0, 0]
                elif sizes[k] > 2:
                    edges.append(np.array(_forest(part[:, 1].view(np.uint64), part[:, 1], radius), np.int64).reshape(-1, 2))
            both = np.concatenate(edges)
            found = np.concatenate([np.stack([both.min(axis=1), both.max(axis=1)], axis=1), *big]) if len(both) or big else both
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.arange(len(found)) >= len(both))], names=["a", "b", "big"])

    return run


def _block_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, lo, hi, fp) come sorted by block, each of which is held whole."""
        now, held = None, []

        def out() -> pa.RecordBatch:
            fps = np.array(held, np.int64)
            both = np.array(_forest(fps.view(np.uint64), fps, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], names=["a", "b"])

        for b in batches:
            for *block, fp in zip(*(c.to_pylist() for c in b.columns)):
                if block != now:
                    if len(held) > 1:
                        yield out()
                    now, held = block, []
                held.append(fp)
        if len(held) > 1:
            yield out()

    return run


def led_blocks(members: DataFrame, *bucket: str) -> DataFrame:
    """(bucket, lo, hi, fp) for members (bucket, fp, blocks): each one in a block of its own choosing, and a bucket's leaders
    in all of its blocks. A leader that meets itself makes an edge to itself, which joins nothing."""
    block, cell = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(LEADERS)).alias("cell")
    leaders = members.filter("blocks > 1").groupBy(*bucket, "blocks", cell).agg(F.min("fp").alias("fp"))
    leaders = leaders.select(*bucket, "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("lo"))
    return members.select(*bucket, "fp", block.alias("lo")).unionByName(leaders).select(*bucket, "lo", F.col("lo").alias("hi"), "fp")


def all_blocks(members: DataFrame, *bucket: str) -> DataFrame:
    """(bucket, lo, hi, fp): each member in every pair of blocks that holds its own, so that any two of a bucket meet."""
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    placed = members.select(*bucket, "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return placed.select(*bucket, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")


def unsettled(members: DataFrame, edges: DataFrame, *bucket: str) -> DataFrame:
    """Members of the buckets that are not one component by these edges; the others hold no link that joins anything else."""
    label = connected_components(edges).select(F.col("node").alias("fp"), "component")
    named = F.coalesce("component", "fp")
    parted = members.join(label, "fp", "left").groupBy(*bucket).agg(F.min(named).alias("least"), F.max(named).alias("most")).filter("least < most")
    return written(members.join(parted.select(*bucket), list(bucket), "left_semi"))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a < b between fingerprints that connect the same nodes as all links do. nodes: fp (distinct, written)."""
    parts = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def bucketed(rows: DataFrame, seed: int) -> DataFrame:
        # A bucket is known by a hash of the one around it, table and masked bits: two that share one are compared together, no more.
        keys = F.array(*[F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(covering_masks(radius, seed=seed))])
        keyed = rows.repartition(parts).select(F.explode(keys).alias("key"), "fp")
        return written(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_edges_by_bucket(radius), "a long, b long, big boolean"))

    def compared(blocks: DataFrame) -> DataFrame:
        rows = blocks.select("key", "lo", "hi", "fp").repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        return rows.mapInArrow(_block_edges(radius), "a long, b long")

    found, open_ = [], nodes.select(F.lit(0).cast("long").alias("key"), "fp")
    for seed in FAMILIES:
        split = bucketed(open_, seed)
        found, large = [*found, split.filter("NOT big").select("a", "b")], split.filter("big").select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if large.isEmpty():
            break
        sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
        large = written(large.join(sizes, "key"))
        few = F.col("blocks") <= FEW
        blocks = all_blocks(large.filter(few), "key").unionByName(led_blocks(large.filter(~few), "key"))
        found, large = [written(reduce(DataFrame.unionByName, [*found, compared(blocks)]).filter("a < b").distinct())], large.filter(~few)
        if large.isEmpty():
            break
        open_ = unsettled(large, found[0], "key")
        if open_.isEmpty():
            break
    else:
        found.append(compared(all_blocks(open_, "key")))
    return reduce(DataFrame.unionByName, found).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge, by alternating star contraction.

    Rounds alternate large stars (a node's larger neighbours go to its smallest one) and small stars (its smaller
    neighbours do) until nothing moves; the number of rounds grows with the logarithm of the longest chain. Minima are
    aggregated on the map side and joined back as a written table, so that Spark can split a hub's edges.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m")))
        star = both.join(least, both["u"] == least["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(star.filter("u <> v").distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        star = large.join(least, large["u"] == least["k"])
        small = star.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return written(roots.unionByName(roots.select(F.col("component").alias("node"), "component")).distinct())


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, text_key, component_id and group (the component's smallest fingerprint) for every row."""
    return components_of(written(fingerprints(docs, id_col, text_col)), radius)


def components_of(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """component_id added to `marked`: doc_id, fp and more, written. Fingerprints are the nodes; a component is then named
    by its smallest doc_id."""
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = nodes.join(connected_components(links(nodes, radius)), F.col("fp") == F.col("node"), "left").select("fp", "least", "component")
    # a component of a third of all fingerprints meets its name in SALTS places
    names = found.filter("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min("least").alias("name"))
    names = names.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")  # never sent to all tasks
    salted = found.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    named = salted.join(names, (F.col("component") == F.col("c")) & (F.col("salt") == F.col("s")), "left")
    label = written(named.select(F.col("fp").alias("f"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"), F.coalesce("component", "fp").alias("group")))
    return marked.join(label, F.col("fp") == F.col("f"), "left").select(*marked.columns, "component_id", "group")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each component, with all its columns; of rows repeated in full, one."""
    key = lambda i, text_key: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), text_key)
    found = near_components(docs, id_col, text_col, radius)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first"))
    kept = first.select(key(F.col("first.doc_id"), F.col("first.text_key")).alias("key"))
    keyed = docs.select(packed(docs), key(F.col(id_col), _text_key(text_col)).alias("key"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
