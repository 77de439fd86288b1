"""Sharding by balanced label propagation.

Documents of equal text are linked. Every linked document starts in a shard of its own choosing (a hash) and then moves,
round by round, to the shard that holds most of its neighbours among those with room for them all, or to the next best one.
A shard grants what fits into its quota, group by group, so groups that have gathered keep their place; the refused ones
ask elsewhere. Groups without neighbours in any shard with room are dealt along the rooms that are left, so no cycle of
full shards can stop them. Documents without links have no edges to cut and fill up what the linked ones leave. The law is `rows`: shards'
counts differ by one at most, exactly.

A group larger than a quota is cut into pieces of a whole shard and a rest. Pieces above a `BIG`-th of a shard, of which
there are BIG * n_shards at most, are placed one by one, the largest first. At the end a group is cut only where no shard
has room for it whole.

Defined results: a null text counts as empty; texts of any length are hashed, not moved; ties between shards go by hash;
rows repeated in full are documents of their own, linked by their text; null ids are kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_broadcast, numbered, text_or_empty, written

SHARDS = 24
#: Rounds of asking for the best shard, and for any; rounds of dealing between them. Most runs need one or two.
ROUNDS, DEALS = 4, 3
#: Rows of a shard are numbered by so many cells of equal hash ranges.
CELLS = 256
BIG = 16


def _bucket(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def _at(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def balanced_label_propagation(docs: DataFrame, id_col: str, link: Column, weight: Column, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """id, weight, link, at (a hash) and `shard` for every row of `docs`; rows with equal `link` are neighbours.

    State is one narrow row per linked document. A round counts neighbours by (group, shard), which folds a group of
    any size before the shuffle, lets each group ask for a shard, and moves all of its documents there if it is granted.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), weight.alias("weight"), link.alias("link")))
    groups = written(rows.groupBy("link").agg(F.count(F.lit(1)).alias("members")))
    rows = written(rows.join(groups, "link").withColumn("at", _bucket(1 << 30, F.col("id"), F.col("weight"), F.lit(7))))
    n = rows.count()
    quotas = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    smallest = max(1, n // n_shards)

    # Groups above a quota are cut into pieces; there are n_shards of them at most.
    linked, huge = rows.filter("members > 1").withColumn("cell", _bucket(CELLS, F.col("at"))), F.col("members") > smallest
    cut = numbered(linked.filter(huge), ["link"], "cell", [F.col("at"), F.col("id")], CELLS, "rank").withColumn("piece", F.floor(F.col("rank") / smallest))
    state = linked.filter(~huge).withColumn("piece", F.lit(0).cast("long")).select("id", "weight", "link", "at", "piece").unionByName(cut.select("id", "weight", "link", "at", "piece"))
    state = written(state.withColumn("shard", _bucket(n_shards, F.col("at"), F.lit(1))))
    settled, room = [], quotas

    big = _asking(state, quotas).filter((F.col("size") * BIG > smallest) & (F.col("size") > 1))
    placed = _place_big(big.select("link", "piece", "size", "prefs").collect(), room)  # BIG * n_shards rows at most
    if placed:
        chosen = bounded_broadcast(docs.sparkSession.createDataFrame([(*k, s) for k, s in placed.items()], _piece_type(state)))
        settled.append(written(state.join(chosen, ["link", "piece"]).select("id", "weight", "link", "at", "shard_to")))
        state = written(state.join(chosen, ["link", "piece"], "left_anti"))
        room = _less(room, settled[-1])

    def round_of(kind: str) -> bool:
        """One round; false if nothing moved."""
        nonlocal state, room
        asking = _asking(state, room, anywhere=kind == "anywhere")
        granted = _dealt(asking, room) if kind == "deal" else _granted(asking, room)
        moved = written(state.join(granted, ["link", "piece"]).select("id", "weight", "link", "at", "shard_to"))
        if moved.isEmpty():
            return False
        settled.append(moved)
        state, room = written(state.join(granted, ["link", "piece"], "left_anti")), _less(room, moved)
        return not state.isEmpty()

    if rounds and not state.isEmpty():
        for kind, most in (("neighbours", rounds), ("deal", DEALS), ("anywhere", rounds)):
            while most and not state.isEmpty() and round_of(kind):
                most -= 1

    # What fits nowhere whole, group after group, and then the rest: by rank, into what is left of the quotas.
    ends = list(accumulate(room))
    width = CELLS * n_shards
    left = state.withColumn("cell", _bucket(width, F.col("link"), F.col("piece")))
    left = numbered(left, [], "cell", [F.col("link"), F.col("piece"), F.col("at"), F.col("id")], width, "rank").select("id", "weight", "link", "at", "rank")
    loose = numbered(rows.filter("members = 1").withColumn("cell", _bucket(width, F.col("at"))), [], "cell", [F.col("at"), F.col("id")], width, "rank")
    rest = left.unionByName(loose.select("id", "weight", "link", "at", (F.col("rank") + state.count()).alias("rank")))
    out = rest.select("id", "weight", "link", "at", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("rank"))).alias("shard"))
    for moved in settled:
        out = out.unionByName(moved.withColumnRenamed("shard_to", "shard"))
    return out


def _piece_type(state: DataFrame) -> str:
    return f"link {state.schema['link'].dataType.simpleString()}, piece long, shard_to int"


def _less(room: list[int], moved: DataFrame) -> list[int]:
    taken = {r.shard_to: r.n for r in moved.groupBy("shard_to").agg(F.count(F.lit(1)).alias("n")).collect()}  # n_shards rows
    return [x - taken.get(s, 0) for s, x in enumerate(room)]


def _asking(state: DataFrame, room: list[int], anywhere: bool = False) -> DataFrame:
    """link, piece, size, prefs (held, tie, shard: its neighbours by shard, n_shards entries at most) and `want`: the
    shard that holds most of the group among those with room for all of it; null if none of them has. With `anywhere`,
    any shard with room will then do, by hash."""
    held = state.groupBy("link", "piece", "shard").agg(F.count(F.lit(1)).alias("held"))
    each = held.groupBy("link", "piece").agg(F.sum("held").alias("size"), F.collect_list(F.struct("held", F.xxhash64("link", "piece", "shard").alias("tie"), "shard")).alias("prefs"))
    want = F.array_max(F.filter("prefs", lambda p: _at(room, p["shard"]) >= F.col("size")))["shard"]
    if anywhere:
        free = F.filter(F.array(*[F.lit(s) for s in range(len(room))]), lambda s: _at(room, s) >= F.col("size"))
        want = F.coalesce(want, F.get(free, F.pmod(F.xxhash64("link", "piece"), F.greatest(F.size(free), F.lit(1))).cast("int")))
    return each.withColumn("want", want)


def _granted(asking: DataFrame, room: list[int]) -> DataFrame:
    """link, piece, shard_to: groups in hashed order, as far as they fit into the shard that they ask for."""
    asked = written(asking.filter("want IS NOT NULL").select("link", "piece", "size", F.col("want").alias("shard_to"), _bucket(CELLS, F.col("link"), F.col("piece")).alias("cell")))
    upto = numbered(asked, ["shard_to"], "cell", [F.col("link"), F.col("piece")], CELLS, "upto", "size")
    return written(upto.filter(F.col("upto") + F.col("size") <= _at(room, F.col("shard_to"))).select("link", "piece", "shard_to"))


def _dealt(asking: DataFrame, room: list[int]) -> DataFrame:
    """link, piece, shard_to: the rooms of all shards in one row, the groups laid along it. A group that lies across a
    border, of which there are fewer than shards, is left for the next deal."""
    asked = written(asking.select("link", "piece", "size", _bucket(CELLS, F.col("link"), F.col("piece")).alias("cell")))
    upto = numbered(asked, [], "cell", [F.col("link"), F.col("piece")], CELLS, "upto", "size")
    ends = F.array(*[F.lit(e).cast("long") for e in accumulate(room)])
    shard = lambda row: F.size(F.filter(ends, lambda e: e <= row))
    first, last = shard(F.col("upto")), shard(F.col("upto") + F.col("size") - 1)
    return written(upto.filter((first == last) & (first < len(room))).select("link", "piece", first.alias("shard_to")))


def _place_big(pieces: list, room: list[int]) -> dict[tuple, int]:
    """(link, piece) -> shard, the largest first: the one that holds most of it among those with room, else any with the
    least room that will do. What fits nowhere is left out."""
    left, out = list(room), {}
    for r in sorted(pieces, key=lambda r: (-r["size"], str(r["link"]), r["piece"])):
        fits = [s for s, x in enumerate(left) if x >= r["size"]]
        if fits:
            held = defaultdict(int, {p["shard"]: p["held"] for p in r["prefs"]})
            # a whole shard goes to an empty one that holds least more than it needs
            best = min(fits, key=lambda s: (-held[s], left[s], s))
            left[best] -= r["size"]
            out[r["link"], r["piece"]] = best
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: equal texts are linked; slots run from 0 in every shard."""
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), F.md5(text).alias("md5"))
    placed = written(balanced_label_propagation(own, "doc_id", F.struct("md5", "crc"), F.col("size"), n_shards, rounds).withColumn("cell", _bucket(CELLS, F.col("at"))))
    out = numbered(placed, ["shard"], "cell", [F.col("at"), F.col("id"), F.col("link")], CELLS, "slot")
    return out.select(F.col("id").alias("doc_id"), F.col("weight").alias("size"), F.col("link.crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
