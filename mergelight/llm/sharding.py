"""Sharding by minimax contiguous partition, with DataFrame operations only.

Documents with equal texts are one atomic group; groups are ordered by their least document id
and cut into contiguous shards at the smallest capacity for which a greedy walk needs no more
shards than there are, found by binary search.  A group above the capacity is a shard of its own,
still in its place, so a text with a third of all bytes doesn't decide how full the others
may be; the largest shard is as small as it can be all the same.

The walk needs prefix sums over all groups, so it runs on sums of ranges of ids.  A walk that may
cut only between ranges gives a capacity that is surely enough; a walk that may cut ranges anywhere
gives one below which none is.  While the two differ, the few ranges in which the walks can cut
are summed again, 64 times finer, down to single groups.  When they meet, that capacity is the
minimum and the cuts between ranges keep to it.  The driver sees range sums, a few thousand in
the first round and at most 64 for each place of a cut in later ones, never all groups.

Rows find their group by a join that spreads heavy texts (see ``attach``).
Slots count the rows of a shard in document order; rows are numbered in range partitions with
offsets, so no task holds a whole shard.

Defined results: a null text has no bytes, size 1 and checksum 0, and is one group with empty
texts; a null id counts as the least id; groups with the same least id (an id with several
texts) stay together; repeated rows get slots of their own; an empty table gives an empty result;
fewer groups than shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mergelight.llm.common import attach, heavy_keys
from mergelight.session import cut_lineage

SHARDS = 16
FIRST_BITS = 12
FINER_BITS = 6


@dataclass(frozen=True)
class Piece:
    """Groups whose key shifted right by ``shift`` is ``number``: their bytes, and how many."""

    number: int
    shift: int
    size: int
    largest: int
    groups: int

    @property
    def low(self) -> int:
        return self.number << self.shift


def whole_walk(pieces: list[Piece], capacity: int) -> list[int]:
    """Starts of shards of a greedy walk that cuts between pieces; a piece above the capacity is alone."""
    starts, held = [0], 0
    for i, piece in enumerate(pieces):
        if held and held + piece.size > capacity:
            starts.append(i)
            held = 0
        held += piece.size
    return starts


def loose_walk(pieces: list[Piece], capacity: int) -> list[int]:
    """The same if pieces of several groups can be cut anywhere: no real walk needs fewer shards.

    Pieces of several groups must hold none above the capacity.
    """
    starts, held = [0], 0
    for i, piece in enumerate(pieces):
        left = piece.size
        if piece.groups == 1:
            if held and held + left > capacity:
                starts.append(i)
                held = 0
            held += left
            continue
        while held + left > capacity:
            left -= min(left, max(0, capacity - held))
            starts.append(i)
            held = 0
        held += left
    return starts


def least(feasible: Callable[[int], bool], low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if feasible(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(pieces: list[Piece], shards: int, finer: Callable[[list[Piece]], list[Piece]]) -> tuple[int, list[int]]:
    """Least capacity and the first key of each shard but the first; ``finer`` splits pieces."""
    if not pieces:
        return 0, []
    while True:
        total = sum(p.size for p in pieces)
        unsplit = [p for p in pieces if p.groups > 1]
        several = max((p.size for p in unsplit), default=0)
        low = max((p.largest for p in unsplit), default=1)
        fits = least(lambda c: several <= c and len(whole_walk(pieces, c)) <= shards, 1, total)
        needed = least(lambda c: len(loose_walk(pieces, c)) <= shards, min(low, fits), fits)
        # below ``low`` a group would be a shard of its own, so pieces that hold such groups are split
        if not unsplit or needed == fits > low:
            return fits, [pieces[i].low for i in whole_walk(pieces, fits)[1:]]
        # a walk's cut j lies between those of the slowest and the fastest walk
        slow, fast = whole_walk(pieces, needed), loose_walk(pieces, fits)
        coarse: set[int] = set()
        for j in range(1, shards):
            a = slow[j] if j < len(slow) else len(pieces) - 1
            b = fast[j] if j < len(fast) else len(pieces) - 1
            coarse.update(range(max(0, min(a, b) - 1), max(a, b) + 1))
        coarse.update(i for i, p in enumerate(pieces) if p.size > needed)
        if needed == low:
            coarse.update(i for i, p in enumerate(pieces) if p.largest == low)
        split = [pieces[i] for i in coarse if pieces[i].groups > 1]
        if not split:  # what is left unsplit decides nothing
            return fits, [pieces[i].low for i in whole_walk(pieces, fits)[1:]]
        kept = [p for i, p in enumerate(pieces) if i not in coarse or p.groups == 1]
        pieces = sorted(kept + finer(split), key=lambda p: p.low)


def piece_sums(units: DataFrame, shift: int, inside: list[Piece] | None = None) -> list[Piece]:
    """Sums of the ranges of 2**shift keys, of all keys or of those inside some pieces of one shift."""
    if inside is not None:
        units = units.where(F.shiftright("key", inside[0].shift).isin([p.number for p in inside]))
    rows = units.groupBy(F.shiftright("key", shift).alias("number")).agg(
        F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("groups")
    )
    return sorted(
        (Piece(r.number, shift, r["size"], r.largest, r.groups) for r in rows.collect()), key=lambda p: p.low
    )


def finer_sums(units: DataFrame, pieces: list[Piece]) -> list[Piece]:
    out = []
    for shift in sorted({p.shift for p in pieces}):
        out += piece_sums(units, max(0, shift - FINER_BITS), [p for p in pieces if p.shift == shift])
    return out


def plan_shards(units: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Least capacity, and the first key of each shard after the first."""
    ends = units.agg(F.min("key"), F.max("key")).first()
    if ends[0] is None:
        return 0, []
    shift = max(0, (int(ends[1]) - int(ends[0])).bit_length() - FIRST_BITS)
    return minimax_cuts(piece_sums(units, shift), shards, lambda p: finer_sums(units, p))


def shard_of(key: Column, cuts: list[int]) -> Column:
    place = F.lit(0)
    for cut in cuts:
        place = place + (key >= cut).cast("int")
    return place.cast("int")


def numbered(rows: DataFrame, group: str, order: list[str], column: str) -> DataFrame:
    """Number the rows of each group from 0 in this order; ``group`` has few values, each with many rows."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    rows = cut_lineage(
        rows.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id())
    )
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("n"))  # parts + groups rows at most
    before = F.sum("n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy(group, "_part").orderBy(*order))
    return rows.join(F.broadcast(offsets), [group, "_part"]).withColumn(
        column, F.col("_before") + inner - 1
    ).drop("_part", "_before")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.sha2(text, 256).alias("digest"),
    )
    rows = cut_lineage(rows)
    least_id = rows.agg(F.min("doc_id")).first()[0] or 0
    groups = cut_lineage(rows.groupBy("digest").agg(
        F.min(F.coalesce("doc_id", F.lit(least_id))).alias("key"), F.sum("size").alias("size"),
        F.count("*").alias("n_rows"),
    ))
    units = cut_lineage(groups.groupBy("key").agg(F.sum("size").alias("size")))
    _, cuts = plan_shards(units, shards)
    placed = groups.select("digest", shard_of(F.col("key"), cuts).alias("shard"))
    rows = attach(rows, placed, "digest", heavy_keys(groups, "digest"))
    return numbered(rows, "shard", ["doc_id", "digest"], "slot").drop("digest")


def shard_table(docs: DataFrame) -> DataFrame:
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
