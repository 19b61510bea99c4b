"""N-gram Jaccard join with a token-group matrix.

A document's set holds the hashes of its distinct ``width``-word shingles.  Two documents link if
their sets have a Jaccard similarity of ``num / den`` or more; the result is the component of each.

1. Documents with equal sets are one class, held by its least id.
2. A set's *head* are its first tokens in one order of all tokens, rare ones first, so many that
   two sets that link share ``1 + EXTRA`` of them (or all that a small set can).  Rarity comes from
   counts of all documents' tokens in ``2**COUNT_BITS`` slots: of fixed size, and only the order
   depends on it, not the result.
3. Groups of similar documents: every token's leader is the most central class that has it, whose
   head is shared with most others; classes that share enough of their head with a leader are
   compared with it, and verified links are joined to components.  These are the groups.  No
   pairs within a group are listed.
4. The matrix has a row for each (token, size band, group): the union of the heads of a group's
   members.  Only tokens of several groups matter.  A document meets the groups other than its
   own on its head's tokens; the number of tokens met bounds what it can share with any member,
   and only groups that reach the bound are opened: the document is compared with its members.
5. Verified links join groups.

An opened group's members lie in blocks of ``BLOCK``; the documents that ask stream past each
block, which counts the tokens shared with all its members at once and stops at the first link.
Blocks that very many documents ask are repeated.

Whole sets are only built for documents that are compared (found by a bitmap of fixed size, then
exactly).  Defined results: null or empty texts, or texts of white space, have no shingles and
their own component; a text of fewer words than ``width`` has one shingle; rows that share an id
are one document to links (a link of one is a link of all) and have a row each; repeated rows
are repeated; a null id counts as the least long and comes out as null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mergelight.llm.common import attach, filter_bitmap, has_bits, heavy_keys, packed, text_slices, unpacked
from mergelight.llm.components import components
from mergelight.llm.words import NON_SPACE, gram_hashes, words_of
from mergelight.session import cut_lineage

WIDTH = 5
NUM, DEN = 75, 100
EXTRA = 2
COUNT_BITS = 18
BLOCK = 256
ASKS = 2048
_CHUNK = 1 << 12
NO_ID = -(1 << 63)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = words_of(texts, NON_SPACE)
    hashes = words.hashes()
    grams = gram_hashes(hashes, width)
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def least_shared(n, num: int = NUM, den: int = DEN):
    """Tokens that a set of n tokens shares at least with any partner."""
    return -(-num * n // den)


def slot_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def head_of(tokens: np.ndarray, counts: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    n = len(tokens)
    size = min(n, n - int(least_shared(n, num, den)) + 1 + EXTRA)
    return tokens[np.lexsort((tokens, counts[slot_of(tokens)]))[:size]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text")
    )


def digests_and_counts(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, digest) of every row, and how often each slot's tokens occur, in one pass."""

    def scan(batches):
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part["text"], width)
                sizes = [len(s) for s in sets]
                total += np.bincount(slot_of(np.concatenate(sets)), minlength=len(total)) if any(sizes) else 0
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()),
                     pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())],
                    names=names,
                )
        chunks = total.reshape(-1, _CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int32()), pa.nulls(len(used), pa.binary()),
             pa.array(used.astype(np.int32)), pa.array([packed(chunks[i]) for i in used], pa.binary())],
            names=names,
        )

    def add(batches):
        """Sum the counts of each chunk; rows come sorted by chunk."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, raw in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                held[number] = held.get(number, 0) + unpacked(raw, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
            names=["chunk", "counts"],
        )

    names = ["id", "n", "digest", "chunk", "counts"]
    rows = cut_lineage(_texts(docs).mapInArrow(scan, "id long, n int, digest binary, chunk int, counts binary"))
    parts = rows.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for row in parts.mapInArrow(add, "chunk int, counts binary").collect():  # 2**COUNT_BITS numbers at most
        counts[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row["counts"], dtype=np.int64)
    return rows.where("chunk is null").select("id", "n", "digest"), counts


def shared_heads(docs: DataFrame, counts: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """(token, rep, n, classes) of each class's head tokens that another class has too."""
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def scan(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part["text"], width)
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                heads = [head_of(s, held.value, num, den).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.binary()),
                     pa.array(heads, pa.list_(pa.int64()))],
                    names=["id", "n", "digest", "head"],
                )

    rows = _texts(docs).mapInArrow(scan, "id long, n int, digest binary, head array<long>").where("n > 0")
    classes = rows.groupBy("digest", "n").agg(F.min("id").alias("rep"), F.first("head").alias("head"))
    tokens = classes.select(F.explode("head").alias("token"), "rep", "n")
    seen = tokens.withColumn("classes", F.count("*").over(W.partitionBy("token")))
    return cut_lineage(seen.where("classes > 1"))


def linked(asks: DataFrame, members: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of asking documents b with members a of the groups asked, one a block at most.

    ``asks`` has distinct (b, group) and ``members`` distinct (a, group).
    """
    asks, members = cut_lineage(asks), cut_lineage(members)
    ids = asks.select(F.col("b").alias("id")).union(members.select(F.col("a").alias("id"))).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(filter_bitmap(ids.select(F.xxhash64("id").alias("h")), "h"))

    def build(batches):
        for batch in batches:
            hashes = batch["h"].to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(has_bits(bitmap.value, hashes)))
            for part in text_slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(part["text"], width)]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(sets, pa.binary())], names=["id", "tokens"])

    sets = _texts(docs).select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(build, "id long, tokens binary")
    sets = sets.join(ids, "id", "left_semi")
    asked = asks.groupBy("group").agg(F.count("*").alias("n_rows"))
    held = members.groupBy("group").agg(F.count("*").alias("n_members"))
    shape = cut_lineage(asked.join(held, "group").select(
        "group", "n_rows", "n_members", F.ceil(F.col("n_members") / BLOCK).alias("blocks"),
        F.ceil(F.col("n_rows") / ASKS).alias("repeats"),
    ))
    sizes = shape.select("group", "blocks", "repeats")
    own_repeat = F.pmod(F.xxhash64("b"), F.col("repeats"))
    asks = attach(asks, sizes, "group", heavy_keys(shape, "group")).where("blocks is not null").select(
        F.col("b").alias("id"), "group", own_repeat.alias("repeat"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(True).alias("asks"),
    )
    own_block = F.pmod(F.xxhash64("a"), F.col("blocks"))
    members = attach(members, sizes, "group", heavy_keys(shape, "group", "n_members")).where("blocks is not null").select(
        F.col("a").alias("id"), "group", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("repeat"), own_block.alias("block"),
        F.lit(False).alias("asks"),
    )
    rows = asks.unionByName(members).join(sets, "id")
    rows = rows.repartition("group", "block", "repeat").sortWithinPartitions("group", "block", "repeat", "asks", "id")
    return rows.select("group", "block", "repeat", "asks", "id", "tokens").mapInArrow(
        lambda batches: _compare(batches, num, den), "a long, b long"
    )


def _compare(batches, num: int, den: int):
    """Members of a block come first, then the documents that ask; rows are sorted so."""
    key, held, block = None, [], None
    for batch in batches:
        a_out, b_out = [], []
        columns = (batch[c].to_pylist() for c in ("group", "block", "repeat", "asks", "id", "tokens"))
        for *now, asks, ident, raw in zip(*columns, strict=True):
            tokens = np.frombuffer(raw, dtype=np.uint64)
            if now != key:
                key, held, block = now, [], None
            if not asks:
                held.append((ident, tokens))
                continue
            if block is None:
                block = Block(held)
            partner = block.first_link(tokens, num, den, ident)
            if partner is not None:
                a_out.append(partner)
                b_out.append(ident)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


class Block:
    """Sets of some documents, their tokens sorted with their owners."""

    def __init__(self, sets: list[tuple[int, np.ndarray]]):
        self.ids = [ident for ident, _ in sets]
        self.sizes = np.array([len(t) for _, t in sets], dtype=np.int64)
        tokens = np.concatenate([t for _, t in sets]) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owners = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        """How many of these distinct tokens each set has."""
        low, high = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        many = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        return np.bincount(self.owners[at], minlength=len(self.ids))

    def first_link(self, tokens: np.ndarray, num: int, den: int, ident: int) -> int | None:
        if not len(tokens) or not self.ids:
            return None
        shared = self.shared(tokens)
        good = (shared > 0) & (den * shared >= num * (len(tokens) + self.sizes - shared))
        return next((self.ids[i] for i in np.flatnonzero(good) if self.ids[i] != ident), None)


def _fits(n: str, m: str, num: int, den: int):
    """Sets of these sizes can be similar enough."""
    low, high = F.least(n, m), F.greatest(n, m)
    return den * low.cast("long") >= num * high.cast("long")


def _bound(num: int, den: int):
    """Head tokens that a set of n tokens shares at least with any partner."""
    return F.least(F.lit(1 + EXTRA), F.ceil(F.col("n") * num / den))


def _size_bound(num: int, den: int):
    """The same, knowing the sizes m of partners: from ``least_n`` to ``most_n``.

    Let c be the tokens that both heads hold.  Of the set whose head ends first in the order, only
    what lies behind its head can be shared besides, so the two share c + the larger rest at most,
    and must share num / (num + den) of n + m.  What c must reach is least at either end of the
    sizes that fit; 1 allows for rounding.
    """

    def rest(x):
        return F.greatest(F.lit(0), F.ceil(num * x / den) - 1 - EXTRA)

    def needed(m):
        return F.ceil(num * (F.col("n") + m) / (num + den)) - F.greatest(rest(F.col("n")), rest(m))

    low = F.greatest("least_n", F.ceil(num * F.col("n") / den))
    high = F.least("most_n", F.floor(den * F.col("n") / num))
    return F.least(needed(low), needed(high)) - 1


def leader_links(heads: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between classes and leaders of their tokens that the bound doesn't rule out."""
    central = heads.groupBy("rep").agg((F.sum("classes") / F.first("n")).alias("weight"))
    rows = heads.join(central, "rep")
    lead = F.first(F.struct("rep", "n")).over(W.partitionBy("token").orderBy(F.desc("weight"), "rep"))
    tries = rows.select("token", "rep", "n", lead.alias("lead")).where("rep <> lead.rep")
    tries = tries.where(_fits("n", "lead.n", num, den)).groupBy("rep", F.col("lead.rep").alias("leader")).agg(
        F.count("*").alias("met"), F.first("n").alias("n")
    )
    tries = tries.where(F.col("met") >= _bound(num, den))
    asks = cut_lineage(tries.select(F.col("rep").alias("b"), F.col("leader").alias("group")))
    members = asks.select(F.col("group").alias("a"), "group").distinct()
    return linked(asks, members, docs, width, num, den)


def open_groups(heads: DataFrame, groups: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(b, group) that the bound doesn't rule out, and (a, group) of the members of these groups."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))).cast("int")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    groups = attach(groups, sizes, "component", heavy_keys(sizes, "component", "members"))
    rows = heads.select("token", "rep", "n").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    rows = rows.withColumns({"component": F.coalesce("component", "rep"), "band": band})
    rows = rows.withColumn("members", F.coalesce("members", F.lit(1)))
    of = W.partitionBy("token")
    several = rows.withColumns({"lo": F.min("component").over(of), "hi": F.max("component").over(of)})
    several = several.where("lo <> hi").drop("lo", "hi")
    several = cut_lineage(several.withColumn("held", F.count("*").over(W.partitionBy("rep"))))
    matrix = several.groupBy("token", "band", F.col("component").alias("group")).agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.first("members").alias("group_members"),
        F.max("held").alias("group_held"),
    )
    bands = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    asks = several.select("token", "rep", "n", "component", "members", "held", bands.alias("band"))
    fits = (den * F.col("most_n").cast("long") >= num * F.col("n").cast("long")) & (
        den * F.col("n").cast("long") >= num * F.col("least_n").cast("long"))
    # the smaller group's documents ask the larger group
    met = asks.join(matrix, ["token", "band"]).where(
        "members < group_members or (members = group_members and component < group)"
    ).where(fits)
    # neither side can share more tokens than it holds
    met = met.where(F.least("held", "group_held") >= _size_bound(num, den))
    met = met.groupBy("rep", "group").agg(
        F.count("*").alias("met"), F.first("n").alias("n"), F.min("least_n").alias("least_n"),
        F.max("most_n").alias("most_n"),
    )
    asks = cut_lineage(met.where(F.col("met") >= F.greatest(_bound(num, den), _size_bound(num, den))).select(F.col("rep").alias("b"), "group"))
    # every possible partner of an asking document has one of the tokens of several groups
    members = several.select(F.col("rep").alias("a"), F.col("component").alias("group")).distinct()
    return asks, members.join(asks.select("group").distinct(), "group", "left_semi")


def jaccard_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, counts = digests_and_counts(docs, width)
    classes = cut_lineage(
        rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n_rows"))
    )
    heads = shared_heads(docs, counts, width, num, den)
    links = leader_links(heads, docs, width, num, den)
    placed = attach(rows, classes.select("digest", "rep"), "digest", heavy_keys(classes, "digest"))
    placed = cut_lineage(placed.select("id", "n", F.coalesce("rep", "id").alias("rep")))
    shared_ids = placed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    groups = components(links.union(shared_ids.select("a", "b")))
    asks, members = open_groups(heads, groups, num, den)
    found = cut_lineage(linked(asks, members, docs, width, num, den))
    if found.first() is not None:
        of = groups.select("id", "component")
        ends = found.join(of.withColumnsRenamed({"id": "a", "component": "ca"}), "a", "left")
        ends = ends.join(of.withColumnsRenamed({"id": "b", "component": "cb"}), "b", "left")
        joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        more = joined.select(F.col("id").alias("component"), F.col("component").alias("joined"))
        groups = groups.join(more, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
        alone = joined.join(groups.select("id"), "id", "left_anti")
        groups = cut_lineage(groups.unionByName(alone))
    sizes = placed.groupBy("rep").agg(F.count("*").alias("n_rows"))
    named = groups.withColumnRenamed("id", "rep")
    out = attach(placed, named, "rep", heavy_keys(sizes, "rep"))
    component = F.coalesce("component", "rep")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.when(component != NO_ID, component).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the rows with its least id, with all columns; equal rows of it once."""
    keep = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_keep")
    ).distinct()
    mine = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    return docs.join(keep, mine == keep["_keep"], "left_semi")
