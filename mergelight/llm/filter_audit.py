"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failures are a mask, one bit a filter.  Documents are counted by part and mask first, so
all that follows works on at most 2**filters cells a part.  Masks and orders then meet in one
min-plus product: the mask matrix holds 0 where a mask fails a filter and a large number where it
passes, the position matrix is the inverse of each permutation (in which step an order applies a
filter), and

    removal[mask, order] = min over filters (mask_cost[mask, filter] + position[order, filter])

is the step at which documents of the mask go; a number beyond the last step means they stay.
Cell weights are scattered to (order, removal step) for what is removed, and to (order, step of
a failing filter) where that step comes after the removal for what is redundant.

Whether a text repeats that of a smaller id is found table-wide: digests with the least id of each
are joined back, those of frequent texts by broadcast (see ``attach``), so that no task gets all
copies of a text.  Texts are read once and never shuffled.

Defined results: a null text is empty, and equal to empty ones; a null part is the empty string; a
null id is less than all others and has no labels; repeated rows (and rows that share an id) count
once each and none of them repeats another of the same id; a label is 1 if any row of that id in
``labels`` says so; an empty table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelight.llm.common import attach, heavy_keys
from mergelight.session import cut_lineage

MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SIGNS = "[#$%&*|]"
FILTERS = "ABCDE"
SPACE = " \t\n\x0b\x0c\r"
#: Parts that one step of the scatter looks at.
PARTS_AT_ONCE = 256
_NO_ID = -(1 << 63)


def text_failures(text: Column) -> list[Column]:
    """Failures that a text alone decides: few words, few distinct ones, many capitals, odd signs."""
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n_words = F.when(trimmed == "", 0).otherwise(F.size(words))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n_words < MIN_WORDS,
        100 * distinct.cast("long") < MIN_DISTINCT_PERCENT * n_words.cast("long"),
        100 * capitals.cast("long") > MAX_CAPITALS_PERCENT * F.length(text).cast("long"),
        text.rlike(SIGNS),
    ]


def as_mask(failures: list[Column]) -> Column:
    """Failures as bits, the first filter's lowest."""
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)]
    return sum(bits[1:], bits[0]).cast("int")


def document_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """(id, part, mask) of every row; the last bit says that a smaller id has the same text."""
    text = F.coalesce(F.make_valid_utf8(F.col("text").cast("string")), F.lit(""))
    rows = cut_lineage(docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"), as_mask(text_failures(text)).alias("mask"),
    ))
    firsts = cut_lineage(rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n_rows")))
    known = attach(rows, firsts.where("n_rows > 1").select("digest", "least"), "digest", heavy_keys(firsts, "digest"))
    again = F.when(F.col("id") > F.col("least"), 1 << 4).otherwise(0)
    return known.select("id", "part", (F.col("mask") + again).cast("int").alias("mask"))


def labelled_masks(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Masks with ``good`` and ``toxic``, 1 where a label says so."""
    kinds = {"good": "quality", "toxic": "toxic"}
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for name, c in kinds.items()]
    )
    without_id = masks.where(F.col("id") == _NO_ID).select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    found = masks.where(F.col("id") != _NO_ID).join(known, "id", "left")
    return found.select(
        "id", "part", "mask", *[F.coalesce(name, F.lit(0)).alias(name) for name in kinds]
    ).unionByName(without_id)


def position_matrix(names: str) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and the step (from 1) at which each order applies each filter."""
    orders = sorted(permutations(range(len(names))))
    return ["".join(names[f] for f in o) for o in orders], np.argsort(np.array(orders), axis=1) + 1


def removal_steps(fails: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Min-plus product of masks (rows, filters) and positions (orders, filters): (masks, orders)."""
    never = positions.shape[1] + 1
    cost = np.where(fails, 0, never)
    return np.minimum((cost[:, None, :] + positions[None, :, :]).min(axis=2), never)


def audit_cells(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, counts) of every order from (part, mask, n, good, toxic) cells.

    A part has at most 2**filters cells, which is what a row of the grouped table holds.
    """
    orders, positions = position_matrix(names)
    size, n_orders = len(names), len(orders)
    fails = (np.arange(1 << size)[:, None] >> np.arange(size) & 1).astype(bool)
    removal = removal_steps(fails, positions)
    at_step = np.argsort(positions, axis=1)  # filter of each step
    order_names = pa.array(np.repeat(orders, size))
    steps = np.tile(np.arange(1, size + 1, dtype=np.int32), n_orders)

    def scatter(part: np.ndarray, steps_of: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
        """Sums of weights by (part, order, step); rows of ``steps_of`` are the cells' steps, 0 is none."""
        place = (part[:, None] * n_orders + np.arange(n_orders)) * (size + 2) + steps_of
        sums = np.bincount(place.ravel(), np.repeat(weight, n_orders), parts * n_orders * (size + 2))
        return np.rint(sums).astype(np.int64).reshape(parts, n_orders, size + 2)[:, :, 1 : size + 1]

    def audited(part: np.ndarray, mask: np.ndarray, weights: dict[str, np.ndarray], parts: int) -> dict:
        gone = {k: scatter(part, removal[mask], w, parts) for k, w in weights.items()}
        n = weights["n"]
        total = np.bincount(part, n, parts).astype(np.int64)
        late = np.zeros_like(gone["n"])
        by_filter = np.zeros((2, parts, size), dtype=np.int64)
        for f in range(size):
            failing = fails[mask, f]
            step = np.where(positions[:, f] > removal[mask[failing]], positions[:, f], 0)
            late += scatter(part[failing], step, n[failing], parts)
            alone = failing & (fails[mask].sum(axis=1) == 1)
            by_filter[0, :, f] = np.bincount(part[alone], n[alone], parts)
            by_filter[1, :, f] = gone["n"][:, np.arange(n_orders), positions[:, f] - 1].sum(axis=1)
        return {
            "kept": total[:, None, None] - np.cumsum(gone["n"], axis=2), "removed": gone["n"], "redundant": late,
            "unique_fails": by_filter[0][:, at_step], "good_lost": gone["good"], "toxic_lost": gone["toxic"],
            "shapley": by_filter[1][:, at_step],
        }

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, PARTS_AT_ONCE):
                batch = whole.slice(low, PARTS_AT_ONCE)
                part = np.repeat(np.arange(batch.num_rows), batch["cells"].value_lengths().to_numpy(zero_copy_only=False))
                cell = dict(zip(("mask", "n", "good", "toxic"), batch["cells"].flatten().flatten(), strict=True))
                cell = {k: v.to_numpy(zero_copy_only=False) for k, v in cell.items()}
                mask = cell.pop("mask")
                counts = audited(part, mask, cell, batch.num_rows)
                for row, name in enumerate(batch["part"].to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(steps), pa.string()), order_names, pa.array(steps),
                         *[pa.array(c[row].ravel()) for c in counts.values()]],
                        names=["part", "filter_order", "step", *counts],
                    )

    grouped = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return grouped.mapInArrow(
        run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
             "good_lost long, toxic_lost long, shapley long",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Counts of every order of the five filters, step by step, for each value of ``part``."""
    rows = labelled_masks(document_masks(docs, part), labels)
    cells = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )
    return audit_cells(cells)
