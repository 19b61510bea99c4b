"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of an item; an item of fewer words (but not none) is one
window of its own length.  Of every window the rightmost run of ``gram`` words with the least hash is
selected; neighbouring windows mostly select the same one, so a text has about two records in
``length - gram + 2`` words.  Documents and items select by the same rule, so a window that they share
selects the same run in both, and every span of ``length`` words or more is found.

Selected runs of both sides are joined by their fingerprint (hash and window length).  A hit is
extended to the left and to the right, word by word, as far as a window can reach, and counts if the
words that agree make a window; then all of them are hit.

A bitmap of fixed size over the items' fingerprints keeps other document runs off the shuffle.
It lets a few more through, never fewer, and the join is exact, at any size of the benchmark.
Fingerprints with more than 1/1000 of all document runs (fewer than 1000) are dealt to as many tasks
as a shuffle has, and their item runs go to all of these.

Defined results: a null or empty text has no words and is never contaminated; repeated rows
(same id and text) give one row; rows that share an id but not the text give one row each; a
null id is an id like any other; an item without words finds nothing, an item without id marks
words but is not listed; an empty benchmark contaminates nothing; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelight.llm.common import (
    FILTER_BITS,
    as_long,
    filter_bitmap,
    has_bits,
    heavy_keys,
    hex_sha256,
    mixed,
    text_slices,
)
from mergelight.llm.words import Words, gram_hashes, words_of
from mergelight.session import cut_lineage

LENGTH = 13
GRAM = 5


def selected_runs(hashes: np.ndarray, text_of: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the selected runs of all windows within a text, and their fingerprints.

    A run is selected if enough neighbours, larger to the right and not smaller to the left, make
    a window with it.
    """
    k = min(gram, length)
    width = length - k + 1  # runs in a window
    runs = gram_hashes(hashes, k)
    if not len(runs):
        return np.zeros(0, np.int64), runs
    of = text_of[: len(runs)]
    whole = of == text_of[k - 1 :]
    room = whole.astype(np.int64)
    for side in (-1, 1):
        alive = whole.copy()
        for step in range(1, width):
            here = slice(step, None) if side < 0 else slice(None, -step)
            there = slice(None, -step) if side < 0 else slice(step, None)
            more = np.zeros(len(runs), dtype=bool)
            larger = runs[there] >= runs[here] if side < 0 else runs[there] > runs[here]
            more[here] = larger & whole[there] & (of[there] == of[here])
            alive &= more
            room += alive
    at = np.flatnonzero(whole & (room >= width))
    return at, mixed(runs[at] + np.uint64(length))


def context(words: Words, row: int, at: int, length: int, gram: int) -> tuple[list[str], str, list[str]]:
    """Words before a run (the nearest first), the run, and words after it, as far as windows reach."""
    k = min(gram, length)
    low = max(int(words.first[row]), at - (length - k))
    high = min(int(words.first[row + 1]), at + length)
    single = [words.joined(i, 1) for i in range(low, high)]
    return single[: at - low][::-1], " ".join(single[at - low : at - low + k]), single[at - low + k :]


_RUN = "print long, n int, before array<string>, run string, after array<string>"
_RUN_FIELDS = [("print", pa.int64()), ("n", pa.int32()), ("before", pa.list_(pa.string())), ("run", pa.string()),
               ("after", pa.list_(pa.string()))]


def item_runs(items: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Distinct selected runs of all items, with their context and item."""

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                words = words_of(part["text"])
                hashes = words.hashes()
                found: list[tuple] = []
                for row, item in enumerate(part["item_id"].to_pylist()):
                    a, b = int(words.first[row]), int(words.first[row + 1])
                    n = min(length, b - a)
                    if n == 0:
                        continue
                    at, prints = selected_runs(hashes[a:b], np.zeros(b - a, np.int64), n, gram)
                    found += [(p, n, *context(words, row, a + i, n, gram), item)
                              for i, p in zip(at.tolist(), as_long(prints).tolist(), strict=True)]
                kinds = [*(kind for _, kind in _RUN_FIELDS), pa.int64()]
                columns = zip(*found, strict=True) if found else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                    names=[*(name for name, _ in _RUN_FIELDS), "item_id"],
                )

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, f"{_RUN}, item_id long").distinct()


def document_runs(docs: DataFrame, bitmap, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """One row per document row, with the selected runs whose fingerprint passes the bitmap."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([*_RUN_FIELDS, ("at", pa.int32())]))

    def scan(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                words = words_of(part["text"])
                hashes, text_of = words.hashes(), words.text_of()
                found: list[list] = [[] for _ in range(part.num_rows)]
                for n in lengths:
                    at, prints = selected_runs(hashes, text_of, n, gram)
                    passing = has_bits(bits.value, prints)
                    for p, mark in zip(at[passing].tolist(), as_long(prints[passing]).tolist(), strict=True):
                        row = int(text_of[p])
                        before, run, after = context(words, row, p, n, gram)
                        found[row].append({"print": mark, "n": n, "before": before, "run": run, "after": after,
                                           "at": p - int(words.first[row])})
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_hash"], pa.array(words.counts().astype(np.int64)), pa.array(found, kind)],
                    names=["doc_id", "text_hash", "n_words", "runs"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash")
    )
    schema = ("doc_id long, text_hash long, n_words long, runs array<struct<print:long,n:int,before:array<string>,"
              "run:string,after:array<string>,at:int>>")
    return rows.mapInArrow(scan, schema)


def agreeing(mine: list[str], theirs: list[str]) -> int:
    """Words that agree from the start of two lists."""
    for i, (a, b) in enumerate(zip(mine, theirs, strict=False)):
        if a != b:
            return i
    return min(len(mine), len(theirs))


def _extended(batches, gram: int):
    """(doc_id, text_hash, item_id, a, b) of hits whose words agree over a window: words a to b."""
    names = ["n", "run", "before", "after", "item_run", "item_before", "item_after", "at"]
    for batch in batches:
        keep, starts, ends = [], [], []
        for row, (n, run, before, after, i_run, i_before, i_after, at) in enumerate(
            zip(*(batch[c].to_pylist() for c in names), strict=True)
        ):
            if run == i_run:
                k = min(gram, n)
                left, right = agreeing(before, i_before), agreeing(after, i_after)
                if left + k + right >= n:
                    keep.append(row)
                    starts.append(at - left)
                    ends.append(at + k + right)
        taken = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [taken["doc_id"], taken["text_hash"], taken["item_id"], pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            names=["doc_id", "text_hash", "item_id", "a", "b"],
        )


def hit_spans(seen: DataFrame, known: DataFrame, gram: int = GRAM) -> DataFrame:
    """Extended hits of document runs (rows of ``document_runs``) with item runs."""
    spark = seen.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = cut_lineage(seen.select("doc_id", "text_hash", F.explode("runs").alias("r")).select("doc_id", "text_hash", "r.*"))
    heavy = heavy_keys(runs.groupBy("print").agg(F.count("*").alias("n_rows")), "print")
    heavy = F.broadcast(heavy.withColumn("repeats", F.lit(parts)))
    own = F.pmod(F.xxhash64("doc_id", "text_hash", "at"), F.coalesce("repeats", F.lit(1))).cast("int")
    runs = runs.join(heavy, "print", "left").withColumn("salt", own).drop("repeats")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("repeats", F.lit(1)) - 1)).alias("salt")
    items = known.join(heavy, "print", "left").select(
        "print", "n", "item_id", F.col("before").alias("item_before"), F.col("run").alias("item_run"),
        F.col("after").alias("item_after"), copies,
    )
    met = runs.join(items, ["print", "n", "salt"]).select(
        "doc_id", "text_hash", "item_id", "n", "at", "before", "run", "after", "item_before", "item_run", "item_after"
    )
    return met.mapInArrow(lambda batches: _extended(batches, gram), "doc_id long, text_hash long, item_id long, a long, b long")


def contamination(
    docs: DataFrame, items: DataFrame, length: int = LENGTH, gram: int = GRAM, share: int = 20
) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids, contaminated) per document row.

    Contaminated: some word is hit, and ``share`` times the hit words are all words or more.
    """
    known = cut_lineage(item_runs(items, length, gram))
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # 1 .. length
    bitmap = filter_bitmap(known, "print") if lengths else np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    seen = cut_lineage(document_runs(docs, bitmap, lengths, gram))
    span = F.struct("a", "b")
    hits = hit_spans(seen, known, gram).select(
        "doc_id", "text_hash", F.lit(0).cast("long").alias("n_words"), "item_id", span.alias("span")
    )
    rows = seen.select(
        "doc_id", "text_hash", "n_words", F.lit(None).cast("long").alias("item_id"),
        F.lit(None).cast("struct<a:long,b:long>").alias("span"),
    )
    per_doc = rows.unionByName(hits).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.collect_set("item_id").alias("item_ids"), F.collect_set("span").alias("spans")
    )
    covered = F.expr("""
        aggregate(
            array_sort(spans), struct(0L as n, 0L as e),
            (t, x) -> struct(t.n + greatest(0L, x.b - greatest(t.e, x.a)) as n, greatest(t.e, x.b) as e),
            t -> t.n)
    """)
    out = per_doc.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), "item_ids")
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", bad)


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    listed = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        hex_sha256(listed).alias("items_sha256"), "contaminated",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All rows of ``docs`` but the contaminated ones, with all their columns.

    Only the contaminated ids travel; ids and text hashes are compared null-safely.
    """
    bad = contamination(docs, items).where("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")
    )
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"])
    return docs.join(bad, same, "left_anti")
