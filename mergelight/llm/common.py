"""Helpers shared by the text operators: Arrow slices, bitmaps of fixed size, skew-safe joins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock, Timer

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised kernel looks at; a longer text is one step.
SLICE_BYTES = 1 << 20
#: A key with more than 1/HEAVY_PARTS of all rows is heavy: there are fewer than HEAVY_PARTS.
HEAVY_PARTS = 1000
#: log2 of the bits of a filter bitmap: 4 MiB, whatever the size of the tables.
FILTER_BITS = 25


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(rows: DataFrame, base: str) -> str:
    """A column name that ``rows`` doesn't have."""
    taken = {c.lower() for c in rows.columns}
    while base in taken:
        base += "_"
    return base


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with at most ``size`` bytes of text (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finish for 64-bit hashes, so that all their bits can be used."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class IdleTables:
    """Tables of a worker, made on first use and kept from task to task.

    Spark reuses workers for other operators; tables that no task has used for ``seconds`` are
    dropped, so that a later stage has their memory.  Dropping changes no result.
    """

    def __init__(self, make: Callable, seconds: float = 1.0):
        self.make, self.seconds = make, seconds
        self.held: dict[tuple, object] = {}
        self.users, self.lock = 0, Lock()
        self.timer: Timer | None = None

    @contextmanager
    def use(self, *key):
        with self.lock:
            if self.timer:
                self.timer.cancel()
            if key not in self.held:
                self.held[key] = self.make(*key)
            found = self.held[key]
            self.users += 1
        try:
            yield found
        finally:
            with self.lock:
                self.users -= 1
                if not self.users:
                    self.timer = Timer(self.seconds, self._drop)
                    self.timer.daemon = True
                    self.timer.start()

    def _drop(self) -> None:
        with self.lock:
            if not self.users:
                self.held.clear()


def packed(values: np.ndarray) -> bytes:
    """The values deflated: of a table of fixed size, one partition leaves most at zero."""
    return zlib.compress(values.tobytes(), 1)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=kind)


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def bit_slots(hashes: np.ndarray, bits: int = FILTER_BITS, probes: int = 2) -> list[np.ndarray]:
    """The bit numbers that a key's 64-bit hash sets in a bitmap of 2**bits bits."""
    shift = np.uint64(64 - bits)
    x, out = hashes.astype(np.uint64), []
    for _ in range(probes):
        out.append((x >> shift).astype(np.int64))
        x = mixed(x)
    return out


def set_bits(bitmap: np.ndarray, hashes: np.ndarray, bits: int = FILTER_BITS, probes: int = 2) -> None:
    for slot in bit_slots(hashes, bits, probes):
        np.bitwise_or.at(bitmap, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))


def has_bits(bitmap: np.ndarray, hashes: np.ndarray, bits: int = FILTER_BITS, probes: int = 2) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for slot in bit_slots(hashes, bits, probes):
        found &= (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return found


def filter_bitmap(hashes: DataFrame, column: str, bits: int = FILTER_BITS, probes: int = 2) -> np.ndarray:
    """A bitmap of 2**bits bits over all values of a long column.

    Every partition fills its own bitmap, Spark ORs them by block, and the driver gets the
    blocks: 2**bits / 8 bytes at most, independent of the number of rows.
    """
    block = 1 << 13  # bytes

    def fill(batches):
        bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in batches:
            set_bits(bitmap, batch[column].to_numpy(zero_copy_only=False).view(np.uint64), bits, probes)
        parts = bitmap.reshape(-1, min(block, len(bitmap)))
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([packed(parts[i]) for i in used], pa.binary())],
            names=["block", "bits"],
        )

    def join(batches):
        """Blocks come sorted by number: OR the run of each."""
        now, held = None, None
        for batch in batches:
            for number, raw in zip(batch["block"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                part = unpacked(raw, np.uint8)
                if number != now:
                    if now is not None:
                        yield block_row(now, held)
                    now, held = number, part.copy()
                else:
                    held |= part
        if now is not None:
            yield block_row(now, held)

    def block_row(number, part):
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "bits"]
        )

    schema = "block int, bits binary"
    parts = hashes.select(column).where(F.col(column).isNotNull()).mapInArrow(fill, schema)
    parts = parts.repartition("block").sortWithinPartitions("block").mapInArrow(join, schema)
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in parts.collect():
        start = row.block * min(block, len(bitmap))
        bitmap[start : start + len(row.bits)] = np.frombuffer(row.bits, dtype=np.uint8)
    return bitmap


def heavy_keys(counted: DataFrame, key: str, rows: str = "n_rows") -> DataFrame:
    """Keys of a (key, row count) table that hold over 1/HEAVY_PARTS of all rows."""
    total = counted.agg(F.sum(rows)).first()[0] or 0
    return counted.where(F.col(rows) * HEAVY_PARTS > F.lit(total)).select(key)


def attach(rows: DataFrame, values: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Left-join ``values`` (one row per key, no null key) to ``rows``, however skewed they are.

    Values of heavy keys (fewer than HEAVY_PARTS rows, see ``heavy_keys``) are broadcast; rows
    that found one take a spread key that matches nothing, so no task gets a heavy key's rows.
    """
    names = [c for c in values.columns if c != key]
    few = values.join(F.broadcast(heavy), key, "left_semi")
    few = few.select(F.col(key), F.struct(*names).alias("_few"))
    rows = rows.join(F.broadcast(few), key, "left")
    spread = F.concat(F.lit("-"), F.xxhash64(*[c for c in rows.columns if c != "_few"]).cast("string"))
    rows = rows.withColumn("_key", F.when(F.col("_few").isNull(), F.col(key).cast("string")).otherwise(spread))
    rest = values.select(F.col(key).cast("string").alias("_key"), F.struct(*names).alias("_rest"))
    joined = rows.join(rest, "_key", "left")
    found = F.coalesce("_few", "_rest")
    return joined.select(
        *[c for c in rows.columns if c not in ("_few", "_key")], *[found[n].alias(n) for n in names]
    )


def hex_sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows that may never be learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def only_with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of (key, text) whose key may be among ``ids``: all that are, and few others.

    A bitmap of fixed size keeps other texts off the shuffle of the join that must follow.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(filter_bitmap(ids.select(F.xxhash64(key).alias("h")), "h"))

    def keep(batches):
        for batch in batches:
            hashes = batch["h"].to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(has_bits(bitmap.value, hashes)))
            yield pa.RecordBatch.from_arrays([batch[key], batch["text"]], names=[key, "text"])

    rows = docs.select(F.col(key).cast("long"), F.col("text").cast("string"), F.xxhash64(F.col(key).cast("long")).alias("h"))
    return rows.mapInArrow(keep, f"{key} long, text string")
