"""URL filter by a Bloom filter cascade.

A rule is a host and the start of a path, ``example.org/es/``; it fits that host, its subdomains
and every path that starts so.  A url can only fit rules whose key is one of its host's suffixes
plus one of its path's prefixes of a length that some rule has: its *candidates*.  All candidates
of all urls are the key universe.

Level 0 of the cascade holds the listed keys.  Level 1 holds the other keys of the universe that
level 0 lets through, level 2 the listed keys that level 1 lets through, and so on until none
is left over.  A key of the universe is listed exactly if the first level that rejects it has an
odd number (or none rejects it and the number of levels is odd).  So verdicts need no join with
the rules, and none is wrong: the build walks over the complete universe.

Bitmaps have ``bits`` bits each (4 MiB by default, whatever the number of rules); only keys that
pass level 0 are kept for the levels above.  ``shards`` splits the keys by hash into independent
cascades, one pass of the urls each, for rule lists that a single bitmap can't hold; a cascade
that doesn't narrow down raises an error that says so.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; a
null rule host or path is no rule; a rule given twice counts once, and if it is given with both
verdicts, ``block`` holds; a url that no rule fits is allowed (it isn't listed); repeated rows
stay repeated; no rules or no pages give what they must; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelight.llm.common import FILTER_BITS, filter_bitmap, has_bits
from mergelight.session import cut_lineage

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UNLISTED = "allow"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both are empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({
        "host": F.coalesce(lower_ascii(host), F.lit("")),
        "path": F.coalesce(path, F.lit("")),
    })


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys of all rules that could fit: host suffixes, each with path prefixes of these lengths."""
    parts = F.split(host, r"\.")
    last = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, i, last), "."))
    starts = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]),
        lambda x: x.isNotNull(),
    )
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


@dataclass
class Cascade:
    """Levels of bitmaps; salted by level so that their errors are independent."""

    levels: list[np.ndarray]
    bits: int

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.levels) % 2 == 1)
        open_ = np.ones(len(hashes), dtype=bool)
        for number, level in enumerate(self.levels):
            passed = has_bits(level, salted(hashes, number), self.bits)
            out[open_ & ~passed] = number % 2 == 1
            open_ &= passed
        return out


def salted(hashes: np.ndarray, level: int) -> np.ndarray:
    x = (hashes.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _salted_column(rows: DataFrame, level: int) -> DataFrame:
    def salt(batches):
        for batch in batches:
            values = salted(batch["key_hash"].to_numpy(zero_copy_only=False), level)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["h"])

    return rows.select("key_hash").mapInArrow(salt, "h long")


def build_cascade(universe: DataFrame, listed: DataFrame, bits: int = FILTER_BITS, most_levels: int = 40) -> Cascade:
    """Cascade over distinct (key, key_hash) ``universe``, true for keys of distinct ``listed``.

    Keys are told apart by name while building, so two keys of one hash that differ in being
    listed can't be held apart; then the cascade can't end and an error says so.
    """
    levels = [filter_bitmap(_salted_column(listed, 0), "h", bits)]
    level0 = universe.sparkSession.sparkContext.broadcast(levels[0])

    def passing(batches):
        for batch in batches:
            keep = has_bits(level0.value, salted(batch["key_hash"].to_numpy(zero_copy_only=False), 0), bits)
            yield batch.filter(pa.array(keep))

    passed = universe.mapInArrow(passing, "key string, key_hash long").distinct()
    marks = listed.select("key", F.lit(True).alias("is_listed"))
    left = cut_lineage(passed.join(marks, "key", "left").fillna(False, ["is_listed"]))
    before = None
    while True:
        level = len(levels)
        # odd levels hold unlisted keys that passed so far, even ones the listed keys
        wrong = left.where(F.col("is_listed") == F.lit(level % 2 == 0))
        count = wrong.count()
        if count == 0:
            return Cascade(levels, bits)
        if level >= most_levels or (before is not None and level > 4 and count >= before):
            raise ValueError(f"level {level} keeps {count} keys of {before}: use more bits or shards")
        before = count
        levels.append(filter_bitmap(_salted_column(wrong, level), "h", bits))
        now = universe.sparkSession.sparkContext.broadcast(levels[-1])
        left = cut_lineage(_keep_passing(left, now, level, bits, held=level % 2 == 0))


def _keep_passing(left: DataFrame, bitmap, level: int, bits: int, held: bool) -> DataFrame:
    """Keys still undecided after a level: those it holds, and the others that it lets through."""

    def keep(batches):
        for batch in batches:
            hashes = salted(batch["key_hash"].to_numpy(zero_copy_only=False), level)
            mine = batch["is_listed"].to_numpy(zero_copy_only=False) == held
            yield batch.filter(pa.array(mine | has_bits(bitmap.value, hashes, bits)))

    return left.mapInArrow(keep, "key string, key_hash long, is_listed boolean")


def flag_listed(rows: DataFrame, cascade: Cascade, keys: str, flags: str) -> DataFrame:
    """Add an array of booleans: which of the row's ``keys`` are listed."""
    held = rows.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("array<boolean>")
    def listed(column):
        sizes = column.map(len).to_numpy()
        flat = np.concatenate(column.to_numpy()) if sizes.sum() else np.zeros(0, dtype=np.int64)
        found = held.value.listed(flat.astype(np.int64))
        cuts = np.cumsum(sizes)[:-1]
        return column.__class__(np.split(found, cuts), index=column.index)

    hashes = F.transform(keys, lambda k: F.xxhash64(k))
    return rows.withColumn(flags, listed(hashes))


def _keys_of_shard(number: int, shards: int) -> Column:
    return F.filter("_keys", lambda k: F.pmod(F.hash(k), F.lit(shards)) == number)


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", bits: int = FILTER_BITS, shards: int = 1
) -> DataFrame:
    """``pages`` with host, path, rule and verdict: the longest rule that fits, else UNLISTED.

    Among rules of one length the one with the longer host wins.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat(lower_ascii(F.col("host")), "path").alias("key"), F.length("path").alias("n"), "verdict"
    ).groupBy("key").agg(F.max("n").alias("n"), F.max("verdict").alias("verdict"))
    rules = cut_lineage(rules.withColumn("key_hash", F.xxhash64("key")))
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())  # lengths of path prefixes
    judged = with_host_path(pages, url).withColumn("_keys", candidates(F.col("host"), F.col("path"), lengths))
    universe = judged.select(F.explode("_keys").alias("key")).withColumn("key_hash", F.xxhash64("key"))
    shard = F.pmod(F.hash("key"), F.lit(shards))
    best = {}
    for number in range(shards):
        for verdict in ("block", "allow"):
            listed = rules.where((F.col("verdict") == verdict) & (shard == number)).select("key", "key_hash")
            cascade = build_cascade(universe.where(shard == number), listed, bits)
            mine = _keys_of_shard(number, shards)
            name = f"_{verdict}{number}"
            judged = flag_listed(judged.withColumn("_mine", mine), cascade, "_mine", "_flags")
            picked = F.filter(
                F.transform(F.arrays_zip("_mine", "_flags"), lambda z: F.when(z["_flags"], F.struct(
                    F.length(z["_mine"]).alias("n"), F.length(F.regexp_extract(z["_mine"], "^[^/]*", 0)).alias("h"),
                    z["_mine"].alias("key"), F.lit(verdict).alias("verdict")))),
                lambda s: s.isNotNull(),
            )
            judged = judged.withColumn(name, F.array_max(picked)).drop("_mine", "_flags")
            best[name] = F.col(name)
    judged = judged.withColumn("_best", F.greatest(*best.values()) if len(best) > 1 else next(iter(best.values())))
    return judged.withColumns({
        "rule": F.col("_best.key"), "verdict": F.coalesce("_best.verdict", F.lit(UNLISTED)),
    }).drop("_keys", "_best", *best)


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    return judge_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
