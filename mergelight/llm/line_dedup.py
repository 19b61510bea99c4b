"""Line deduplication with bitmaps of what to keep.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.  A key of at
least ``min_chars`` code points that is found in ``min_docs`` documents or more loses its lines
in all of them but the one with the largest id.

Only 128-bit hashes of keys that are long enough travel, with document and position.  They are
range-partitioned and sorted by (hash, document descending, position), so the first document of a
run is the one that keeps its lines, and a stream through a partition holds at most the lines of
``min_docs`` documents of one key.  The range covers the document too: a line that a third of all
documents share is spread over many partitions.  Only the first key of a partition can have
begun in an earlier one: these keys, one a partition, are counted beforehand and looked up.

The result is a bitmap per document, one bit a line, packed and compressed; ``apply_bitmaps``
turns texts and bitmaps into what remains.

Defined results: a null or empty text is one empty line; repeated rows (same id and text) count as
one document and give one row of bitmaps; rows that share an id but not the text are one document
for counting (the key's largest id keeps its lines in all of them) and have a bitmap each; a null
id counts as the least long; other columns are kept by ``apply_bitmaps`` and ignored else.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from mergelight.llm.common import fresh_name, hex_sha256
from mergelight.session import cut_lineage

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
_NO_ID = -(1 << 63)
_LINES = "id long, text_hash long, n_lines int, h1 long, h2 long, at int"

def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> tuple[int, list[tuple[int, bytes]]]:
    """Number of lines, and (position, 16-byte hash) of those whose key is long enough."""
    lines = (text or "").split("\n")
    found = []
    for at, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACE)
            if len(key) >= min_chars:
                raw = key.translate(_LOWER).encode("utf-8", "surrogatepass")
                found.append((at, hashlib.blake2b(raw, digest_size=16).digest()))
    return len(lines), found


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(document, hash, position) of every line with a long enough key; whole texts are read once."""

    def scan(batches):
        for batch in batches:
            ids, hashes = batch["id"].to_pylist(), batch["text_hash"].to_pylist()
            for low in range(0, batch.num_rows, 256):
                rows = ([], [], [], [], [])
                for row, text in enumerate(batch["text"].slice(low, 256).to_pylist(), low):
                    n, found = line_keys(text, min_chars)
                    for at, key in found:
                        for column, value in zip(rows, (ids[row], hashes[row], n, key, at), strict=True):
                            column.append(value)
                keys = np.frombuffer(b"".join(rows[3]), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()),
                     pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(rows[4], pa.int32())],
                    names=["id", "text_hash", "n_lines", "h1", "h2", "at"],
                )

    rows = docs.select(_id().alias("id"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(scan, _LINES)



def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, n_lines, at): every line that goes."""
    spark = docs.sparkSession
    order = ["h1", "h2", F.col("id").desc(), "text_hash", "at"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    lines = cut_lineage(hashed_lines(docs, min_chars))  # ranges are found in one more pass: not over the texts
    lines = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lines = cut_lineage(lines.withColumn("part", F.spark_partition_id()))
    edges = F.broadcast(  # a key for each partition at most
        lines.groupBy("part").agg(F.min(F.struct("h1", "h2")).alias("k")).select("k.h1", "k.h2").distinct()
    )
    counted = lines.join(edges, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    counted = counted.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("keeps"))
    known = {(r.h1, r.h2): (r.docs, r.keeps) for r in counted.collect()}  # a row for each partition at most
    held = spark.sparkContext.broadcast(known)
    return lines.mapInArrow(
        lambda batches: _stream(batches, held.value, min_docs), "id long, text_hash long, n_lines int, at int"
    )


def _stream(batches, known: dict, min_docs: int):
    """Rows that go, from rows sorted by key, document descending, position.

    A run that is still open at the end of a batch is carried while it has fewer than ``min_docs``
    documents; once it has them, all that follows of it goes.
    """
    names = ["id", "text_hash", "n_lines", "at", "h1", "h2"]
    carry: list[np.ndarray] | None = None
    settled = None  # key of an open run that has its documents
    for batch in batches:
        x = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        if carry is not None:
            x = [np.concatenate(pair) for pair in zip(carry, x, strict=True)]
        if not len(x[0]):
            continue
        new_key = np.ones(len(x[0]), dtype=bool)
        new_key[1:] = (x[4][1:] != x[4][:-1]) | (x[5][1:] != x[5][:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= x[0][1:] != x[0][:-1]
        begins = np.flatnonzero(new_key)
        docs = np.add.reduceat(new_doc.astype(np.int64), begins)
        seen = np.cumsum(new_doc)
        run = np.cumsum(new_key) - 1
        goes = (docs[run] >= min_docs) & (seen - seen[begins][run] > 0)
        for number in {0, len(begins) - 1}:
            a = begins[number]
            key = (int(x[4][a]), int(x[5][a]))
            mine = slice(a, begins[number + 1] if number + 1 < len(begins) else len(x[0]))
            if key in known:
                total, keeps = known[key]
                goes[mine] = (x[0][mine] != keeps) if total >= min_docs else False
            elif key == settled:
                goes[mine] = True
        last = (int(x[4][-1]), int(x[5][-1]))
        if last in known or last == settled or docs[-1] >= min_docs:
            carry, settled = None, last
        else:
            carry, settled = [c[begins[-1]:] for c in x], None
            goes[begins[-1]:] = False
        yield pa.RecordBatch.from_arrays([pa.array(c[goes]) for c in x[:4]], names=names[:4])


@F.pandas_udf(BinaryType())
def _bitmap(n_lines, dropped):
    out = []
    for n, gone in zip(n_lines, dropped, strict=True):
        keep = np.ones(n, dtype=bool)
        keep[gone] = False
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return n_lines.__class__(out)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, n_dropped, keep) for each document that loses lines; the others keep all."""
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("id", "text_hash").agg(
        F.max("n_lines").alias("n_lines"), F.collect_set("at").alias("gone")  # the lines of one text
    )
    return gone.select(
        "id", "text_hash", F.size("gone").cast("long").alias("n_dropped"), _bitmap("n_lines", "gone").alias("keep")
    )


@F.pandas_udf(StringType())
def _kept(text, keep):
    out = []
    for t, bits in zip(text, keep, strict=True):
        if bits is None or t is None:
            out.append(t)
        else:
            lines = t.split("\n")
            flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8), count=len(lines))
            out.append("\n".join(line for line, flag in zip(lines, flags, strict=True) if flag))
    return text.__class__(out, dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, kept: str, dropped: str) -> DataFrame:
    """``docs`` with two more columns: what the bitmap leaves of the text, how many lines went."""
    names = {c: fresh_name(docs, f"_{c}") for c in ("id", "text_hash", "keep")}
    extra = bitmaps.withColumnsRenamed(names | {"n_dropped": dropped})
    same = (_id() == extra[names["id"]]) & (F.xxhash64(docs["text"].cast("string")) == extra[names["text_hash"]])
    joined = docs.join(extra, same, "left")
    bits = F.col(names["keep"])
    changed = F.when(bits.isNotNull(), docs["text"])  # no other text goes to a Python worker
    left = F.when(bits.isNull(), docs["text"]).otherwise(_kept(changed, bits))
    return joined.withColumns({kept: left, dropped: F.coalesce(dropped, F.lit(0))}).drop(*names.values())


def line_digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return apply_bitmaps(docs, keep_bitmaps(docs), "kept", "n_dropped").select(
        "doc_id", (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long"), hex_sha256(F.coalesce("kept", F.lit(""))).alias("kept_sha256"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns; text holds what stays, n_chars of changed texts its length."""
    kept, dropped = fresh_name(docs, "_kept"), fresh_name(docs, "_dropped")
    done = apply_bitmaps(docs, keep_bitmaps(docs), kept, dropped)
    out = {c: F.col(c) for c in docs.columns} | {"text": F.col(kept).alias("text")}
    if "n_chars" in docs.columns:
        length = F.length(kept).cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col(dropped) > 0, length).otherwise(F.col("n_chars")).alias("n_chars")
    return done.select(*out.values())
