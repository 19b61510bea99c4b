"""Token files: all ids in one run, document boundaries in Elias-Fano form.

Texts are encoded where they lie; the ids, two bytes each if the vocabulary allows, are dealt to
shards, which are ranges of document ids of about equal size, and sorted by id.  Every shard has *blocks*: the ids of whole
documents one after the other (``BLOCK_IDS``, more only for a longer document), the ends of the
documents as an Elias-Fano sequence, and how many ids of the shard come before.  An end costs
2 + log2(ids / documents) bits instead of 64; ``EliasFano.select`` finds any of them from sampled
positions of the upper bits, without a table of offsets.  Blocks are rows of a Parquet table, so
Spark's committer holds the files together when executors are lost.

A document's place among all ids is the sum of the shards before (one number each, from
the files), of the blocks before and of the documents before.

Arrow cuts texts into white-space separated stretches, with plain letters lower-cased and last signs
set apart, and finds the distinct ones.  Their encodings are kept in a table of bounded size in each worker;
every stretch is encoded by the library itself.

Defined results: a null or empty text has the end id only; repeated rows are written once each;
a null document id comes first and stays null; ties in the id are ordered by the text's hash;
no rows write no blocks; other columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight.llm.common import IdleTables, text_slices

BLOCK_IDS = 1 << 16
MOST_STRETCHES = 900_000
SAMPLE = 64
#: Signs of ASCII after a letter or digit up to the end of a stretch; an apostrophe can begin a token with letters,
#: and U+0130 ends in a mark when lower-cased.
LAST_SIGNS = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([!-&(-/:-@\[-`{-~]+)( |$)"
#: Marks that compose with a letter of ASCII, a small one more often than its capital.
MARKS = r"[\x{300}-\x{36F}]"
#: How the vocabulary marks a token that ends a word.
WORD_END = "</w>"
#: Words that are encoded in one call.
JOINED = 256
END_ID = 1


class EliasFano:
    """A non-decreasing sequence of n numbers below ``top``: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(np.log2(top / n))) if n and top > n else 0
        values = values.astype(np.int64)
        at = (values >> low_bits) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) + 1, dtype=np.uint8)
        high[at] = 1
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def _lows(self, start: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.int64)
        first, last = start * self.low_bits, (start + count) * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")
        bits = bits[first % 8 : first % 8 + last - first].reshape(count, self.low_bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Number i, from the sampled one before it: at most SAMPLE ones of the upper bits are read."""
        at = int(self.samples[i // SAMPLE])
        want, byte = i % SAMPLE, at // 8
        left = want + 1  # ones still to find, beginning with the sampled one
        skip = at % 8
        while True:
            bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[skip:])
            if len(bits) >= left:
                place = byte * 8 + skip + int(bits[left - 1])
                return (place - i) << self.low_bits | int(self._lows(i, 1)[0])
            left, byte, skip = left - len(bits), byte + 1, 0

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (at - np.arange(self.n)) << self.low_bits | self._lows(0, self.n)


class StretchEncoder:
    """Ids of texts by a tokenizers file; a token must never span a space or a line feed.

    Texts that hold one of the file's added tokens are encoded whole, since these are cut out first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.wide = self.tool.get_vocab_size() > 1 << 16
        self.kind, self.letter = ("<u4", "I") if self.wide else ("<u2", "H")
        self.known = {"": b""}
        self.ends_word = np.zeros(self.tool.get_vocab_size(), dtype=bool)
        for token, i in self.tool.get_vocab().items():
            self.ends_word[i] = token.endswith(WORD_END)

    def _tokens(self, stretches: list[str]) -> list[bytes]:
        found = self.tool.encode_batch_fast(stretches, add_special_tokens=False)
        return [array(self.letter, x.ids).tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, many in a call: each is one word for the tokenizer too."""
        out: list[bytes] = []
        for low in range(0, len(words), JOINED):
            part = words[low : low + JOINED]
            ids = np.array(self.tool.encode(" ".join(part), add_special_tokens=False).ids, dtype=self.kind)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * ids.itemsize
            if len(ends) == len(part) and ends[-1] == ids.nbytes:
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            else:
                out += self._tokens(part)
        return out

    def _learnt(self, stretches: list[str]) -> dict[str, bytes]:
        words = [s for s in stretches if s.lower().isalpha()]
        out = dict(zip(words, self._words(words), strict=True))
        others = [s for s in stretches if s not in out]
        out.update(zip(others, self._tokens(others), strict=True))
        return out

    def _of(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches, from the table or learnt; what is learnt is kept while there is room."""
        found = list(map(self.known.get, stretches))
        fresh = [s for s, ids in zip(stretches, found, strict=True) if ids is None]
        if fresh:
            learnt = self._learnt(fresh)
            found = [learnt[s] if ids is None else ids for s, ids in zip(stretches, found, strict=True)]
            if len(self.known) + len(learnt) <= MOST_STRETCHES:
                self.known.update(learnt)
        return found

    def _plain(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Texts with fewer forms and the same ids: plain letters lower-cased, as the tokenizer does with all, and
        signs at the end of a stretch, which are a token of their own after a letter or digit, set apart.

        The second array marks texts that hold an added token, or would hold one lower-cased.
        """
        lower = pc.if_else(pc.match_substring_regex(texts, MARKS), texts, pc.ascii_lower(texts))
        held = pa.array(np.zeros(len(texts), dtype=bool))
        for token in self.added:
            held = pc.or_(held, pc.or_(pc.match_substring(texts, token), pc.match_substring(lower, token)))
        apart = pc.replace_substring_regex(pc.replace_substring(lower, "\n", " "), LAST_SIGNS, r"\1 \2\3")
        return pc.if_else(held, "", apart), held

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text.  Arrow cuts the texts and finds the distinct stretches, which alone are looked up."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        plain, held = self._plain(texts)
        cut = pc.split_pattern(plain, " ")
        coded = cut.flatten().dictionary_encode()
        found = self._of(coded.dictionary.to_pylist())
        known = np.frombuffer(b"".join(found), dtype=self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // known.itemsize
        codes = coded.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        shift = (np.cumsum(sizes) - sizes)[codes] - (ends - lengths)  # from a place in the texts to one in known
        ids = known[np.repeat(shift, lengths) + np.arange(lengths.sum())]
        at = np.concatenate((np.zeros(1, np.int64), ends))[cut.offsets.to_numpy()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        for i in np.flatnonzero(held.to_numpy(zero_copy_only=False)):
            out[i] = self._tokens([texts[i].as_py()])[0]
        return out


_ENCODERS = IdleTables(StretchEncoder)


def stretch_encoder(path: str):
    """Context of an encoder, one for each worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
    return _ENCODERS.use(path)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID, slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, text_hash, ids): ids of each text and the end id, as packed little-endian numbers."""

    def run(batches):
        with stretch_encoder(path) as tool:
            end = np.array([end_id], dtype=tool.kind).tobytes()
            for batch in batches:
                for part in text_slices(batch, "text", slice_bytes):
                    ids = [x + end for x in tool.encode(part["text"])]
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_id"], part["text_hash"], pa.array(ids, pa.binary())],
                        names=["doc_id", "text_hash", "ids"],
                    )

    rows = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")
    )
    return rows.mapInArrow(run, "doc_id long, text_hash long, ids binary")


_BLOCK = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()),
    ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.binary()), ("absent", pa.binary()),
    ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()),
    ("ids", pa.binary()),
])
_BLOCK_SQL = ("shard int, block int, before long, n_docs int, n_ids long, width int, doc_ids binary, absent binary, "
              "low_bits int, low binary, high binary, samples binary, ids binary")


def _pack(batches, width: int, block_ids: int):
    """Blocks of rows sorted by shard and document."""
    shard, block, before = None, 0, 0
    doc_ids: list = []
    parts: list[bytes] = []
    size = 0

    def packed():
        ends = np.cumsum([len(p) // width for p in parts])
        ef = EliasFano.of(ends, int(ends[-1]) + 1)
        row = {
            "shard": shard, "block": block, "before": before, "n_docs": len(parts),
            "n_ids": int(ends[-1]), "width": width, "low_bits": ef.low_bits,
            "doc_ids": np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes(),
            "absent": np.packbits([i is None for i in doc_ids]).tobytes(),
            "low": ef.low.tobytes(), "high": ef.high.tobytes(), "samples": ef.samples.tobytes(),
            "ids": b"".join(parts),
        }
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    for batch in batches:
        rows = zip(batch["shard"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True)
        for now, i, raw in rows:
            if parts and (now != shard or size + len(raw) > block_ids * width):
                yield packed()
                block, before = block + 1, before + size // width
                doc_ids, parts, size = [], [], 0
            if now != shard:
                shard, block, before = now, 0, 0
            doc_ids.append(i)
            parts.append(raw)
            size += len(raw)
    if parts:
        yield packed()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
                      shards: int | None = None) -> None:
    """Encode ``docs`` and write blocks in ascending document id to a new Parquet table at ``path``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or 4 * parts
    with stretch_encoder(tokenizer) as tool:
        width = 4 if tool.wide else 2
    shares = [i / shards for i in range(1, shards)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 100 * shards)).first()[0] or []
    cut_list = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")  # an id for each shard
    # null ids are below all cuts
    shard = F.size(F.filter(cut_list, lambda c: c < F.col("doc_id")))
    rows = encoded(docs, tokenizer, end_id).withColumn("shard", shard)
    rows = rows.repartition(parts, "shard").sortWithinPartitions(
        "shard", F.col("doc_id").asc_nulls_first(), "text_hash"
    )
    blocks = rows.select("shard", "doc_id", "ids").mapInArrow(lambda b: _pack(b, width, block_ids), _BLOCK_SQL)
    blocks.write.mode("errorifexists").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document; ids are packed little-endian unsigned 32-bit numbers."""
    blocks = spark.read.schema(_BLOCK_SQL).parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row a shard
    starts = dict(zip((r.shard for r in sums), np.cumsum([0, *(r.n for r in sums)]).tolist(), strict=False))
    held = spark.sparkContext.broadcast(starts)

    def unpack(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ends = EliasFano(b["n_docs"], b["low_bits"], b["low"], b["high"], b["samples"]).all()
                ids = np.frombuffer(b["ids"], "<u4" if b["width"] == 4 else "<u2").astype("<u4")
                begins = np.concatenate(([0], ends[:-1]))
                absent = np.unpackbits(np.frombuffer(b["absent"], np.uint8), count=b["n_docs"]).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b["doc_ids"], "<i8"), mask=absent),
                     pa.array(begins + (held.value[b["shard"]] + b["before"])),
                     pa.array([ids[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    return blocks.mapInArrow(unpack, "doc_id long, start long, ids binary")


def token_digest(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write the files to ``path``, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def document_ids(spark: SparkSession, path: str, shard: int, block: int, number: int) -> np.ndarray:
    """Ids of one document of one block, by two selects."""
    b = spark.read.schema(_BLOCK_SQL).parquet(path).where((F.col("shard") == shard) & (F.col("block") == block)).first()
    ends = EliasFano(b.n_docs, b.low_bits, b.low, b.high, b.samples)
    start = ends.select(number - 1) if number else 0
    return np.frombuffer(b.ids, "<u4" if b.width == 4 else "<u2")[start : ends.select(number)].astype("<u4")
