"""Byte-level BPE as a finite-state transducer, and streaming decoding.

The ranks of a byte-pair vocabulary are compiled into a transducer over bytes.  The last token of
the encoding of a prefix is the only token that ends there and may follow the last token of the
encoding of what precedes it; two tokens may follow each other exactly if merging their joined
bytes gives the two again.  So a state is the set of positions from which a token could still
begin (a node of the vocabulary's trie each) with the tokens that lead to them.  Tokens on which
all of them agree are emitted and taken out of the state, so output lags behind by a bounded
number of bytes.  States and moves are made when they are needed and kept in a table (determinised
lazily) for the first ``KEPT_BYTES`` bytes of a match; further on, where few come again, the open
positions are followed one by one.  A table with ``MOST_STATES`` states is begun anew, which
changes no result.

Texts are cut by the pattern first and each match is encoded on its own.  A match can only begin,
never go on, at a space between two other signs, and a line feed between two other signs is a match
of its own.  Encodings of the stretches between such cuts are kept in a table of bounded size; where
white space comes in other ways, the stretch goes on to the next cut.

Defined results: a null or empty text has no ids and decodes to an empty text; text that isn't
valid Unicode has U+FFFD for the bad bytes; ids that don't form valid UTF-8 decode to U+FFFD for
the bad bytes, a null list of ids to an empty text; ids outside the vocabulary raise an error;
rows stay as they are (repeated rows, any ids) and other columns are kept.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from mergelight.llm.common import IdleTables, fresh_name, hex_sha256

#: Moves over this many first bytes of a match are kept.
KEPT_BYTES = 5
#: Sizes of a worker's tables; they bound its memory and change no result.
MOST_STATES = 100_000
MOST_PAIRS = 300_000
MOST_STRETCHES = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: merge the neighbours of least rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 256
    worth = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while worth:
        least = min(worth)
        if least == none:
            break
        i = worth.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del worth[i]
        if i:
            worth[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(worth):
            worth[i] = ranks.get(parts[i] + parts[i + 1], none)
    return parts


class Transducer:
    """Lazily determinised transducer from bytes to token ids.

    A state is (last token emitted, trie nodes of the open positions, oldest first, tokens that
    lead from the last emitted one to each of them); the newest position is where the input ends.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most_states = ranks, most_states
        self.token = {i: b for b, i in ranks.items()}
        self.goto: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends: list[int | None] = [None]  # the token that ends at a node
        inner = set()
        for word, number in ranks.items():
            node = 0
            for byte in word:
                inner.add(node)
                node = self.goto.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(None)
            self.ends[node] = number
        self.goes_on = [node in inner for node in range(len(self.ends))]
        self.follows: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state((None, (0,), ((),)))

    def _state(self, state: tuple) -> int:
        number = self.known.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens gives the two again."""
        key = a << 32 | b
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) >= MOST_PAIRS:
                self.follows.clear()
            x, y = self.token[a], self.token[b]
            found = self.follows[key] = x + y not in self.ranks and merge_bytes(x + y, self.ranks) == [x, y]
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, nodes, leads = self.states[state]
        goto, ends, goes_on = self.goto, self.ends, self.goes_on
        after, ways, here = [], [], None
        for node, tokens in zip(nodes, leads, strict=True):
            child = goto.get(node << 8 | byte)
            if child is None:
                continue
            number = ends[child]
            if number is not None and here is None:
                before = tokens[-1] if tokens else last
                if before is None or self.may_follow(before, number):
                    here = (*tokens, number)
            if goes_on[child]:
                after.append(child)
                ways.append(tokens)
        if here is None:
            raise ValueError(f"byte {byte} is no token of the vocabulary")
        after.append(0)
        ways.append(here)
        oldest, same = ways[0], 0
        if oldest:
            shared = min(map(len, ways))
            while same < shared and all(w[same] == oldest[same] for w in ways):
                same += 1
        emitted = here[:same]
        if same:
            last, ways = here[same - 1], [w[same:] for w in ways]
        if len(self.states) >= self.most_states:
            self.forget()
            return self._state((last, tuple(after), tuple(ways))), emitted  # not kept: its origin is gone
        move = self.moves[state << 8 | byte] = (self._state((last, tuple(after), tuple(ways))), emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state, moves = self.start, self.moves
        for at, byte in enumerate(piece):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if at >= KEPT_BYTES:
                    return out + self._follow(state, piece[at:])
                move = self._move(state, byte)
                moves = self.moves
            state, emitted = move
            if emitted:
                out += emitted
        out += self.states[state][2][-1]
        return out

    def _follow(self, state: int, rest: bytes) -> list[int]:
        """The same machine without its table: tokens from a state to the end of the input."""
        last, nodes, leads = self.states[state]
        goto, ends, goes_on, follows = self.goto, self.ends, self.goes_on, self.follows
        live = []
        for node, tokens in zip(nodes, leads, strict=True):
            way = (None, last)
            for number in tokens:
                way = (way, number)
            live.append((node, way))
        for byte in rest:
            after, here = [], None
            for node, way in live:
                child = goto.get(node << 8 | byte)
                if child is not None:
                    if goes_on[child]:
                        after.append((child, way))
                    number = ends[child]
                    if number is not None and here is None:
                        before = way[1]
                        if before is None:
                            here = (way, number)
                        else:
                            fits = follows.get(before << 32 | number)
                            if fits or fits is None and self.may_follow(before, number):
                                here = (way, number)
            if here is None:
                raise ValueError(f"byte {byte} is no token of the vocabulary")
            after.append((0, here))
            live = after
        out = []
        way = live[-1][1]
        while way[0] is not None:
            out.append(way[1])
            way = way[0]
        out.reverse()
        return out


class _Odd(Exception):
    """A stretch that touches white space other than single spaces and line feeds."""


class Stretches(dict):
    """Encodings, as bytes of 32-bit ids, of the stretches between cuts.

    A key that begins with a line feed stands for the line feed and what follows it, any other one
    for ``lead`` and itself.
    """

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, stretch: str) -> bytes:
        if stretch[:1] == "\n":
            word = stretch[1:]
            if not word or word[0].isspace() or word[-1].isspace():
                raise _Odd
            ids = self.encoder.line_feed + self.encoder.begin[word]
        else:
            if not stretch or stretch[0].isspace() or stretch[-1].isspace():
                raise _Odd
            if stretch.isalpha():
                ids = self.encoder.piece(self.lead + stretch)  # letters only are one match
            elif len(stretch) > 1 and stretch[-1] in ".,;:" and stretch[-2].isalnum():
                # a sign after a letter or digit begins a match of its own
                ids = self[stretch[:-1]] + self.encoder.begin[stretch[-1]]
            else:
                ids = self.encoder.pieces(self.lead + stretch)
        if len(self) < MOST_STRETCHES and len(stretch) < 100:
            self[stretch] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.begin, self.inner = Stretches(self, ""), Stretches(self, " ")
        self.line_feed = self.pieces("\n")
        # a space or line feed between signs that no definition takes for white space
        self.cut = regex.compile(r"(?<=[^\s\p{Z}\p{C}])([ \n])(?=[^\s\p{Z}\p{C}])")

    def piece(self, text: str) -> bytes:
        return array("i", self.transducer.encode(text.encode("utf-8"))).tobytes()

    def pieces(self, text: str) -> bytes:
        encode = self.transducer.encode
        return array("i", [i for piece in self.pattern.findall(text) for i in encode(piece.encode("utf-8"))]).tobytes()

    def _with_odd_stretches(self, text: str) -> bytes:
        """The same by exact cuts: stretches hold white space, and these only are encoded anew."""
        parts = self.cut.split(text)  # stretch, cut, stretch, ...
        out = []
        for at in range(0, len(parts), 2):
            cut, stretch = parts[at - 1] if at else "", parts[at]
            table = self.inner if cut == " " else self.begin
            if cut == "\n":
                out.append(self.line_feed)
            try:
                out.append(table[stretch])
            except _Odd:
                out.append(self.pieces(table.lead + stretch))
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<i4")
        stretches = text.replace("\n", " \n").split(" ")
        try:
            first = self.begin[stretches[0]]
            raw = first + b"".join(map(self.inner.__getitem__, stretches[1:]))
        except _Odd:
            raw = self._with_odd_stretches(text)
        return np.frombuffer(raw, dtype="<i4")


_ENCODERS = IdleTables(lambda path, pattern: Encoder(read_ranks(path), pattern))


def encoder(path: str, pattern: str):
    """Context of an encoder, one for each worker and vocabulary."""
    return _ENCODERS.use(path, pattern)


class Utf8Stream:
    """Incremental UTF-8: text of every complete sequence so far, an open one is held back."""

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a lead byte: are its continuation bytes there?
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if back < need and byte < 0xF8:
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        text, self.open = self.open.decode("utf-8", "replace"), b""
        return text


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        words = [b""] * (max(ranks.values()) + 1)
        for word, number in ranks.items():
            words[number] = word
        self.data = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.lengths = np.array([len(w) for w in words])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        shift = self.starts[ids] - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(ids) else lengths
        return self.data[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes()

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of ids that come in chunks, cut anywhere."""
        utf8 = Utf8Stream()
        for chunk in chunks:
            yield utf8.feed(self.bytes_of(chunk))
        yield utf8.end()

    def decode(self, ids: np.ndarray, chunk: int = 1 << 16) -> str:
        return "".join(self.stream(ids[i : i + chunk] for i in range(0, len(ids), chunk)))


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def with_ids(docs: DataFrame, path: str, pattern: str, column: str = "ids", text: str = "text") -> DataFrame:
    """Add the token ids of each text."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(raw):
        with encoder(path, pattern) as tool:
            return pd.Series([tool.encode(r.decode("utf-8", "replace") if r else "") for r in raw], index=raw.index)

    return docs.withColumn(column, encode(F.col(text).cast("string").cast("binary")))


def with_decoded(docs: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Add the text that each list of ids stands for."""

    @F.pandas_udf(StringType())
    def decode(lists):
        tool = decoder(path)
        return pd.Series(
            [tool.decode(np.asarray(x, dtype=np.int64)) if x is not None else "" for x in lists],
            index=lists.index, dtype=object,
        )

    return docs.withColumn(column, decode(ids))


def round_trip(docs: DataFrame, path: str, pattern: str, step: int = 128) -> DataFrame:
    """Add ``ids`` and what they decode to, ``decoded``, in one pass, ``step`` rows at a time."""
    docs = docs.drop("ids", "decoded")
    raw, names = fresh_name(docs, "_raw"), [*docs.columns, "ids", "decoded"]

    def both(batches):
        back = decoder(path)
        with encoder(path, pattern) as there:
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    part = batch.slice(low, step)
                    texts = part[raw].to_pylist()
                    ids = [there.encode(t.decode("utf-8", "replace") if t else "") for t in texts]
                    text = pa.array([back.decode(i) for i in ids], pa.string())
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [*part.drop_columns([raw]).columns, pa.ListArray.from_arrays(ends, flat), text],
                        names=names,
                    )

    more = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    kind = StructType([*docs.schema.fields, *more])
    return docs.withColumn(raw, F.col("text").cast("string").cast("binary")).mapInArrow(both, kind)


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return round_trip(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )
