"""Words of many texts at once: byte tables, boundaries and 64-bit word hashes with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mergelight.llm.common import mixed

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def _tables(is_word) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower, np.array([is_word(int(b)) for b in lower], dtype=bool)


#: Letters a-z after lower-casing, digits, and every byte of a character beyond ASCII.
ALNUM = _tables(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Everything but ASCII white space.
NON_SPACE = _tables(lambda b: not (b == 32 or 9 <= b <= 13))
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


@dataclass
class Words:
    """Words of a run of texts: byte ranges in ``data`` (lower-cased), and each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # text i has words first[i] .. first[i + 1]
    raw: np.ndarray  # the bytes before lower-casing

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def joined(self, start: int, count: int) -> str:
        parts = (self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(start, start + count))
        return b" ".join(parts).decode("utf-8", "replace")

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)


def words_of(texts: pa.Array, kind=ALNUM) -> Words:
    """Words of an Arrow array of strings; nulls have none."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lower, is_word = kind
    raw, data = data, lower[data]
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(data) else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), raw)


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(length: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < length:
        grown = np.full(max(length, 1 << 12), _STEP, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial with odd step, mixed at the end."""
    out = np.zeros(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        base = starts[done]
        stop = max(done + 1, int(np.searchsorted(ends, base + block, side="right")))
        s, e = starts[done:stop] - base, ends[done:stop] - base
        lengths = e - s
        values = _VALUES[data[base : base + e[-1]]]
        if lengths.sum() < len(values):  # drop separators
            at = np.repeat(s - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            values = values[at]
            s = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        within = np.arange(len(values)) - np.repeat(s, lengths)
        values *= _powers(int(lengths.max()))[within]
        out[done:stop] = np.add.reduceat(values, s)
        done = stop
    return mixed(out + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order; len(hashes) - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:n].copy()
    for i in range(1, k):
        total *= _GRAM
        total += hashes[i : i + n]
    return mixed(total + np.uint64(k))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
