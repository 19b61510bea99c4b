"""Fill-in-the-middle: cut a text at two ranks and write its parts in another order.

A text is cut into units: code points, or the matches of a pattern and the stretches between them.
Its units form an indexable skip list: the lowest lane has one link a unit, each higher one a link
for every ``FAN`` links below, and every link carries how many units and how many code points it
passes.  A cut is a rank in units; the descent goes along a lane while the units passed stay
within the rank, then one lane down, and the code points passed on the way are the place of the
cut.  Two cuts give prefix, middle and suffix.

Ranks and form come from a hash of seed and document id, so a run can be repeated anywhere.

Defined results: a null text is empty; an empty text, or one that holds a sentinel, stays plain; a
null id is hashed as an empty one; repeated rows give equal rows; rows that share an id but not
the text share the hash only; other columns are kept, and those with the names of the new ones
are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mergelight.llm.common import fresh_name, hex_sha256

SEED = 1
PLAIN_FROM = 90
SPM_BELOW = 20
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
FAN = 16


class SkipList:
    """Lanes of links with their widths in units and in code points, lowest lane first.

    Lanes are arrays: link i of a lane leads over links FAN * i .. FAN * i + FAN - 1 of the lane below.
    """

    def __init__(self, points: np.ndarray):
        self.points = [points]
        self.units = [np.ones(1, np.uint8).repeat(len(points))]
        while len(self.points[-1]) > FAN:
            heads = np.arange(0, len(self.points[-1]), FAN)
            for lanes in (self.points, self.units):
                lanes.append(np.add.reduceat(lanes[-1], heads, dtype=np.int64))

    def seek(self, rank: int) -> tuple[int, int]:
        """Units and code points passed when no more than ``rank`` units are."""
        link = units = points = 0
        for wide, long in zip(reversed(self.units), reversed(self.points), strict=True):
            while link < len(wide) and units + int(wide[link]) <= rank:
                units, points, link = units + int(wide[link]), points + int(long[link]), link + 1
            link *= FAN
        return units, points


def unit_widths(text: str, unit: regex.Pattern | None = None) -> np.ndarray:
    """Code points of each unit of a text; without a pattern each code point is one."""
    if unit is None:
        return np.ones(len(text), np.uint8)
    ends, at = [], 0
    for found in unit.finditer(text):
        if found.end() > found.start():
            if found.start() > at:
                ends.append(found.start())
            ends.append(at := found.end())
    if at < len(text):
        ends.append(len(text))
    return np.diff(np.array([0, *ends], dtype=np.int64))


def ranked_cuts(text: str, picks: tuple[int, int], unit: regex.Pattern | None = None) -> tuple[int, int, int]:
    """Number of units, and the code points before each of the two cuts, in ascending order."""
    lanes = SkipList(unit_widths(text, unit))
    n = len(lanes.points[0])
    low, high = sorted(p % (n + 1) for p in picks)
    return n, lanes.seek(low)[1], lanes.seek(high)[1]


def hash_words(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the SHA-256 of ``seed:id`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(count)]


def fim_form(text: Column, words: list[Column]) -> Column:
    """plain, psm or spm."""
    plain = (text == "") | (words[2] % 100 >= PLAIN_FROM)
    for sign in SENTINELS:
        plain = plain | text.contains(sign)
    return F.when(plain, "plain").when(words[3] % 100 < SPM_BELOW, "spm").otherwise("psm")


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: int = SEED, step: int = 256) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output; ``unit`` is a pattern."""
    names = {c: fresh_name(docs, f"_{c}") for c in ("raw", "h1", "h2", "kind")}
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c.lower() not in made]
    text = F.coalesce(F.make_valid_utf8(F.col("text").cast("string")), F.lit(""))
    words = hash_words(F.col("doc_id"), seed)
    rows = docs.select(
        *kept, text.alias(names["raw"]), words[0].alias(names["h1"]), words[1].alias(names["h2"]),
        fim_form(text, words).alias(names["kind"]),
    )

    def cut(batches):
        pattern = regex.compile(unit) if unit is not None else None
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                found: list[list] = [[] for _ in made]
                picks = zip(*(batch[names[c]].to_pylist() for c in ("raw", "h1", "h2", "kind")), strict=True)
                for text, h1, h2, form in picks:
                    n, a, b = ranked_cuts(text, (h1, h2), pattern)
                    if form == "plain":
                        row = (n, form, None, None, text)
                    elif form == "psm":
                        row = (n, form, a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}")
                    else:
                        row = (n, form, a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}")
                    for column, value in zip(found, row, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in kept], *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]],
                    names=[*kept, *made],
                )

    types = [LongType(), StringType(), LongType(), LongType(), StringType()]
    more = [StructField(c, t) for c, t in zip(made, types, strict=True)]
    return rows.mapInArrow(cut, StructType([*[docs.schema[c] for c in kept], *more]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for: parts lie between sentinels, which texts don't hold."""
    parts = F.split(output, "<[PSM]>")
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def fim_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    return fill_in_middle(docs.select("doc_id", "text")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", hex_sha256(F.col("output")).alias("output_sha256"),
        hex_sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
