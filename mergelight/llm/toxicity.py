"""Toxicity by a classifier chain.

Categories are predicted one after the other: the linear model of each gets, besides the words,
the log-odds of all categories before it.  While learning, these come from out-of-fold models:
rows are dealt to folds by a hash, and a row's probability comes from a model that hasn't seen its
fold.  When scoring, they are the earlier models' own probabilities.

Features are the distinct words of a document and their beginnings of ``STEMS`` bytes, hashed to
``bits`` bits.  Spark counts over *all* labelled training rows how many documents of either label
hold a feature; a model uses the features whose share differs by ``z`` standard errors or more.
Weights are fitted by stochastic gradient steps on a bounded sample of these rows (``max_rows``,
those of least hash).  Features aren't scaled by the length of a text, so one toxic word in a long
text counts as much as in a short one.  Scoring reads every text whole.

Defined results: a null or empty text has no features: its probabilities come from the
intercepts; a null label teaches nothing for its category; without labels of both kinds a
category's probability is near the one kind's (0.5 without any); several labels for one id: the
largest holds; a null id is held out by the rule of the text ``""``; repeated rows are scored
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from mergelight.llm.common import held_out, logistic, only_with_ids, text_slices
from mergelight.llm.words import word_hashes, words_of
from mergelight.session import cut_lineage

BITS = 20
STEMS = (5, 6, 7, 8)
MAX_ROWS = 12_000
FOLDS = 3
LEAST_Z = 5.0
THRESHOLD = 0.5
#: Counts in a block that tasks send on their way to a sum.
BLOCK_CELLS = 1 << 12
#: The chain over the given labels: name and what makes it 1, in order.
CHAIN = {"poor": "quality = 0", "toxic": "toxic = 1"}


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the distinct words and word beginnings of every text, sorted."""
    words = words_of(texts)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text_of, shift = words.text_of(), np.uint64(64 - bits)
    rows, keys = [text_of], [words.hashes() >> shift]
    for n in STEMS:
        long = words.ends - words.starts > n
        starts = words.starts[long]
        rows.append(text_of[long])
        keys.append((word_hashes(words.data, starts, starts + n) ^ np.uint64(n)) >> shift)
    found = np.unique(np.concatenate(rows) << bits | np.concatenate(keys).astype(np.int64))
    return found >> bits, found & ((1 << bits) - 1)


@dataclass
class Link:
    """One category's model: weights of chosen features and of the categories before it."""

    name: str
    weights: np.ndarray
    before: np.ndarray
    intercept: float

    def margin(self, rows: np.ndarray, keys: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        words = np.bincount(rows, self.weights[keys], minlength=len(earlier))
        return words + earlier @ self.before + self.intercept


@dataclass
class Chain:
    bits: int
    links: list[Link] = field(default_factory=list)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """A column for each category, in the order of the chain."""
        rows, keys = features(texts, self.bits)
        earlier = np.zeros((len(texts), 0))
        for link in self.links:
            margin = np.clip(link.margin(rows, keys, earlier), -8, 8)
            earlier = np.column_stack((earlier, margin))
        return logistic(earlier)


def labelled(docs: DataFrame, labels: DataFrame, chain: dict[str, str]) -> DataFrame:
    """(doc_id, text, a column 0/1/null for each category) of what may be learnt from."""
    known = labels.select("doc_id", *[F.expr(rule).cast("int").alias(name) for name, rule in chain.items()])
    known = known.groupBy("doc_id").agg(*[F.max(name).alias(name) for name in chain])
    known = cut_lineage(known.where(~held_out(F.col("doc_id"))).withColumn("doc_id", F.col("doc_id").cast("long")))
    # labels grow with the corpus, so they are never broadcast: the plan is the same at every size
    return only_with_ids(docs, known).join(known.hint("merge"), "doc_id")


def label_counts(rows: DataFrame, names: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents by category, label and feature, and by category and label, over all rows.

    Every task counts into one array of fixed size and sends it in compressed blocks, which are
    added up by number: 2 x categories x 2**bits numbers reach the driver, whatever the corpus.
    """
    size, kinds = 1 << bits, 2 * len(names)
    cells = -(-(kinds * size + kinds) // BLOCK_CELLS) * BLOCK_CELLS  # features of each kind, then documents of each

    def packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        # the bytes of equal weight lie together, so that small numbers take little room
        raw = [pa.compress(b.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)
               for b in blocks.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()), pa.array(raw, pa.binary())], names=["block", "counts"]
        )

    def unpacked(raw: bytes) -> np.ndarray:
        planes = np.frombuffer(pa.decompress(raw, 8 * BLOCK_CELLS, "zstd", asbytes=True), np.uint8)
        return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()

    def count(batches):
        total = np.zeros(cells, dtype=np.int64)
        found, known = total[: kinds * size].reshape(kinds, size), total[kinds * size :]
        for batch in batches:
            for part in text_slices(batch, "text"):
                of, keys = features(part["text"], bits)
                for c, name in enumerate(names):
                    y = part[name].fill_null(-1).to_numpy(zero_copy_only=False)
                    for kind in (0, 1):
                        np.add.at(found[2 * c + kind], keys[y[of] == kind], 1)
                        known[2 * c + kind] += (y == kind).sum()
        blocks = total.reshape(-1, BLOCK_CELLS)
        used = np.flatnonzero(blocks.any(axis=1))
        for low in range(0, len(used), 256):
            yield packed({int(i): blocks[i] for i in used[low : low + 256]})

    def add(batches):
        """Blocks come sorted by number: the sum of each run."""
        now, held = None, None
        for batch in batches:
            for number, raw in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                if number != now:
                    if now is not None:
                        yield packed({now: held})
                    now, held = number, np.zeros(BLOCK_CELLS, dtype=np.int64)
                held += unpacked(raw)
        if now is not None:
            yield packed({now: held})

    schema = "block int, counts binary"
    parts = rows.select("text", *names).mapInArrow(count, schema)
    sums = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)
    total = np.zeros(cells)
    for row in sums.collect():  # an array of fixed size
        total[row.block * BLOCK_CELLS : (row.block + 1) * BLOCK_CELLS] = unpacked(row.counts)
    counts = total[: kinds * size].reshape(len(names), 2, size)
    return counts, total[kinds * size : kinds * size + kinds].reshape(len(names), 2)


def telling(counts: np.ndarray, docs: np.ndarray, least_z: float) -> np.ndarray:
    """Features whose share of documents differs between the labels by this many standard errors."""
    n0, n1 = max(docs[0], 1), max(docs[1], 1)
    pooled = (counts.sum(axis=0) + 1) / (n0 + n1 + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    z = (counts[1] / n1 - counts[0] / n0) / error
    return (np.abs(z) >= least_z) & (counts.sum(axis=0) >= 5)


def sample(rows: DataFrame, names: list[str], keep: np.ndarray, max_rows: int, bits: int):
    """Kept features and labels (-1 for null) of at most ``max_rows`` rows, those of least hash."""
    order = F.xxhash64("doc_id")
    edge = rows.select(order.alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    if edge is None:
        return [], np.zeros((0, len(names)))
    held = rows.sparkSession.sparkContext.broadcast(np.packbits(keep))

    def extract(batches):
        chosen = np.unpackbits(held.value, count=1 << bits).astype(bool)
        for batch in batches:
            for part in text_slices(batch, "text"):
                of, keys = features(part["text"], bits)
                of, keys = of[chosen[keys]], keys[chosen[keys]]
                cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
                packed = [keys[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part["h"], *[part[n].fill_null(-1) for n in names], pa.array(packed, pa.binary())],
                    names=["h", *names, "keys"],
                )

    few = rows.select(order.alias("h"), *names, "text").where(F.col("h") <= edge).mapInArrow(
        extract, ", ".join(["h long", *[f"{n} int" for n in names], "keys binary"])
    )
    found = few.orderBy("h", "keys", *names).limit(max_rows).toArrow()
    return ([np.frombuffer(k, "<i4") for k in found["keys"].to_pylist()],
            np.column_stack([found[n].to_numpy() for n in names]))


def descend(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, size: int, rounds: int = 8,
            decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, weights of earlier categories and intercept of a logistic model: adaptive gradient steps."""
    w, g = np.zeros(size), np.full(size, 1e-8)
    v, h = np.zeros(earlier.shape[1] + 1), np.full(earlier.shape[1] + 1, 1e-8)
    if len(y):
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        v[-1] = np.log(share / (1 - share))
    more = np.column_stack((earlier, np.ones(len(y))))
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            keys = rows[i]
            miss = logistic(np.array(w[keys].sum() + more[i] @ v)) - y[i]
            step = miss + decay * w[keys]
            g[keys] += step * step
            w[keys] -= 0.3 * step / np.sqrt(g[keys])
            step = miss * more[i]
            h += step * step
            v -= 0.1 * step / np.sqrt(h)
    return w, v[:-1], float(v[-1])


def fit_chain(docs: DataFrame, labels: DataFrame, chain: dict[str, str] | None = None, bits: int = BITS,
              max_rows: int = MAX_ROWS, least_z: float = LEAST_Z) -> Chain:
    """The models of all categories, learnt from labelled rows that aren't held out."""
    chain = chain or CHAIN
    names, rows = list(chain), labelled(docs, labels, chain)
    counts, totals = label_counts(rows, names, bits)
    chosen = [telling(counts[c], totals[c], least_z) for c in range(len(names))]
    keys, y = sample(rows, names, np.logical_or.reduce(chosen), max_rows, bits)
    out = Chain(bits)
    earlier = np.zeros((len(keys), 0))
    fold = np.arange(len(keys)) % FOLDS
    for c, name in enumerate(names):
        mine = [k[chosen[c][k]] for k in keys]
        known = y[:, c] >= 0
        margin = np.zeros(len(keys))
        for f in range(FOLDS):
            train = np.flatnonzero(known & (fold != f))
            link = Link(name, *descend([mine[i] for i in train], earlier[train], y[train, c], 1 << bits))
            for i in np.flatnonzero(fold == f):
                margin[i] = link.weights[mine[i]].sum() + earlier[i] @ link.before + link.intercept
        train = np.flatnonzero(known)
        out.links.append(Link(name, *descend([mine[i] for i in train], earlier[train], y[train, c], 1 << bits)))
        earlier = np.column_stack((earlier, np.clip(margin, -8, 8)))
    return out


def with_probabilities(docs: DataFrame, chain: Chain, column: str = "_categories") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(text):
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["text"])
        parts = [held.value.probabilities(part["text"]) for part in text_slices(batch, "text")]
        return pd.Series(list(np.concatenate(parts)) if parts else [], index=text.index, dtype=object)

    return docs.withColumn(column, score(F.col("text").cast("string")))


def probability(name: str, chain: dict[str, str] | None = None) -> Column:
    return F.col("_categories")[list(chain or CHAIN).index(name)]


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, poor, score, predicted); score is the probability of the last category."""
    scored = with_probabilities(docs.select("doc_id", "text"), fit_chain(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), probability("poor").alias("poor"),
        probability("toxic").alias("score"), (probability("toxic") >= THRESHOLD).cast("int").alias("predicted"),
    )
