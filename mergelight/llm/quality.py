"""Quality classifier: a linear model on n-gram indicators scaled by Naive Bayes log-count ratios.

Features are the distinct n-grams of a document (a word, two words in a row, and the shape of
each white-space token), hashed to ``bits`` bits.  Spark counts over *all* labelled training rows
in how many documents of each label a feature occurs; the log of the ratio of the two smoothed,
normalised counts scales the indicator.  A linear model with hinge loss is then fitted by dual
coordinate descent on a bounded sample of training rows (``max_rows`` and ``max_features``, the rows
of least hash of their id), its intercept being a constant feature.  A logistic curve through the
out-of-fold margins of the sample turns margins into scores.  Scoring reads every text whole.

Defined results: a null or empty text has no features and scores by the intercept alone; repeated
rows are scored each; a null id is held out by the rule of its text ``""``; labels of unknown ids
or null labels teach nothing, several labels for one id: the least holds; with labels of one
kind only (or none) every score is that kind's share (0.5 without labels); clashing extra columns
are ignored, ``keep_good`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mergelight.llm.common import fresh_name, held_out, logistic, only_with_ids, text_slices
from mergelight.llm.words import NON_SPACE, gram_hashes, words_of
from mergelight.session import cut_lineage

BITS = 18
MAX_ROWS = 12_000
#: Features of all rows of the sample: 4 bytes each.
MAX_FEATURES = 12_000_000
THRESHOLD = 0.3
FOLDS = 3


def _shape_table() -> np.ndarray:
    """Byte classes: lower, upper, digit, beyond ASCII, space, and each other sign itself."""
    table = np.arange(256, dtype=np.uint64) + np.uint64(10)
    table[97:123], table[65:91], table[48:58], table[128:] = 1, 2, 3, 1
    return table


_SHAPES = _shape_table()


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every distinct feature of every text, sorted."""
    words = words_of(texts, NON_SPACE)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, text_of = words.hashes(), words.text_of()
    two = gram_hashes(hashes, 2)
    inside = text_of[1:] == text_of[:-1]
    ends = _SHAPES[words.raw[words.ends - 1]] * np.uint64(300) + _SHAPES[words.raw[words.starts]]
    last = _SHAPES[words.raw[np.maximum(words.ends - 3, words.starts)]]
    shape = gram_hashes((ends * np.uint64(300) + last) * np.uint64(0x9E3779B97F4A7C15), 1)
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    again = gram_hashes(np.full(len(same), 77, dtype=np.uint64), 1)
    rows = np.concatenate((text_of, text_of[1:][inside], text_of, text_of[1:][same]))
    keys = np.concatenate((hashes, two[inside], shape, again)) >> np.uint64(64 - bits)
    found = np.unique(rows * (1 << bits) + keys.astype(np.int64))
    return found >> bits, found & ((1 << bits) - 1)


@dataclass
class LinearModel:
    weights: np.ndarray
    ratios: np.ndarray
    intercept: float
    slope: float
    shift: float

    def scores(self, texts: pa.Array, bits: int) -> np.ndarray:
        rows, keys = features(texts, bits)
        values = self.ratios[keys]
        norm = np.sqrt(np.bincount(rows, values * values, minlength=len(texts)))
        margin = np.bincount(rows, self.weights[keys] * values, minlength=len(texts))
        margin = np.divide(margin, norm, out=np.zeros(len(texts)), where=norm > 0) + self.intercept
        return logistic(self.slope * margin + self.shift)


def label_counts(rows: DataFrame, label: str, bits: int) -> np.ndarray:
    """Documents of each label (0, 1) with each feature, over all rows: a 2 x 2**bits table."""

    def count(batches):
        total = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                of, keys = features(part["text"], bits)
                y = part[label].to_numpy(zero_copy_only=False)
                for kind in (0, 1):
                    total[kind] += np.bincount(keys[y[of] == kind], minlength=1 << bits)
        kind, key = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(key.astype(np.int32)), pa.array(total[kind, key])],
            names=["kind", "feature", "docs"],
        )

    parts = rows.select("text", label).mapInArrow(count, "kind int, feature int, docs long")
    total = np.zeros((2, 1 << bits))
    table = parts.groupBy("kind", "feature").agg(F.sum("docs").alias("docs")).toArrow()  # 2 x 2**bits rows at most
    total[table["kind"].to_numpy(), table["feature"].to_numpy()] = table["docs"].to_numpy()
    return total


def log_ratios(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    smooth = counts + alpha
    return np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())


@dataclass
class Sample:
    """Rows of the sample in one run of feature ids: row i has keys[ends[i] : ends[i + 1]].

    Values are made from the ratios when a row is looked at: no second copy of the rows is held.
    """

    keys: np.ndarray
    ends: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Sample:
        parts = [np.frombuffer(chunk.buffers()[2], np.uint8)[o[0] : o[-1]] if len(chunk) else np.zeros(0, np.uint8)
                 for chunk, o in ((c, _offsets(c)) for c in table["keys"].chunks)]
        sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(_offsets(c)) for c in table["keys"].chunks)])
        keys = np.concatenate(parts).view("<i4") if parts else np.zeros(0, "<i4")
        return cls(keys, np.cumsum(sizes) // 4, np.where(table["y"].to_numpy() > 0, 1.0, -1.0))

    def row(self, i: int) -> np.ndarray:
        return self.keys[self.ends[i] : self.ends[i + 1]]

    def scales(self, ratios: np.ndarray) -> np.ndarray:
        """One over the length of each row's vector of ratios; 0 where it has none."""
        norms = np.array([np.sqrt(v @ v) for v in (ratios[self.row(i)] for i in range(len(self.y)))])
        return np.divide(1.0, norms, out=np.zeros(len(norms)), where=norms > 0)


def _offsets(chunk: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(chunk.type)
    raw = np.frombuffer(chunk.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)


def dual_descent(sample: Sample, which: np.ndarray, ratios: np.ndarray, scales: np.ndarray, cost: float,
                 rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss model of some rows; one dual variable for each.

    Every step minimises the dual in one variable, clipped to [0, cost]; the rows of the rarer
    label cost as much in sum as the others.
    """
    y = sample.y[which]
    share = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    upper = cost * share
    alpha, w, b = np.zeros(len(y)), np.zeros(len(ratios)), 0.0
    square = (scales[which] > 0) + 1.0  # the length of a row is 1, or 0 without features; 1 for the intercept
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            keys = sample.row(which[i])
            values = ratios[keys] * scales[which[i]]
            slope = y[i] * (w[keys] @ values + b) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[keys] += step * values
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w, b


def fit_logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps with smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack((margin, np.ones(len(margin))))
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = logistic(x @ beta)
        grad = x.T @ (p - target) + 1e-3 * beta
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of the documents that may be learnt from."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias(label))
    known = cut_lineage(known.where(~held_out(F.col("doc_id"))).withColumn("doc_id", F.col("doc_id").cast("long")))
    return only_with_ids(docs, known).join(known, "doc_id")


def sample_rows(rows: DataFrame, label: str, max_rows: int, max_features: int, bits: int) -> Sample:
    """At most ``max_rows`` labelled rows, those of least hash, with ``max_features`` features in sum.

    Rows are taken in order of their hash while they fit, so the driver's share has a fixed size
    in rows and in bytes (4 for a feature).
    """
    order = F.xxhash64("doc_id")
    least = rows.select(order.alias("h")).orderBy("h").limit(max_rows)
    edge = least.agg(F.max("h")).first()[0]

    def extract(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                of, keys = features(part["text"], bits)
                cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
                packed = [keys[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part["h"], part[label], pa.array(packed, pa.binary())], names=["h", "y", "keys"]
                )

    few = rows.select(order.alias("h"), label, "text").where(F.col("h") <= F.lit(edge)).mapInArrow(
        extract, "h long, y int, keys binary"
    )
    few = cut_lineage(few.orderBy("h", "y", "keys").limit(max_rows))
    sizes = few.select("h", (F.octet_length("keys") / 4).alias("n")).orderBy("h").toPandas()  # max_rows rows
    fits = sizes["n"].cumsum() <= max_features
    if not fits.all():
        few = few.where(F.col("h") < F.lit(int(sizes["h"][~fits].iloc[0])))
    return Sample.of(few.orderBy("h", "y", "keys").toArrow())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS,
        max_features: int = MAX_FEATURES, cost: float = 1.0) -> LinearModel:
    """The model, learnt from labelled rows that aren't held out."""
    rows = labelled(docs, labels, label)
    ratios = log_ratios(label_counts(rows, label, bits))
    sample = sample_rows(rows, label, max_rows, max_features, bits)
    y = sample.y
    if len(set(y.tolist())) < 2:
        share = 0.5 if not len(y) else (1 - 1e-6 if y[0] > 0 else 1e-6)
        return LinearModel(np.zeros(1 << bits), ratios, 0.0, 0.0, float(np.log(share / (1 - share))))
    scales = sample.scales(ratios)
    margin = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for f in range(FOLDS):
        w, b = dual_descent(sample, np.flatnonzero(fold != f), ratios, scales, cost)
        for i in np.flatnonzero(fold == f):
            keys = sample.row(i)
            margin[i] = (w[keys] @ ratios[keys]) * scales[i] + b
    w, b = dual_descent(sample, np.arange(len(y)), ratios, scales, cost)
    slope, shift = fit_logistic(margin, y)
    return LinearModel(w, ratios, b, slope, shift)


def with_scores(docs: DataFrame, model: LinearModel, column: str = "_score", bits: int = BITS) -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        out, batch = [np.zeros(0)], pa.RecordBatch.from_arrays([text], names=["text"])
        for part in text_slices(batch, "text"):
            out.append(held.value.scores(part["text"], bits))
        return pa.array(np.concatenate(out))

    return docs.withColumn(column, score(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score at least ``threshold``."""
    score = fresh_name(docs, "_score")
    return with_scores(docs, fit(docs, labels), score).where(F.col(score) >= threshold).drop(score)
