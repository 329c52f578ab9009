"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the bytes of whole texts with vectorised numpy. The trees
are grown level by level on binned columns, then flattened into arrays (feature,
threshold, value) so that scoring is a few gathers per level for all rows and trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fillsight.llm.common import (
    bounded_ids, lower_ascii, map_texts, remainder, row_chunks, span_hash, text_buffer, word_spans,
)

# Labelled documents the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

_CLASSES = (
    ("upper", lambda b: (b >= 65) & (b <= 90)),
    ("lower", lambda b: (b >= 97) & (b <= 122)),
    ("digit", lambda b: (b >= 48) & (b <= 57)),
    ("high", lambda b: b >= 128),
    ("space", lambda b: b == 32),
    ("newline", lambda b: b == 10),
    ("control", lambda b: (b < 32) & (b != 10)),
    ("exclaim", lambda b: b == 33),
    ("pipe", lambda b: b == 124),
    ("stop", lambda b: (b == 46) | (b == 44)),
    ("bracket", lambda b: np.isin(b, np.frombuffer(b"()[]{}<>", np.uint8))),
    ("symbol", lambda b: np.isin(b, np.frombuffer(b"#$%&*+/=@\\^_`~", np.uint8))),
)
FEATURES = tuple(f"share_{n}" for n, _ in _CLASSES) + (
    "log_bytes", "log_words", "mean_word", "distinct_words", "distinct_lines", "longest_word", "repeated_byte",
    "word_symbols", "top_word",
)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(doc: np.ndarray, keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of different keys, and count of the most frequent one."""
    if not len(keys):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(k)))
    top = np.zeros(rows)
    np.maximum.at(top, d[first], runs)
    return np.bincount(d[first], minlength=rows).astype(float), top


def statistics(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per document; an empty text gives zeros."""
    rows, size = len(offsets) - 1, np.diff(offsets).astype(float)
    out = np.zeros((rows, len(FEATURES)))
    scale = 1 / np.maximum(size, 1)
    for j, (_, test) in enumerate(_CLASSES):
        out[:, j] = _sums(test(flat), offsets) * scale
    j = len(_CLASSES)
    is_word = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    starts, ends, before = word_spans(is_word, offsets)
    words = np.diff(before).astype(float)
    doc = np.repeat(np.arange(rows), np.diff(before))
    length = (ends - starts).astype(float)
    longest = np.zeros(rows)
    np.maximum.at(longest, doc, length)
    low = lower_ascii(flat)
    different, top = _distinct(doc, span_hash(low, starts, ends), rows)
    ls, le, lb = word_spans(flat != 10, offsets)
    lines = np.diff(lb).astype(float)
    line_kinds, _ = _distinct(np.repeat(np.arange(rows), np.diff(lb)), span_hash(low, ls, le), rows)
    same = np.zeros(len(flat), bool)
    same[1:] = flat[1:] == flat[:-1]
    same[offsets[:-1][size > 0]] = False
    odd = (flat < 128) & ~(((low >= 97) & (low <= 122)) | ((flat >= 48) & (flat <= 57)) | ~is_word)
    last_odd = odd[ends - 1] if len(ends) else np.zeros(0, bool)
    out[:, j] = np.log1p(size)
    out[:, j + 1] = np.log1p(words)
    out[:, j + 2] = np.bincount(doc, length, minlength=rows) / np.maximum(words, 1)
    out[:, j + 3] = different / np.maximum(np.sqrt(words), 1)
    out[:, j + 4] = line_kinds / np.maximum(lines, 1)
    out[:, j + 5] = np.log1p(longest)
    out[:, j + 6] = _sums(same, offsets) * scale
    out[:, j + 7] = np.bincount(doc, last_odd, minlength=rows) / np.maximum(words, 1)
    out[:, j + 8] = top / np.maximum(words, 1)
    return out


def batch_statistics(column: pa.Array) -> np.ndarray:
    flat, offsets = text_buffer(column)
    parts = [statistics(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_chunks(offsets)]
    return np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays; inner nodes hold (feature, threshold)."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # same shape; rows above it go right
    value: np.ndarray  # (trees, 2**depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if self.value.size else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
    l2: float = 1.0, min_child: float = 2.0,
) -> Trees:
    """Logistic boosting on binned columns. With no rows or one class the base rate is the model."""
    n = len(y)
    rate_of_ones = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    k = x.shape[1]
    flat = binned + np.arange(k) * bins  # (rows, columns): cell of the histogram
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (k * bins) + flat).ravel()
            shape = (width, k, bins)
            gs = np.bincount(cell, np.repeat(g, k), minlength=width * k * bins).reshape(shape).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, k), minlength=width * k * bins).reshape(shape).cumsum(2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < min_child) | (ht - hs < min_child)] = 0
            flatgain = gain.reshape(width, -1)
            best = flatgain.argmax(1)
            for w in range(width):
                c, b = divmod(int(best[w]), bins)
                if flatgain[w, best[w]] > 1e-6 and b < len(cuts[c]):
                    feature[first + w], threshold[first + w] = c, cuts[c][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + l2)
        margin += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled rows outside the held-out fifth.

    Rows with a NULL id, NULL text or NULL label are no examples; rows equal in id, label and
    statistics count once.
    """
    known = labels.select("doc_id", F.col("quality").alias("_y")).where(
        F.col("_y").isNotNull() & (remainder("doc_id", 5) != 0)
    )
    chosen = F.broadcast(bounded_ids(known, rows))  # at most `rows` pairs of numbers
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")

    def features(batch):
        x = batch_statistics(batch.column("text"))
        return {f"x{j}": pa.array(x[:, j]) for j in range(x.shape[1])}

    spec = ", ".join(f"x{j} double" for j in range(len(FEATURES)))
    # a labelled id may stand on any number of rows
    found = map_texts(sample, features, spec, ["doc_id", "_y"]).dropDuplicates()
    table = found.orderBy(F.xxhash64(*found.columns)).limit(rows).toArrow()
    x = np.column_stack([table.column(f"x{j}").to_numpy() for j in range(len(FEATURES))])
    y, ids = table.column("_y").to_numpy().astype(float), table.column("doc_id").to_numpy()
    order = np.lexsort((*x.T, y, ids))  # the fit does not depend on the order of arrival
    return fit(x[order], y[order])


def scores(docs: DataFrame, model: Trees, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and the score of each whole text (NULL and empty texts score as empty)."""
    return map_texts(docs, lambda b: {name: pa.array(model.score(batch_statistics(b.column("text"))))}, f"`{name}` double", keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Each row gets one result, repeated ids included; a NULL id is not held out. Other
    columns of ``docs``, whatever their names, are not read.
    """
    scored = scores(docs, train(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, model: Trees | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    model = model or train(docs, labels)
    score = "_quality_score"
    while score in docs.columns:
        score += "_"
    return scores(docs, model, docs.columns, score).where(F.col(score) >= THRESHOLD).drop(score)
