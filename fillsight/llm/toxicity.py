"""Toxicity scores of a bidirectional gated recurrent network with attention pooling.

Every text is cut into overlapping windows of words, all of which are scored; the score of
the text is that of its most toxic window. Windows start every half window, so a passage of
up to ``WINDOW`` - ``STRIDE`` + 1 words is whole in one of them wherever it stands. A word enters as the sum of two embeddings, one
of the word itself (if frequent in the training sample) and one of its hashed character
n-grams. Training is numpy, on a bounded sample: labels belong to whole texts, so a toxic
text teaches through the window that the model finds most toxic, a clean one through its
highest and through random ones; before the first round the prior odds of words and
n-grams stand in for the model.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fillsight.llm.common import bounded_ids, lower_ascii, map_texts, remainder, row_chunks, span_hash, text_buffer, word_spans

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 8, 8
GRAM_BUCKETS = 1 << 14
# Labelled rows of each class that the network is trained on. A longer text than SAMPLE_CHARS
# teaches through passages drawn over its whole length, so the sample is bounded.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 40_000
PASSAGE_CHARS = 2_000
MIN_COUNT = 5
ROUNDS = 4
MIN_STEPS = 100  # updates, where the sample is small
THRESHOLD = 0.3
_BLOCK = 4_096  # windows scored at once


@dataclass
class Words:
    """Words of a chunk of texts: the different ones with their n-grams, and windows over them."""

    hashes: np.ndarray
    grams: np.ndarray  # buckets of the n-grams of all different words, one after the other
    first: np.ndarray  # where each word's n-grams begin
    place: np.ndarray  # different word of every word
    before: np.ndarray  # words before each text


def read_words(flat: np.ndarray, offsets: np.ndarray) -> Words:
    low = lower_ascii(flat)
    is_word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    starts, ends, before = word_spans(is_word, offsets)
    hashes, first, place = np.unique(span_hash(low, starts, ends), return_index=True, return_inverse=True)
    starts, length = starts[first], (ends - starts)[first]
    # each different word between two marks, then hashes of 3 and 5 bytes from every position
    to = np.cumsum(length + 2) - (length + 2)
    padded = np.full(int((length + 2).sum()) + 4, 1, np.uint64)
    inside = np.repeat(starts - to - 1, length) + (np.arange(int(length.sum())) + np.repeat(to + 1 - (np.cumsum(length) - length), length))
    padded[np.arange(len(inside)) + np.repeat(to + 1 - (np.cumsum(length) - length), length)] = low[inside]
    three = padded[:-4] + padded[1:-3] * np.uint64(257) + padded[2:-2] * np.uint64(66049)
    five = (three + padded[3:-1] * np.uint64(16974593) + padded[4:] * np.uint64(4362470401)) * np.uint64(0x9E3779B97F4A7C15)
    three = three * np.uint64(0xBF58476D1CE4E5B9)
    half = np.uint64(GRAM_BUCKETS // 2)
    pairs = np.stack([(three >> np.uint64(40)) % half, (five >> np.uint64(40)) % half + half], 1).astype(np.int64)
    # a word of n bytes has n positions for its n-grams; the two marks after it begin none
    keep = np.arange(int(length.sum())) + np.repeat(to - (np.cumsum(length) - length), length)
    return Words(hashes, pairs[keep].ravel(), 2 * (np.cumsum(length) - length), place, before)


def windows(before: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of all windows; a text without words has none."""
    n = np.diff(before)
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = before[text] + step * STRIDE
    return text, start, np.minimum(WINDOW, before[text + 1] - start)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scatter(rows: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` per index."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        sorted_ = index[order]
        cut = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        out[sorted_[cut]] = np.add.reduceat(values[order], cut, axis=0)
    return out


class Network:
    """Parameters and passes; the last row of a projected word table is the empty place."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, 2 * EMBED

        def init(*shape, scale=None):
            return (r.normal(size=shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

        self.vocabulary = vocabulary  # sorted hashes; row 0 of the word table is every other word
        self.p = {
            "word": init(len(vocabulary) + 1, EMBED, scale=0.1), "gram": init(GRAM_BUCKETS, EMBED, scale=0.05),
            "in": init(d, 6 * h), "bias": np.zeros(6 * h, np.float32),
            "rz0": init(h, 2 * h), "n0": init(h, h), "rz1": init(h, 2 * h), "n1": init(h, h),
            "att": init(2 * h, h), "look": init(h), "out": init(2 * h), "base": np.full(1, -2, np.float32),
        }
        self.p["word"][0] = 0

    def lookup(self, words: Words) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(words.hashes), np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == words.hashes, place + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        out = np.empty((len(words.first), 2 * EMBED), self.p["gram"].dtype)
        out[:, :EMBED] = self.p["word"][self.lookup(words)]
        ends = np.r_[words.first[1:], len(words.grams)]
        for a in range(0, len(out), 20_000):
            first = words.first[a : a + 20_000]
            grams = self.p["gram"][words.grams[first[0] : ends[min(a + 20_000, len(out)) - 1]]]
            out[a : a + 20_000, EMBED:] = np.add.reduceat(grams, first - first[0], axis=0)
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["in"] + self.p["bias"], np.zeros((1, 6 * HIDDEN), np.float32)])

    def _run(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, way: int, keep: list | None) -> np.ndarray:
        """Hidden states (windows, places, HIDDEN) of one direction."""
        h = HIDDEN
        rz, nn = self.p[f"rz{way}"], self.p[f"n{way}"]
        state = np.zeros((len(index), h), np.float32)
        out = np.zeros((len(index), WINDOW, h), np.float32)
        own = np.ascontiguousarray(gates[:, 3 * h * way : 3 * h * (way + 1)])
        for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
            x = own[index[:, t]]
            g = _sigmoid(x[:, : 2 * h] + state @ rz)
            r, z = g[:, :h], g[:, h:]
            inner = state @ nn
            n = np.tanh(x[:, 2 * h :] + r * inner)
            m = mask[:, t : t + 1]
            new = np.where(m, (1 - z) * n + z * state, state)
            if keep is not None:
                keep.append((t, state, r, z, n, inner, m))
            state = new
            out[:, t] = state
        return out

    def forward(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows given as rows of word places."""
        steps = ([], []) if keep is not None else (None, None)
        hidden = np.concatenate([self._run(gates, index, mask, way, steps[way]) for way in (0, 1)], 2)
        look = np.tanh(hidden @ self.p["att"])
        score = np.where(mask, look @ self.p["look"], -1e9)
        weight = np.exp(score - score.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", weight, hidden)
        if keep is not None:
            keep.update(steps=steps, hidden=hidden, look=look, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["base"][0]

    def backward(self, keep: dict, index: np.ndarray, mask: np.ndarray, error: np.ndarray, places: int) -> dict:
        """Gradients of the recurrent part; ``gates`` holds that of the projected words."""
        h, p = HIDDEN, self.p
        hidden, look, weight, pooled = keep["hidden"], keep["look"], keep["weight"], keep["pooled"]
        g = {"out": pooled.T @ error, "base": error.sum(keepdims=True)}
        d_pooled = error[:, None] * p["out"]
        d_hidden = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("bh,bth->bt", d_pooled, hidden)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True)) * mask
        g["look"] = np.einsum("bt,bth->h", d_score, look)
        d_look = d_score[:, :, None] * p["look"] * (1 - look**2)
        g["att"] = np.einsum("bth,btk->hk", hidden, d_look)
        d_hidden += d_look @ p["att"].T
        d_gates = np.zeros((*index.shape, 6 * h), d_pooled.dtype)
        for way in (0, 1):
            rz, nn = p[f"rz{way}"], p[f"n{way}"]
            g_rz, g_n = np.zeros_like(rz), np.zeros_like(nn)
            d_state = np.zeros((len(index), h), np.float32)
            for t, state, r, z, n, inner, m in reversed(keep["steps"][way]):
                d = d_state + d_hidden[:, t, way * h : (way + 1) * h]
                dn = np.where(m, d * (1 - z), 0) * (1 - n**2)
                dz = np.where(m, d * (state - n), 0) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                d_rz = np.concatenate([dr, dz], 1)
                g_rz += state.T @ d_rz
                g_n += state.T @ (dn * r)
                d_state = np.where(m, d * z, d) + d_rz @ rz.T + (dn * r) @ nn.T
                d_gates[:, t, 3 * h * way : 3 * h * (way + 1)] = np.concatenate([d_rz, dn], 1)
            g[f"rz{way}"], g[f"n{way}"] = g_rz, g_n
        g["gates"] = _scatter(places + 1, index.ravel(), d_gates.reshape(-1, 6 * h))
        return g

    def window_scores(self, words: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        gates = self.project(self.inputs(words))
        out = np.zeros(len(start), np.float32)
        for a in range(0, len(start), _BLOCK):
            index, mask = _places(words, start[a : a + _BLOCK], size[a : a + _BLOCK])
            out[a : a + _BLOCK] = self.forward(gates, index, mask)
        return out

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text; one without words has zero."""
        words = read_words(flat, offsets)
        text, start, size = windows(words.before, len(words.place))
        best = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(best, text, self.window_scores(words, start, size))
        return np.where(np.isneginf(best), 0, _sigmoid(best))


def _places(words: Words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(WINDOW)
    mask = at < size[:, None]
    where = np.minimum(start[:, None] + at, len(words.place) - 1)
    return np.where(mask, words.place[where], len(words.hashes)), mask


def _sample_words(flat: np.ndarray, offsets: np.ndarray) -> Words:
    """``read_words`` of all texts, a chunk at a time."""
    parts = [read_words(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_chunks(offsets)]
    hashes, first, place = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
    lengths = np.concatenate([np.diff(np.r_[p.first, len(p.grams)]) for p in parts])
    starts = np.cumsum(lengths) - lengths
    grams, n = np.concatenate([p.grams for p in parts]), lengths[first]
    base = np.cumsum(np.r_[0, [len(p.hashes) for p in parts]])
    return Words(
        hashes, grams[_ranges(starts[first], n)], np.cumsum(n) - n,
        np.concatenate([place[p.place + o] for p, o in zip(parts, base)]),
        np.r_[0, np.cumsum(np.concatenate([np.diff(p.before) for p in parts]))],
    )


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _odds(words: Words, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that hold each word, and the shrunken log odds of toxic for words and n-grams."""
    texts, lengths = len(toxic), np.diff(np.r_[words.first, len(words.grams)])
    seen = [np.zeros((2, len(words.hashes))), np.zeros((2, GRAM_BUCKETS))]

    def add(to, kind, text):
        pairs = np.sort(kind.astype(np.int64) * texts + text)
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        kind, text = pairs // texts, pairs % texts
        to[0] += np.bincount(kind, minlength=to.shape[1])
        to[1] += np.bincount(kind, toxic[text], minlength=to.shape[1])
        return kind, text

    step = 50_000  # words; a text is never divided, so it counts once per kind
    cuts = np.unique(np.r_[np.searchsorted(words.before, np.arange(0, words.before[-1], step)), texts])
    for a, b in zip(cuts[:-1], cuts[1:]):
        text = np.repeat(np.arange(a, b), np.diff(words.before[a : b + 1]))
        if len(text):
            kind, text = add(seen[0], words.place[words.before[a] : words.before[b]], text)
            add(seen[1], words.grams[_ranges(words.first[kind], lengths[kind])], np.repeat(text, lengths[kind]))
    share = toxic.mean()
    odds = [np.log((bad + 5 * share) / (every - bad + 5 * (1 - share)) * (1 - share) / share) for every, bad in seen]
    return seen[0][0], odds[0], odds[1]


def fit(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> Network | float:
    """The trained network, or the share of toxic texts where only one class is there."""
    toxic = np.asarray(toxic, float)
    if not len(toxic) or toxic.min() == toxic.max():
        return float((toxic.sum() + 0.5) / (len(toxic) + 1)) if len(toxic) else 0.0
    flat, offsets = text_buffer(pa.array(texts, pa.large_string()))
    words = _sample_words(flat, offsets)
    lengths = np.diff(np.r_[words.first, len(words.grams)])
    count, word_odds, gram_odds = _odds(words, toxic)
    known = count >= MIN_COUNT
    net = Network(words.hashes[known], seed)
    net.p["word"][1:, 0] = word_odds[known]
    net.p["gram"][:, 0] = gram_odds / 4
    text, start, size = windows(words.before, len(words.place))
    prior = np.where(known, word_odds, 0) + np.maximum.reduceat(gram_odds[words.grams], words.first)
    index, mask = _places(words, start, size)
    score = np.where(mask, np.append(prior, -9)[index], -9).max(1)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, rate = 0, 0.01
    while rounds > 0 or step < MIN_STEPS:
        rounds -= 1
        order = np.lexsort((-score, text))
        top = order[np.flatnonzero(np.r_[True, text[order][1:] != text[order][:-1]])]
        clean = np.flatnonzero(toxic[text] == 0)
        some = rng.choice(clean, min(len(clean), 2 * len(top)), replace=False)
        use = rng.permutation(np.r_[top, some])
        for a in range(0, len(use), 256):
            batch = use[a : a + 256]
            idx, msk = index[batch], mask[batch]
            kinds, local = np.unique(idx, return_inverse=True)
            local = local.reshape(idx.shape)
            real = kinds[kinds < len(words.hashes)]
            sub_len = lengths[real]
            grams = words.grams[_ranges(words.first[real], sub_len)]
            sub = Words(words.hashes[real], grams, np.cumsum(sub_len) - sub_len, local, words.before)
            x = net.inputs(sub)
            keep: dict = {}
            logit = net.forward(net.project(x), local, msk, keep)
            error = ((_sigmoid(logit) - toxic[text[batch]]) / len(batch)).astype(np.float32)
            g = net.backward(keep, local, msk, error, len(real))
            d_gates = g.pop("gates")[: len(real)]
            g["in"], g["bias"] = x.T @ d_gates, d_gates.sum(0)
            d_x = d_gates @ net.p["in"].T
            g["word"] = _scatter(len(net.p["word"]), net.lookup(sub), d_x[:, :EMBED])
            g["word"][0] = 0
            g["gram"] = _scatter(GRAM_BUCKETS, grams, np.repeat(d_x[:, EMBED:], sub_len, axis=0))
            step += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.p[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        score = net.window_scores(words, start, size)
    return net


def drawn_passages(text: str) -> str:
    """The text, or passages of it in order: cut at blanks, chosen by the hash of their place."""
    if len(text) <= SAMPLE_CHARS:
        return text
    cuts, at = [0], PASSAGE_CHARS
    while at < len(text):
        blank = text.find(" ", at)
        if blank < 0 or blank - cuts[-1] > 2 * PASSAGE_CHARS:
            blank = at  # no blank near: a passage of bounded length all the same
        cuts.append(blank)
        at = blank + PASSAGE_CHARS
    places = sorted(range(len(cuts)), key=lambda i: crc32(str(i).encode()))[: SAMPLE_CHARS // (2 * PASSAGE_CHARS)]
    return " ".join(text[cuts[i] : (cuts + [len(text)])[i + 1]] for i in sorted(places))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network | float:
    """Fit on at most ``rows`` labelled rows of each class outside the held-out quarter.

    Rows with a NULL id, NULL text or NULL label are no examples. Rows equal in id and text count
    once; where ids repeat with different texts, ``rows`` of each class are chosen among all.
    """
    known = labels.select("doc_id", F.col("toxic").alias("_y")).where(F.col("_y").isNotNull() & (remainder("doc_id", 4) != 2))
    chosen = bounded_ids(known.where("_y = 1"), rows).union(bounded_ids(known.where("_y <> 1"), rows))
    labelled = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", (F.col("_y") == 1).cast("int").alias("_y"))
    )

    def draw(batches):
        for b in batches:
            texts = pa.array([drawn_passages(t) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, b.column("_y")], names=["doc_id", "text", "_y"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    short = labelled.mapInArrow(draw, f"doc_id {kind}, text string, _y int").withColumn("_h", F.xxhash64("doc_id", "text"))
    short = short.dropDuplicates(["_h", "_y"])
    sample = short.where("_y = 1").orderBy("_h").limit(rows).unionByName(short.where("_y = 0").orderBy("_h").limit(rows))
    table = sample.toArrow()
    ids, texts, y = (table.column(c).to_pylist() for c in ("doc_id", "text", "_y"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i], y[i]))
    return fit([texts[i] for i in order], np.array([y[i] for i in order]))


def batch_scores(model: Network | float, column: pa.Array) -> np.ndarray:
    flat, offsets = text_buffer(column)
    if isinstance(model, float):
        return np.full(len(offsets) - 1, model)
    parts = [model.scores(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_chunks(offsets)]
    return np.concatenate(parts).astype(float) if parts else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame, model: Network | float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    NULL texts and texts without a word have score zero (or the base rate, where only one
    class was there to learn from). A NULL id is not held out. Other columns are not read.
    """
    model = train(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, set by the sample and table sizes
    scored = map_texts(docs, lambda b: {"score": pa.array(batch_scores(shared.value, b.column("text")))}, "score double", ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
