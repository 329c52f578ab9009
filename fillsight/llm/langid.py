"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (one to three signs, words padded by a
blank) of a language in order of their counts. A text gets the language whose profile has
the smallest out-of-place distance to its own: the sum, over the n-grams of the text's
profile, of the difference of the two ranks, or the largest one where the language lacks
the n-gram. Texts are counted whole, a chunk of texts at a time, by sorting one integer per
n-gram (text and signs), so no text or n-gram costs a Python object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fillsight.llm.common import map_texts, remainder
from fillsight.session import materialize

PROFILE = 300
# Labelled documents per language that the profiles are counted on, at most.
SAMPLE_ROWS = 3_000
CHUNK_CHARS = 500_000
UNKNOWN = "und"
_BLANK = 1
_CUT = re.compile(r"\s")
_state: dict = {}


def _letters() -> np.ndarray:
    """Lower-cased code point of every letter, the blank for all other signs."""
    if "letters" not in _state:
        table = np.full(0x110000, _BLANK, np.uint32)
        for c in chain(range(0xD800), range(0xE000, 0x110000)):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _state["letters"] = table
    return _state["letters"]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) sorted by text and gram, and the alphabet; a gram is three sign numbers."""
    joined = "\0".join(["", *texts, ""])
    code = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.append(np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]), len(texts) - 1)
    alphabet = np.unique(np.append(code, np.uint32(_BLANK)))  # the blank is its first member
    bits = int(len(alphabet)).bit_length()
    if len(texts) > 1 and 3 * bits + len(texts).bit_length() > 62:
        half = len(texts) // 2  # too many different letters for one integer: fewer texts at once
        a, b = _grams(texts[:half]), _grams(texts[half:])
        return (
            np.r_[a[0], b[0] + half], np.r_[_codes(a[1], a[3]), _codes(b[1], b[3])], np.r_[a[2], b[2]], np.zeros(0, np.uint32),
        )
    number = np.zeros(int(alphabet[-1]) + 1, np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    x = number[code]
    letter = x > 1
    top = doc.astype(np.int64) << (3 * bits)
    one = (top + x)[letter]
    two = top[:-1] + ((x[:-1] << bits) | x[1:])
    after = ~letter[:-1] & letter[1:]  # a blank before the first letter belongs to the letter's text
    two = np.where(after, two - top[:-1] + top[1:], two)[letter[:-1] | letter[1:]]
    three = (top[1:-1] + ((x[:-2] << (2 * bits)) | (x[1:-1] << bits) | x[2:]))[letter[1:-1]]
    keys = np.sort(np.concatenate([one, two, three]))
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[new, len(keys)])
    keys = keys[new]
    return keys >> (3 * bits), keys & ((1 << (3 * bits)) - 1), counts, alphabet


def _codes(grams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Grams of sign numbers as grams of code points (21 bits each), which no chunk changes."""
    if not len(alphabet):
        return grams
    bits = int(len(alphabet)).bit_length()
    signs = np.r_[np.zeros(1, np.int64), alphabet.astype(np.int64)]
    part = (1 << bits) - 1
    return (signs[grams >> (2 * bits)] << 42) | (signs[(grams >> bits) & part] << 21) | signs[grams & part]


def _profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, rank, gram) of the most frequent grams of each text; ties go to the smaller gram."""
    doc, gram, count, alphabet = _grams(texts)
    if not len(doc):
        return doc, doc, gram
    start = np.searchsorted(doc, np.arange(len(texts)))
    place = np.arange(len(doc)) - start[doc]
    if len(texts) < 1 << 18 and count.max() < 1 << 21 and place.max() < 1 << 24:
        order = np.sort((doc << 45) | (((1 << 21) - 1 - count) << 24) | place)
        order = (order & ((1 << 24) - 1)) + start[order >> 45]
    else:
        order = np.lexsort((place, -count, doc))
    doc, gram = doc[order], gram[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
    use = rank < PROFILE
    return doc[use], rank[use], _codes(gram[use], alphabet)


def _long_profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(rank, gram) of a text that is counted in several parts, cut at white space."""
    grams, counts, start = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while start < len(text):
        cut = _CUT.search(text, start + CHUNK_CHARS)
        end = cut.start() if cut else len(text)
        _, g, c, alphabet = _grams([text[start:end]])
        every, place = np.unique(np.r_[grams, _codes(g, alphabet)], return_inverse=True)
        counts = np.bincount(place, np.r_[counts, c], minlength=len(every)).astype(np.int64)
        grams, start = every, end
    order = np.lexsort((grams, -counts))[:PROFILE]
    return np.arange(len(order)), grams[order]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_profiles(texts: list[str]) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Ranges of texts with the profile entries of each."""
    for a, b in _groups(texts):
        if b - a == 1 and len(texts[a]) > 2 * CHUNK_CHARS:
            rank, gram = _long_profile(texts[a])
            yield a, b, (np.zeros(len(rank), np.int64), rank, gram)
        else:
            yield a, b, _profiles(texts[a:b])


@dataclass
class Profiles:
    """Rank of each known gram in every language (``PROFILE`` where it is missing)."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray  # (grams, languages)

    def identify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is 1 at distance zero and 0 at the largest."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for a, b, (doc, rank, gram) in text_profiles(texts):
            place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            there = np.where((self.grams[place] == gram)[:, None], self.ranks[place], PROFILE)
            apart = np.where(there < PROFILE, np.abs(there - rank[:, None]), PROFILE)
            n = b - a
            size = np.bincount(doc, minlength=n)
            total = np.stack([np.bincount(doc, apart[:, k], minlength=n) for k in range(len(self.languages))], 1)
            best = total.argmin(1)
            for i in np.flatnonzero(size):
                names[a + i] = self.languages[best[i]]
                scores[a + i] = 1 - total[i, best[i]] / (PROFILE * size[i])
        return names, scores


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles of the languages of documents outside the held-out quarter.

    Up to ``rows`` documents of each language are counted, whole, chosen by a hash of their
    id; NULL ids, languages and texts teach nothing. What comes back is ``PROFILE`` rows per
    language.
    """
    known = docs.select("doc_id", "lang").where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())
    # a hash threshold leaves about 1.2 times the rows wanted of each language to be ranked
    size = materialize(known.groupBy("lang").agg(F.count("*").alias("_size")))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = known.join(size, "lang").where(unit * F.col("_size") <= 1.2 * rows + 200)
    order = W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).select("doc_id", "lang")
    sample = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi")

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in _groups(own):
                    _, gram, n, alphabet = _grams(own[a:b])
                    every, place = np.unique(_codes(gram, alphabet), return_inverse=True)
                    total = np.bincount(place, n).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(every), pa.string()), pa.array(every), pa.array(total)], names=["lang", "gram", "n"]
                    )

    counts = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1)
    table = ranked.where(F.col("rank") < PROFILE).select("lang", "gram", "rank").collect()
    languages = sorted({r.lang for r in table})
    grams = np.array(sorted({r.gram for r in table}), np.int64)
    ranks = np.full((len(grams), len(languages)), PROFILE, np.int64)
    for r in table:
        ranks[np.searchsorted(grams, r.gram), languages.index(r.lang)] = r.rank
    return Profiles(languages, grams, ranks)


def identify(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Texts that are NULL or have no letter, and all texts where no language was learned, are
    ``und`` with score zero. A NULL id is not held out. Columns beside doc_id, text and, for
    learning, lang are not read.
    """
    profiles = profiles or train(docs)

    def run(batch):
        names, scores = profiles.identify([t or "" for t in batch.column("text").to_pylist()])
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

    found = map_texts(docs, run, "lang_pred string, score double", ["doc_id"])
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
