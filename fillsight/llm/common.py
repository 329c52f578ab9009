"""Helpers shared by the document operators: Arrow text buffers, word spans, sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Text handled at once inside a task; a single longer document forms a chunk of its own.
CHUNK_BYTES = 1_000_000


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the decimal id modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of a string modulo ``modulus``."""
    return F.crc32(key.cast("binary")) % F.lit(modulus)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose text stays within ``limit`` bytes (or that are one row)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    return flat + ((flat >= 65) & (flat <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the maximal word runs of each row, and the number of words before each row."""
    n = len(is_word)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per byte span from wrapping prefix sums of powers of an odd base."""
    n = len(flat)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up = np.full(n + 1, base, np.uint64)
    down = np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    prefix = np.zeros(n + 1, np.uint64)
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    np.cumsum(mixed * up[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def map_texts(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str, keep: list[str], text: str = "text"
) -> DataFrame:
    """Row-wise columns computed from whole texts: ``keep`` columns plus those ``fn`` returns."""
    kept = df.select(*keep)
    spec = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [schema])

    def run(batches):
        for batch in batches:
            made = fn(batch)
            arrays = [batch.column(c) for c in keep] + list(made.values())
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])

    columns = list(dict.fromkeys([*keep, text]))
    return df.select(*columns).mapInArrow(run, spec)


def bounded_ids(labelled: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled rows, chosen by the order of a hash of their key."""
    return labelled.orderBy(F.xxhash64(key), F.col(key)).limit(rows)
