"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

Two fingerprints within radius r agree on at least one of r + 1 blocks of their bits, so
every fingerprint is dealt to one shard per block value and a link is found in some shard.
A shard with more than ``MAX_SHARD`` different fingerprints is divided again in the same
way over the bits that are still free, until it fits: a shard whose free bits are at most
``log2(MAX_SHARD)`` cannot be larger. Each shard builds one BK-tree (children keyed by
their integer distance to the parent) and follows only the edges within the radius. The
trees stay with their shards: all trees together grow with the corpus, so they are not
broadcast whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fillsight.llm.common import lower_ascii, map_texts, row_chunks, text_buffer, word_spans
from fillsight.llm.components import connected_components
from fillsight.session import materialize

WORDS = 3
SEED = 42
RADIUS = 2
MAX_SHARD = 512
_BLOCK = 100_000  # shingles whose bits are unpacked at once


def _fingerprints(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    starts, ends, before = word_spans(~space, offsets)
    if not len(starts):
        return np.zeros(rows, np.uint64)
    # words of the chunk joined by single spaces: a shingle is then one slice
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - (lengths + 1)
    joined = np.full(int(to[-1] + lengths[-1] + 1), 32, np.uint8)
    shift = np.repeat(to - starts, lengths)
    source = np.flatnonzero(~space)
    joined[source + shift] = lower_ascii(flat[source])
    words = np.diff(before)
    count = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    base = np.cumsum(count) - count
    first = np.repeat(before[:-1] - base, count) + np.arange(int(count.sum()))
    last = first + np.repeat(np.minimum(words, WORDS), count) - 1
    view, begin, end = joined.tobytes(), to[first], to[last] + lengths[last]
    bits = np.zeros((rows, 64), np.int64)
    doc = np.repeat(np.arange(rows), count)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(first), _BLOCK):
        hi = min(lo + _BLOCK, len(first))
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begin[lo:hi].tolist(), end[lo:hi].tolist())], np.uint64)
        set_bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        d = doc[lo:hi]
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        bits[d[cut]] += np.add.reduceat(set_bits, cut, axis=0, dtype=np.int64)
    on = (2 * bits > count[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1).view(">u8").ravel().astype(np.uint64)


def batch_fingerprints(column: pa.Array) -> np.ndarray:
    flat, offsets = text_buffer(column)
    parts = [_fingerprints(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``fp`` (the 64 bits as a bigint); no words give zero."""
    return map_texts(docs, lambda b: {"fp": pa.array(batch_fingerprints(b.column("text")).view(np.int64))}, "fp bigint", keep)


class BKTree:
    """Integers under Hamming distance; a child hangs on the edge of its distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the stored values at most ``radius`` away."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found

    def add(self, value: int) -> int:
        new, node = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[node] ^ value).bit_count()
            child = self.children[node].get(d)
            if child is None:
                self.children[node][d] = new
                break
            node = child
        return new


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, smaller value) links that join the values of one shard within the radius."""
    tree, parent = BKTree(), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        near = tree.within(value, radius)
        me = tree.add(value)
        parent.append(me)
        for other in near:
            a, b = root(me), root(other)
            if a != b:
                lo, hi = (a, b) if tree.values[a] < tree.values[b] else (b, a)
                parent[hi] = lo
    return [(v, tree.values[root(i)]) for i, v in enumerate(tree.values) if root(i) != i]


def _deal(df: DataFrame, radius: int) -> DataFrame:
    """One row per block of the free bits: its value joins the shard's path, the rest stays free."""
    parts = radius + 1
    sizes = [f"int((nbits + {parts - 1 - i}) div {parts})" for i in range(parts)]
    rows = []
    for i in range(parts):
        above = " + ".join(sizes[:i]) or "0"
        rows.append(f"struct({i} AS block, int({above}) AS low, {sizes[i]} AS size)")
    dealt = df.withColumn("_b", F.explode(F.array(*[F.expr(r) for r in rows])))
    value = "(shiftrightunsigned(free, _b.low) & (shiftleft(1L, _b.size) - 1))"
    rest = "(free & (shiftleft(1L, _b.low) - 1)) | shiftleft(shiftrightunsigned(shiftrightunsigned(free, _b.low), _b.size), _b.low)"
    return dealt.select(
        "fp",
        F.expr(f"concat(path, '/', _b.block, ':', hex({value}))").alias("path"),
        F.expr(rest).alias("free"),
        F.expr("nbits - _b.size").alias("nbits"),
    )


def shards(distinct: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """(path, fp): every pair of fingerprints within the radius shares a path."""
    pending = _deal(distinct.select("fp", F.lit("").alias("path"), F.col("fp").alias("free"), F.lit(64).alias("nbits")), radius)
    done = None
    while True:
        large = materialize(pending.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > max_shard).select("path"))
        if large.isEmpty():
            small = pending.select("path", "fp")
            return small if done is None else done.union(small)
        small = pending.join(large, "path", "left_anti").select("path", "fp")
        done = small if done is None else done.union(small)
        pending = _deal(pending.join(large, "path", "left_semi"), radius)


def links(distinct: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the radius of each other."""
    dealt = shards(distinct, radius, max_shard)

    def run(batches):
        path, values = None, []

        def closed():
            return shard_links([v & 0xFFFFFFFFFFFFFFFF for v in values], radius) if len(values) > 1 else []

        for batch in batches:
            out = []
            for p, v in zip(batch.column("path").to_pylist(), batch.column("fp").to_pylist()):
                if p != path:
                    out += closed()
                    path, values = p, []
                values.append(v)
            yield _edges(out)
        yield _edges(closed())

    return dealt.repartition("path").sortWithinPartitions("path").mapInArrow(run, "a bigint, b bigint").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])


def near_duplicates(fps: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """(fp, root, component_id) per fingerprint of ``fps`` (doc_id, fp).

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits; rows
    with a NULL doc_id take part, and a component of only such rows has a NULL id.
    """
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    roots = connected_components(links(distinct.select("fp"), radius, max_shard))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = materialize(linked)
    smallest = linked.groupBy("root").agg(F.min("_first").alias("component_id"))
    return linked.join(smallest, "root").select("fp", "root", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    NULL, empty and blank texts have fingerprint zero and are linked like any other; repeated
    rows each get a result; other columns are not read.
    """
    fps = materialize(fingerprints(docs, ["doc_id"]))
    return fps.join(near_duplicates(fps), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, all columns: the one with the smallest doc_id.

    Groups are those of ``near_duplicates`` (3-word shingles, 2 bits): near copies further apart
    all stay. README gives the share of planted copies that is caught.

    Between rows that repeat this doc_id, the smallest text hash decides; of equal rows one stays.
    """
    key, text = F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")
    fps = materialize(fingerprints(docs.select("doc_id", "text", text.alias("_h")), ["doc_id", "_h"]))
    kept = (
        fps.join(near_duplicates(fps), "fp").groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), key.alias("k"), F.col("_h").alias("h"))).alias("s"))
        .select(F.col("s.k").alias("_simhash_key"), F.col("s.h").alias("_simhash_text"))
    )
    names = ["_simhash_key", "_simhash_text"]
    # whole rows travel in one column, so no column of theirs can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias(names[0]), text.alias(names[1]))
    return packed.join(kept, names, "left_semi").dropDuplicates(names).select("row.*")
