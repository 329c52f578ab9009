"""Shards of bounded size by extendible hashing, in DataFrame functions only.

The directory is indexed by the leading bits of a key's hash. A bucket whose documents
exceed the byte limit is split on its next bit, and only such a bucket: the shard of a
document is the shortest prefix of its hash whose bucket fits. Bytes are summed per
``STEP`` bits for the buckets still too large, so each round is one aggregation of
(prefix, bytes) and a join of the rest; documents themselves are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fillsight.session import materialize

LIMIT_BYTES = 1_000_000
STEP = 8
BITS = 128


def hash_bits() -> Column:
    """128 bits of a row's id and text, as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def _binary(hex_digits: Column) -> Column:
    """Bits of hex digits as a string of 0 and 1."""
    pairs = F.transform(F.split(hex_digits, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    return F.array_join(pairs, "")


def directory(keys: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(hash, shard, depth, shard_bytes) for ``keys`` (hash, bytes): different hashes, none over the limit."""
    left, done, depth = keys, [], 0
    while True:
        upto = depth + STEP
        prefix = F.substring("hash", 1, upto // 4)
        # one row per prefix of `upto` bits within the buckets that must be split
        cells = materialize(left.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("bytes")).withColumn("bits", _binary(F.col("p"))))
        levels = F.sequence(F.lit(depth + (depth > 0)), F.lit(upto))
        each = cells.select("p", "bytes", "bits", F.explode(levels).alias("depth")).withColumn("shard", F.expr("substring(bits, 1, depth)"))
        fits = each.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
        shortest = F.min(F.struct("depth", "shard", "shard_bytes")).alias("s")
        chosen = materialize(each.join(fits, ["depth", "shard"]).groupBy("p").agg(shortest).select("p", "s.*"))
        here = left.withColumn("p", prefix)
        done.append(here.join(chosen, "p").select("hash", "shard", "depth", "shard_bytes"))
        if upto >= BITS or chosen.count() == cells.count():
            return reduce(DataFrame.union, done)
        left = materialize(here.join(chosen, "p", "left_anti").drop("p"))
        depth = upto


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, overflow for every row of ``docs``.

    shard is the bit prefix ('' is the undivided root). NULL and empty texts have no bytes, a
    NULL id counts as an empty one. A document over the limit, and equal rows that together
    exceed it, cannot be divided by their hash: they get overflow pages named by their hash,
    part and page, each of one document or of equal ones within the limit.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = materialize(docs.select("doc_id", hash_bits().alias("hash"), size.alias("n_bytes")).withColumn("part", F.spark_partition_id()))
    # equal hashes are equal rows: they are placed as one
    keys = materialize(rows.groupBy("hash").agg(F.sum("n_bytes").alias("bytes")))
    over = F.col("bytes") > limit
    placed = rows.join(directory(keys.where(~over), limit), "hash").select(
        "doc_id", "n_bytes", "shard", "depth", "shard_bytes", F.lit(False).alias("overflow")
    )
    # rows of one hash and input part are numbered, so that no task holds all copies of a row
    numbered = rows.join(keys.where(over).select("hash"), "hash", "left_semi").withColumn(
        "k", F.row_number().over(W.partitionBy("hash", "part").orderBy("doc_id")) - 1
    )
    per_page = F.greatest(F.floor(F.lit(limit) / F.col("n_bytes")), F.lit(1))
    paged = numbered.withColumn("shard", F.concat_ws("/", "hash", "part", F.floor(F.col("k") / per_page)))
    pages = paged.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    overflow = paged.join(pages, "shard").select("doc_id", "n_bytes", "shard", F.lit(BITS).alias("depth"), "shard_bytes", F.lit(True))
    return placed.union(overflow)
