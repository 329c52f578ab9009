"""Exact top-k inner products: norm-sorted candidates, SVD-rotated partial sums.

Candidates are cut into ranges of length, the longest vectors first, every range about
twice as large as the one before. A range is scored by groups of its rows; each group holds
its candidates and lets the queries pass. What a query has found so far gives its floor, the
k-th best score, and a later range receives only the queries whose length times the longest
candidate of the range reaches their floor.

Inside a group, candidates come by descending length in chunks. Vectors are rotated by the
right singular vectors of a bounded sample, so that leading dimensions carry most of a
product; after each partial sum the Cauchy-Schwarz bound (partial sum plus the product of
the residual lengths) drops the pairs that cannot reach the query's floor, and the group
ends where full lengths cannot reach it for any query. The rotation only steers the pruning:
any orthogonal matrix gives the same result. Final scores are integer products of the
original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fillsight.session import materialize

K = 20
SCALE = 64
# Vectors the rotation is fitted on, candidates per group, rows of the first range, queries scored at
# once, and candidates per chunk.
SAMPLE_ROWS = 4_096
GROUP_ROWS = 16_384
FIRST_ROWS = 8_192
BLOCK_QUERIES = 2_048
CHUNK_ROWS = 2_048
STEPS = (0.25, 0.5, 0.75)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x) of each component, as bigint.

    Rows without an id or a vector, and vectors with a NULL or non-finite component, take no part.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite)
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as a matrix; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    if len(column):
        flat = column.flatten().to_numpy()
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Right singular vectors of at most ``rows`` vectors, strongest first."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(rows).select("v").toArrow()
    x = _matrix(sample.column("v"), width).astype(float)
    return np.linalg.svd(x, full_matrices=True)[2].T if len(x) and width else np.eye(width)


def search(
    q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, turn: np.ndarray, k: int = K,
    chunk: int = CHUNK_ROWS, floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best of each query; ties go to the smaller id.

    Candidates that do not reach a query's ``floor`` may be left out.
    """
    order = np.argsort(-np.einsum("ij,ij->i", candidates.astype(float), candidates.astype(float)), kind="stable")
    c_ids, candidates = c_ids[order], candidates[order]
    q, width = queries.astype(float) @ turn, queries.shape[1]
    cuts = sorted({int(width * s) for s in STEPS} - {0}) if width else []
    q_rest = [np.sqrt(np.einsum("ij,ij->i", q[:, c:], q[:, c:])) for c in [0, *cuts]]
    best = [np.zeros(0, np.int64)] * 3  # query row, candidate row, score
    floor = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    for a in range(0, len(candidates), chunk):
        part = candidates[a : a + chunk].astype(float) @ turn
        rest = [np.sqrt(np.einsum("ij,ij->i", part[:, c:], part[:, c:])) for c in [0, *cuts]]
        slack = 1e-6 + 1e-9 * q_rest[0] * rest[0].max(initial=0)
        live = np.flatnonzero(q_rest[0] * rest[0].max(initial=0) >= floor - slack)
        if not len(live):
            break  # all that follow are no longer than these
        partial, done = np.zeros((len(live), len(part))), 0
        rows = cols = None
        for j, cut in enumerate(cuts, 1):
            if rows is None:
                partial += q[live, done:cut] @ part[:, done:cut].T
                keep = partial + np.outer(q_rest[j][live], rest[j]) >= (floor - slack)[live][:, None]
                if keep.mean() < 0.05:  # few pairs left: go on pair by pair
                    rows, cols = np.nonzero(keep)
                    sums = partial[rows, cols]
            else:
                sums = sums + np.einsum("ij,ij->i", q[live[rows], done:cut], part[cols, done:cut])
                keep = sums + q_rest[j][live[rows]] * rest[j][cols] >= (floor - slack)[live[rows]]
                rows, cols, sums = rows[keep], cols[keep], sums[keep]
            done = cut
        if rows is None:
            partial += q[live, done:] @ part[:, done:].T
            partial[q_ids[live][:, None] == c_ids[a : a + chunk]] = -np.inf  # own rows take no place among the k
            rows, cols = np.nonzero(partial >= (floor - slack)[live][:, None])
            if len(rows) > k * len(live):
                # before exact scores: only those that reach the k-th of this chunk
                if partial.shape[1] > k:
                    kth = np.partition(partial, partial.shape[1] - k, axis=1)[:, partial.shape[1] - k]
                    near = partial[rows, cols] >= (kth - slack[live])[rows]
                    rows, cols = rows[near], cols[near]
        rows = live[rows]
        other = q_ids[rows] != c_ids[a + cols]
        rows, cols = rows[other], cols[other] + a
        if not len(rows):
            continue
        score = np.einsum("ij,ij->i", queries[rows], candidates[cols])
        every = [np.concatenate(x) for x in zip(best, (rows, cols, score))]
        rank = np.lexsort((c_ids[every[1]], -every[2], every[0]))
        every = [x[rank] for x in every]
        place = np.arange(len(rank)) - np.searchsorted(every[0], every[0])
        best = [x[place < k] for x in every]
        last = place[place < k] == k - 1
        floor[best[0][last]] = np.maximum(floor[best[0][last]], best[2][last])
    return best[0], order[best[1]], best[2]


def length_cuts(vectors: DataFrame, n: int, first: int) -> list[float]:
    """Squared lengths where a new range starts, falling; about ``first`` rows lie above the first of them."""
    shares, size, total = [], first, first
    while total < n:
        shares.append(1 - total / n)
        size *= 2
        total += size
    if not shares:
        return []
    found = vectors.agg(F.percentile_approx("l", shares, 10_000)).first()[0]
    return sorted({float(c) for c in found}, reverse=True)


def _queries_left(asked: DataFrame, best: DataFrame | None, longest: float, k: int) -> DataFrame:
    """Queries with their ``floor`` whose length reaches it against candidates of a squared length."""
    if best is None:
        return asked.withColumn("floor", F.lit(None).cast("bigint"))
    floors = best.where(F.col("rank") == k).select("query_id", "_q", F.col("score").alias("floor"))
    left = asked.join(floors, ["query_id", "_q"], "left")
    reach = F.sqrt(F.col("l").cast("double") * longest) * (1 + 1e-9) + 1
    return left.where(F.col("floor").isNull() | (reach >= F.col("floor")))


def _score_range(candidates: DataFrame, asked: DataFrame, n: int, width: int, turn: np.ndarray, k: int) -> DataFrame:
    """The k best candidates of a range for each query that comes, per group of candidates."""
    groups = n // GROUP_ROWS + 1
    dealt = candidates.select(
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(groups)).alias("g"), F.lit(0).alias("kind"),
        "vec_id", "v", F.lit(None).cast("bigint").alias("_q"), F.lit(None).cast("bigint").alias("floor"),
    )
    passing = asked.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"), F.lit(1).alias("kind"),
        F.col("query_id").alias("vec_id"), "v", "_q", "floor",
    )

    def run(batches):
        group, c_ids, c_rows, candidates = None, [], [], None

        def scored(part):
            nonlocal candidates
            if candidates is None:
                candidates = np.concatenate(c_ids), np.concatenate(c_rows)
            for a in range(0, part.num_rows, BLOCK_QUERIES):
                q = part.slice(a, BLOCK_QUERIES)
                ids, own = q.column("vec_id").to_numpy(), q.column("_q").to_numpy()
                floor = q.column("floor").cast(pa.float64()).to_numpy(zero_copy_only=False)
                floor = np.where(np.isnan(floor), -np.inf, floor)
                row, col, value = search(ids, _matrix(q.column("v"), width), *candidates, turn, k, floor=floor)
                yield pa.RecordBatch.from_pydict({"query_id": ids[row], "_q": own[row], "vec_id": candidates[0][col], "score": value})

        for b in batches:  # sorted by group: its candidates, then its queries
            keys = b.column("g").to_numpy() * 2 + b.column("kind").to_numpy()
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for a, e in zip(cut, [*cut[1:], len(keys)]):
                part = b.slice(a, e - a)
                if keys[a] // 2 != group:
                    group, c_ids, c_rows, candidates = keys[a] // 2, [], [], None
                if keys[a] % 2 == 0:
                    c_ids.append(part.column("vec_id").to_numpy())
                    c_rows.append(_matrix(part.column("v"), width))
                elif c_ids:
                    yield from scored(part)

    both = dealt.unionByName(passing).repartition(max(groups, 1), "g").sortWithinPartitions("g", "kind")
    return both.mapInArrow(run, "query_id bigint, _q bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query among ``vectors``.

    Both have vec_id and v (see ``quantized``). Rows with the query's own id are no
    candidates. Repeated candidate rows count each; a repeated query row gets one result per
    different vector. Vectors of different lengths end in zeros. A candidate row is dealt
    once; a query is sent to the groups of a range only while the range may improve it.
    """
    length = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    vectors = materialize(vectors.select("vec_id", "v", length.alias("l")))
    n, width, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max("l")).first()
    asked = materialize(queries.select("vec_id", "v").distinct().select(F.col("vec_id").alias("query_id"), "v", length.alias("l"), F.xxhash64("v").alias("_q")))
    turn = rotation(vectors, width or 0)
    cuts, best, above = length_cuts(vectors, n, FIRST_ROWS), None, None
    for low in [*cuts, None]:
        part = vectors.where(F.lit(True) if above is None else F.col("l") < above).where(F.lit(True) if low is None else F.col("l") >= low)
        rows, top = part.agg(F.count("*"), F.max("l")).first()
        above = low if low is not None else above
        if not rows and best is not None:
            continue
        left = _queries_left(asked, best, float(top or 0), k)
        if best is not None and left.isEmpty():
            break  # what follows is no longer than this range
        found = _score_range(part, left, rows, width or 0, turn, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        rank = F.row_number().over(W.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id"))
        best = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k))
    return best.select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """``top_k`` with the rows whose vec_id is divisible by ``every`` as queries."""
    vectors = quantized(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
